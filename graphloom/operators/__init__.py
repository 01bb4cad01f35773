"""Operators on node tables, edge tables, walks, vectors and rankings."""
