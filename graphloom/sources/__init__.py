"""Readers and writers of graph tables, walks and vectors, and the graph view of the test tables."""
