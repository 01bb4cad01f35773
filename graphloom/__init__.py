"""graphloom: analytics over typed node and edge tables, as Spark DataFrame operators."""
