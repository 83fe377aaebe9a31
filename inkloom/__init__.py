"""inkloom: analytics over large collections of long-form text, on PySpark."""
