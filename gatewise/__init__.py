"""Per-object (single-cell) table analytics on Spark DataFrames."""
