"""tidelane: space-time reconstruction from moving sensors, and data preparation, on PySpark."""
