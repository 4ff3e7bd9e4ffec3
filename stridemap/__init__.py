"""Travel-time analytics on PySpark."""
