"""Edition-alignment analytics on PySpark."""
