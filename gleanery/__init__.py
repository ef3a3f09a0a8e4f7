"""Site-inventory analytics on PySpark."""
