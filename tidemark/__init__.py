"""Change-feed analytics on PySpark."""
