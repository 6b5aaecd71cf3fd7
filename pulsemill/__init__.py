"""pulsemill: trending-topic lifecycle analytics on PySpark."""
