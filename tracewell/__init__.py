"""Build-log analytics on Spark."""
