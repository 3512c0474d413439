"""Document-unit analytics on Spark."""
