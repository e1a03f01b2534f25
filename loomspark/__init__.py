"""Context analytics on Spark."""
