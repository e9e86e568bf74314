"""Token-pattern analytics on Spark."""
