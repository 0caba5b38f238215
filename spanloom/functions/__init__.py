"""Build-event traces and analytics on Spark."""
