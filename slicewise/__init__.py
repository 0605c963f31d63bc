"""Release-comparison analytics on Spark."""
