"""Build-failure log analytics on Spark."""
