"""postmill: content-intelligence analytics as Spark DataFrame jobs."""
