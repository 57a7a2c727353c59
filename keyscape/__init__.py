"""Object-listing analytics as Spark DataFrame jobs."""
