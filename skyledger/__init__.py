"""Air-navigation analytics as Spark DataFrame jobs."""
