"""parley: conversation analytics as Spark DataFrame jobs."""
