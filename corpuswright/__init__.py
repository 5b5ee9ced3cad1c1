"""Evidence-first text analytics as Spark DataFrame jobs."""
