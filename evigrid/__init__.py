"""Evidence-to-table analytics as Spark DataFrame jobs."""
