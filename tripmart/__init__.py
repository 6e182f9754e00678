"""Trip-record analytics as lazy PySpark DataFrame jobs."""
