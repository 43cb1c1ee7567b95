"""Goal-plan analytics over whole populations, as plain Spark DataFrame jobs."""
