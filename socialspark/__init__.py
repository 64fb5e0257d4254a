"""Social-event analytics as PySpark jobs."""
