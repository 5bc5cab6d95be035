"""End-to-end jobs and the query catalogue behind ``__spark_entry__``."""
