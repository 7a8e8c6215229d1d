"""Social-post analytics as Spark DataFrame jobs, with special care for Arabic text."""
