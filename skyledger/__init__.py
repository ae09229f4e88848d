"""Cloud observability and security analytics as Spark DataFrame operators."""
