"""Interest-ranking analytics as Spark DataFrame plans."""
