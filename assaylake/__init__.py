"""Process-quality analytics as Spark jobs over many plants, signals and decision times."""
