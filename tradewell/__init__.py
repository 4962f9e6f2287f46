"""Commerce lakehouse analytics as Spark DataFrame operators."""
