"""Review-integrity analytics as Spark DataFrame operators."""
