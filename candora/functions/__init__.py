"""Column-level building blocks used by the operators."""
