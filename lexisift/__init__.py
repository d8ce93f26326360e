"""Text forensics and corpus evaluation as Spark DataFrame expressions."""
