"""Vector search and its evaluation as Spark DataFrame plans."""
