"""lexmill: a full-text search and text-processing engine expressed as Spark DataFrame plans."""
