"""News-content and reader-engagement analytics as Spark DataFrame plans."""
