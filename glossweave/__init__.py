"""Linguistic and readability features over document tables, as Spark DataFrame operators."""
