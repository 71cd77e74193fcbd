"""Spark jobs that turn archives of fetched web pages into a product catalog."""
