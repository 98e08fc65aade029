"""Spark-first engine for curating, reviewing and synchronising catalogued datasets."""
