"""Spark-first text-recognition evaluation and corpus preparation."""
