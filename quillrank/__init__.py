"""Spark-first scoring, ranking and corpus preparation."""
