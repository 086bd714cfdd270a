"""Spark-first corpus analytics and retrieval engine."""
