"""Spark ML pipelines."""
