"""Operators for training-data pipelines, each a Spark job of its own."""
