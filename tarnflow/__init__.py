"""Influence ranking of directed graphs on Spark, and operators for training data in the subpackage ``llm``."""
