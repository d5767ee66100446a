"""Spark-first structural-variant analytics: DataFrame operators over alignments, intervals and calls."""
