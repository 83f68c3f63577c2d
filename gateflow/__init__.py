"""Spark-first analytics for short-interval passenger flow."""
