"""Retail customer analytics as Spark DataFrame operators."""
