"""Retail purchase analytics as Spark DataFrame operators."""
