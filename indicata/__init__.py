"""Indicator analytics as Spark DataFrame plans."""
