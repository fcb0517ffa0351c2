"""Crossing and corridor safety analytics as Spark DataFrame operators."""
