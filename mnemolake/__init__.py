"""Dialogue-memory analytics as Spark DataFrame operators."""
