"""Tiered key-value analytics expressed as Spark DataFrame plans."""
