"""Keelson: secret-detection analytics expressed as Spark DataFrame plans."""

__version__ = "1.0.0"
