"""Spark operators for spreading parent-area forecasts onto small areas and verifying them."""

__version__ = "0.1.0"
