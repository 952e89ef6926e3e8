"""Murmuration: a PySpark-native engine for streams of point observations and the relational work around them."""

__version__ = "0.1.0"
