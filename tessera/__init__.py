"""Tessera: a Spark-native engine for listing-integrity analytics and corpus preparation."""

__version__ = "0.1.0"
