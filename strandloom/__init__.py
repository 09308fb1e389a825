"""Spark-native k-mer and taxonomy analytics."""

__version__ = "0.1.0"
