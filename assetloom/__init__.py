"""Catalog analytics and training-data preparation as plain PySpark DataFrame programs."""

__version__ = "0.1.0"
