"""Tessera: source-code analytics and training-data preparation as PySpark DataFrame pipelines."""

__version__ = "0.1.0"
