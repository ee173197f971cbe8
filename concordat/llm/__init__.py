"""Operators for training-data pipelines on Spark tables. Nothing else in the library imports this subpackage."""
