"""Operators for training-data pipelines. Nothing else in tidelog imports this subpackage."""
