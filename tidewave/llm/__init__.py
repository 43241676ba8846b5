"""Operators for training-data pipelines. Nothing else in tidewave imports this package."""
