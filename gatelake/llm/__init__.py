"""Operators that a training-data pipeline needs. Nothing else in gatelake imports this package."""
