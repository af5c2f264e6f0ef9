"""Operators of a training-data pipeline. Nothing else in taskloom imports this package."""
