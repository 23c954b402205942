"""Operators of a training-data pipeline: one module each, thin queries over them in `queries`."""
