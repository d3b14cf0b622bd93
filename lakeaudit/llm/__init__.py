"""Operators for training-data pipelines (see the README section of the same name)."""
