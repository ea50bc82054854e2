"""Operators for preparing training data, each written for its own method."""
