"""Structural page similarity on Spark: archives, DOM nodes, 3-grams, sketches, LSH."""
