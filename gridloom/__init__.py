"""Spark-first analytics for dense-vision data: shards, grids, vectors, metrics and text."""
