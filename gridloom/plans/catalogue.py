"""All queries of the library; importing this module registers them."""

from __future__ import annotations

from gridloom.plans import archives, assemblies, datasets, scans, texts, vectors, videos
from gridloom.plans.flagship import hash_split_accuracy

__all__ = ["archives", "assemblies", "datasets", "hash_split_accuracy", "scans", "texts", "vectors", "videos"]
