"""Deterministic hash splits: the first 8 bytes of a SHA-256 as a fraction of 2**64."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def threshold_hex(fraction: float) -> str:
    """The smallest 64-bit v, in hex, with v / 2**64 >= fraction under rounded division."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must be between 0 and 1")
    low, high = 0, 2**64
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if mid / 2**64 >= fraction else (mid + 1, high)
    return f"{low:016x}"


def hash_hex(key: Column, seed: int) -> Column:
    """16 hex digits of sha256("seed:key"); fixed width, so text order is number order."""
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 16)


def is_validation(key: Column, fraction: float = 0.05, seed: int = 42) -> Column:
    """True where the key falls in the validation split (strictly below the fraction)."""
    return hash_hex(key, seed) < F.lit(threshold_hex(fraction))
