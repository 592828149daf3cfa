"""Seeded pseudo-randomness that depends on row keys only.

``rand()`` would give another value whenever a stage is recomputed after an
executor loss, and another one per partitioning. A digest of the seed and the
row's own key is the same on every attempt and in every layout.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def digest(seed, *keys: Column) -> Column:
    """32 hex digits for (seed, keys); sorting by it gives a seeded shuffle."""
    parts = [F.lit(str(seed))] + [F.col(k).cast("string") if isinstance(k, str)
                                  else k.cast("string") for k in keys]
    return F.md5(F.concat_ws(":", *parts))


def _hex_to_long(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("long")


def draw(seed, *keys: Column) -> Column:
    """Uniform integer in [0, 2^32); use it with a small modulus."""
    return _hex_to_long(F.substring(digest(seed, *keys), 1, 8))


def wide_draw(seed, *keys: Column) -> Column:
    """Uniform integer in [0, 2^60), for a modulus that may be a row count."""
    return _hex_to_long(F.substring(digest(seed, *keys), 1, 15))
