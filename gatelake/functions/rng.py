"""Deterministic uniform numbers from md5, the same in every engine that has md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int | str, *keys: Column | str) -> Column:
    """A number in [0, 1) that depends on the seed and the keys only."""
    parts = [F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def bucket(seed: int | str, k: Column | int, *keys: Column | str) -> Column:
    """A number from 0 to k - 1 that depends on the seed and the keys only."""
    parts = [F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in keys]]
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")
    return F.pmod(draw, k if isinstance(k, Column) else F.lit(k)).cast("int")
