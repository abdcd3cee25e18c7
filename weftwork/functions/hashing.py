"""Row hashes that any SQL engine can reproduce: md5 of ``seed|id`` as hex text.

All seeded choices (samples, splits, folds, bootstraps) order or threshold this text, so a
row's fate depends on its id and the seed only, never on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def row_hash(id_col: str | Column, seed: int) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}|"), c.cast("string")))


def hex_threshold(fraction: float, digits: int = 8) -> str:
    """Hex text below which a ``fraction`` of all hashes fall."""
    top = 16**digits
    cut = min(max(int(round(fraction * top)), 0), top)
    return "g" if cut == top else format(cut, f"0{digits}x")


def hash_below(h: Column, fraction: float) -> Column:
    return h.substr(1, 8) < F.lit(hex_threshold(fraction))


def hash_unit(h: Column, start: int = 1, digits: int = 8) -> Column:
    """Hash digits as a number in [0, 1)."""
    return F.conv(h.substr(start, digits), 16, 10).cast("double") / F.lit(float(16**digits))


def hash_int(h: Column, digits: int = 8) -> Column:
    return F.conv(h.substr(1, digits), 16, 10).cast("bigint")


def text_digest(c: Column) -> Column:
    """Grouping key for long text: sha-256, so equal digests mean equal texts."""
    return F.sha2(c, 256)
