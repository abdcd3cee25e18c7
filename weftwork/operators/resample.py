"""Balancing and resampling: SMOTE, Poisson bootstrap, grid augmentation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from weftwork.functions.hashing import hash_int, hash_unit, row_hash
from weftwork.operators.neighbors import nearest_rows


def smote(df: DataFrame, id_col: str, features: str, label: str, minority=1, k: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic minority rows until both classes are equal: (parent, neighbour, copy, features).

    Each lies on the line from a minority row to one of its k nearest minority rows,
    k = min(k, minority rows - 1). Copies are dealt evenly over the minority rows.
    """
    n = df.agg(F.count_if(F.col(label) == minority).alias("few"), F.count_if(F.col(label) != minority).alias("many")).first()
    few, need = n["few"], max(n["many"] - n["few"], 0)
    if few < 2:
        raise ValueError("at least two minority rows are needed")
    k = min(k, few - 1)
    points = df.filter(F.col(label) == minority).select(id_col, F.col(features).cast("array<double>").alias(features))
    near = nearest_rows(points, points, id_col, features, k, exclude_self=True)
    near = near.groupBy(id_col).agg(
        F.sort_array(F.collect_list(F.struct("rank", F.col("neighbour").alias("id")))).alias("_near")  # k entries
    )
    base, extra = divmod(need, few)
    # the rows with the smallest hashes take one copy more
    from weftwork.operators.scan import number_rows

    dealt = number_rows(points.withColumn("_h", row_hash(id_col, seed)), ["_h", id_col], "_i")
    copies = F.lit(base) + F.when(F.col("_i") < extra, 1).otherwise(0)
    rows = (
        dealt.join(near, id_col)
        .withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))))
        .withColumn("_u", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"), F.col("copy").cast("string"))))
    )
    pick = F.pmod(hash_int(F.col("_u")), F.size("_near"))
    rows = rows.withColumns(
        {"neighbour": F.element_at("_near", (pick + 1).cast("int"))["id"], "_gap": hash_unit(F.col("_u"), 9)}
    )
    other = points.select(F.col(id_col).alias("neighbour"), F.col(features).alias("_other"))
    mixed = F.zip_with(F.col(features), F.col("_other"), lambda a, b: a + (b - a) * F.col("_gap"))
    return rows.join(other, "neighbour").select(F.col(id_col).alias("parent"), "neighbour", "copy", mixed.alias(features))


def poisson_cuts(rate: float = 1.0, tail: float = 1e-7) -> list[float]:
    """Cumulative Poisson probabilities, ended where the remaining tail is negligible."""
    p, total, out, i = math.exp(-rate), 0.0, [], 0
    while total < 1 - tail:
        total += p
        out.append(total)
        i += 1
        p *= rate / i
    return out


def poisson_copies(u: Column, rate: float = 1.0) -> Column:
    out = F.lit(0)
    for c in poisson_cuts(rate):
        out = out + (u >= F.lit(c)).cast("int")
    return out


def bootstrap(df: DataFrame, id_col: str, replicas: int, seed: int) -> DataFrame:
    """Samples with replacement: each row appears Poisson(1) times in each replica, decided by a
    hash of (replica, id), so no shuffle and no shared counter. Adds ``replica`` and ``copy``."""
    each = df.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("replica").cast("string"), F.col(id_col).cast("string")))
    n = poisson_copies(hash_unit(h))
    return each.withColumn("copy", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))))


GRID_KINDS = ("original", "flip_h", "flip_v", "rot90", "rot180", "rot270")


def augment_grid(df: DataFrame, arr: str, width: int, height: int, kinds: Sequence[str] = GRID_KINDS) -> DataFrame:
    """Each row once per kind, its row-major grid mirrored or turned counter-clockwise."""

    def source(kind: str, i: int) -> int:
        w, h = width, height
        if kind in ("rot90", "rot270"):
            row, col = divmod(i, height)  # the turned grid is height wide
            return col * w + (w - 1 - row) if kind == "rot90" else (h - 1 - col) * w + row
        row, col = divmod(i, w)
        return {
            "original": i,
            "flip_h": row * w + (w - 1 - col),
            "flip_v": (h - 1 - row) * w + col,
            "rot180": w * h - 1 - i,
        }[kind]

    variants = [
        F.struct(
            F.lit(kind).alias("kind"),
            F.transform(F.array(*[F.lit(source(kind, i) + 1) for i in range(width * height)]), lambda j: F.element_at(arr, j)).alias("grid"),
        )
        for kind in kinds
    ]
    return df.select(*[c for c in df.columns if c != arr], F.inline(F.array(*variants)))
