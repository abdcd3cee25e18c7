"""Running values over a global or per-group order without a one-task window.

Rows are range-partitioned on (group, order), so even one hot group is cut into many ranges.
Each range computes its own running value; what a group has in earlier ranges is carried into the
later ones. A range has at most one group that began before it, so the carried rows are fewer than
the ranges. Spark picks the ranges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftwork.session import materialise

_PART = "_range"
_NATIVE = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min, "xor": F.bit_xor}
_COMBINE = _NATIVE | {"count": F.sum}


def _as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def prefix_scan(
    df: DataFrame,
    order: Sequence[str | Column],
    aggs: Mapping[str, tuple],
    by: Sequence[str] = (),
) -> DataFrame:
    """Add running values. ``aggs``: name -> (kind, column, inclusive), kind in sum/count/max/min/xor.

    An exclusive value is what all *earlier* rows give (0 for sums and xor, null for max/min at the start).
    """
    by = list(by)
    order_cols = [_as_col(c) for c in order]
    ranged = df.repartitionByRange(*[F.col(b) for b in by], *order_cols)
    staged = materialise(ranged.withColumn(_PART, F.spark_partition_id()))

    local = Window.partitionBy(_PART, *by).orderBy(*order_cols)
    inc = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    exc = local.rowsBetween(Window.unboundedPreceding, -1)

    totals = staged.groupBy(_PART, *by).agg(
        *[_NATIVE[kind](F.col(col) if col else F.lit(1)).alias(f"_t_{out}") for out, (kind, col, _) in aggs.items()]
    )
    order_of_ranges = Window.partitionBy(*by).orderBy(_PART)
    earlier = order_of_ranges.rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        F.row_number().over(order_of_ranges).alias("_k_nth"),
        F.col(_PART).alias("_k_range"),
        *[F.col(b).alias(f"_k_{b}") for b in by],
        *[_COMBINE[kind](f"_t_{out}").over(earlier).alias(f"_c_{out}") for out, (kind, _, _) in aggs.items()],
    )
    carry = F.broadcast(carry.filter("_k_nth > 1").drop("_k_nth"))  # at most one row per range
    running = staged.withColumns(
        {
            f"_l_{out}": _NATIVE[kind](F.col(col) if col else F.lit(1)).over(inc if inclusive else exc)
            for out, (kind, col, inclusive) in aggs.items()
        }
    )
    cond = F.col(_PART) == F.col("_k_range")
    for b in by:
        cond = cond & F.col(b).eqNullSafe(F.col(f"_k_{b}"))
    joined = running.join(carry, cond, "left")
    out_cols = {}
    for out, (kind, _, _) in aggs.items():
        if kind in ("sum", "count", "xor"):
            carried, here = (F.coalesce(F.col(f"{side}_{out}"), F.lit(0)) for side in ("_c", "_l"))
            out_cols[out] = carried.bitwiseXOR(here) if kind == "xor" else carried + here
        else:
            pick = F.greatest if kind == "max" else F.least
            out_cols[out] = pick(F.col(f"_c_{out}"), F.col(f"_l_{out}"))  # both skip nulls
    return joined.select(*df.columns, *[v.alias(k) for k, v in out_cols.items()])


def number_rows(df: DataFrame, order: Sequence[str | Column], name: str, by: Sequence[str] = (), start: int = 0) -> DataFrame:
    """Consecutive numbers in ``order`` (which must be unique), from ``start``, per group."""
    out = prefix_scan(df, order, {name: ("count", None, False)}, by)
    return out.withColumn(name, (F.col(name) + F.lit(start)).cast("bigint"))


TAKE_ROWS = 10_000


def top_rows(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows in ``order`` (unique). A few are merged by Spark's top-n; many would
    meet in one task there, so they are numbered over ranges instead."""
    if n <= TAKE_ROWS:
        return df.orderBy(*[_as_col(c) for c in order]).limit(n)
    return number_rows(df, order, "_top").filter(F.col("_top") < n).drop("_top")
