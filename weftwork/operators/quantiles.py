"""Exact quantiles (linear interpolation) that never hold a column in one task.

An approximate quantile sketch brackets each wanted rank, one pass counts what lies below and
inside each bracket, and only the bracket's distinct values are ordered. A bracket that is still
large is bracketed again, one that the sketch laid wrongly is widened, so the result is exact at
any size. Up to ``row_limit`` rows, which one task orders at once, Spark's ``percentile`` is used.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, FloatType

ROW_LIMIT = 20_000
BRACKET_LIMIT = 500_000
ACCURACY = 10_000


def number(df: DataFrame, name: str) -> Column:
    """The column as double with NaN read as null."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, (DoubleType, FloatType)):
        c = F.when(~F.isnan(c), c)
    return c.cast("double")


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    row_limit: int = ROW_LIMIT,
    bracket_limit: int = BRACKET_LIMIT,
    accuracy: int = ACCURACY,
) -> dict[str, list[float | None]]:
    """{column: [quantile per prob]}; a handful of numbers per column."""
    cols, probs = list(cols), list(probs)
    if not cols:
        return {}
    data = df.select(*[number(df, c).alias(f"v{i}") for i, c in enumerate(cols)])
    n = data.agg(*[F.count(f"v{i}").alias(f"v{i}") for i in range(len(cols))]).first()
    if max(n) <= row_limit:
        row = data.agg(
            *[F.percentile(f"v{i}", F.array(*[F.lit(float(p)) for p in probs])).alias(f"v{i}") for i in range(len(cols))]
        ).first()
        return {c: list(row[i]) if row[i] is not None else [None] * len(probs) for i, c in enumerate(cols)}

    wanted: dict[tuple[int, int], float | None] = {}
    for i in range(len(cols)):
        for p in probs:
            pos = p * (n[i] - 1)
            if n[i]:
                wanted[(i, math.floor(pos))] = None
                wanted[(i, math.ceil(pos))] = None
    _select_ranks(data, n, wanted, bracket_limit, accuracy)

    result: dict[str, list[float | None]] = {}
    for i, c in enumerate(cols):
        vals: list[float | None] = []
        for p in probs:
            if not n[i]:
                vals.append(None)
                continue
            pos = p * (n[i] - 1)
            lo, hi = wanted[(i, math.floor(pos))], wanted[(i, math.ceil(pos))]
            frac = pos - math.floor(pos)
            vals.append(lo if lo == hi else (1 - frac) * lo + frac * hi)
        result[c] = vals
    return result


def _select_ranks(data: DataFrame, n, wanted: dict, bracket_limit: int, accuracy: int) -> None:
    # (column, rank) -> [low value, high value, rows below low]
    live = {key: [None, None, 0, n[key[0]]] for key in wanted}
    margins = dict.fromkeys(wanted, 3.0 / accuracy)
    while live:
        keys = sorted(live)
        place = {}
        for key in keys:
            _, _, below, size = live[key]
            place[key] = (key[1] - below) / max(size - 1, 1)
        # ranks that share a bracket (all of a column's, at first) share one sketch
        shared: dict[tuple, list] = {}
        for key in keys:
            shared.setdefault((key[0], live[key][0], live[key][1]), []).append(key)
        aggs = []
        for j, ((i, lo, hi), members) in enumerate(shared.items()):
            c = F.col(f"v{i}")
            inside = c if lo is None else F.when(c.between(F.lit(lo), F.lit(hi)), c)
            ps = [x for key in members for x in (max(place[key] - margins[key], 0.0), min(place[key] + margins[key], 1.0))]
            aggs += [
                F.percentile_approx(inside, F.array(*[F.lit(x) for x in ps]), F.lit(accuracy)).alias(f"q{j}"),
                F.min(inside).alias(f"lo{j}"),
                F.max(inside).alias(f"hi{j}"),
            ]
        row = data.agg(*aggs).first()
        trial = {}
        for j, members in enumerate(shared.values()):
            for m, key in enumerate(members):
                a = row[f"lo{j}"] if place[key] <= margins[key] else row[f"q{j}"][2 * m]
                b = row[f"hi{j}"] if place[key] >= 1 - margins[key] else row[f"q{j}"][2 * m + 1]
                trial[key] = (a, b)
        counts = data.agg(
            *[F.count_if(F.col(f"v{i}") < F.lit(trial[(i, r)][0])).alias(f"below{j}") for j, (i, r) in enumerate(keys)],
            *[
                F.count_if(F.col(f"v{i}").between(F.lit(trial[(i, r)][0]), F.lit(trial[(i, r)][1]))).alias(f"in{j}")
                for j, (i, r) in enumerate(keys)
            ],
        ).first()
        small = {}
        for j, key in enumerate(keys):
            a, b = trial[key]
            below, inside = counts[f"below{j}"], counts[f"in{j}"]
            if not below <= key[1] < below + inside:  # the sketch missed: try a wider bracket of the same range
                margins[key] *= 8
            elif a == b:
                wanted[key] = a
                del live[key]
            elif inside <= bracket_limit or inside >= live[key][3]:
                small[key] = (a, b, below)
                del live[key]
            else:
                live[key] = [a, b, below, inside]
        if small:
            _order_brackets(data, small, wanted)


def _order_brackets(data: DataFrame, small: dict, wanted: dict) -> None:
    keys = sorted(small)
    picks = F.array(
        *[
            F.when(
                F.col(f"v{i}").between(F.lit(small[(i, r)][0]), F.lit(small[(i, r)][1])),
                F.struct(F.lit(j).alias("target"), F.col(f"v{i}").alias("v")),
            )
            for j, (i, r) in enumerate(keys)
        ]
    )
    values = (
        data.select(F.explode(F.filter(picks, lambda x: x.isNotNull())).alias("p"))
        .groupBy("p.target", "p.v")
        .agg(F.count("*").alias("c"))
    )
    w = Window.partitionBy("target").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    need = F.element_at(F.array(*[F.lit(r - small[(i, r)][2] + 1) for i, r in keys]), F.col("target") + 1)
    rows = (
        values.withColumn("cum", F.sum("c").over(w))
        .filter(F.col("cum") >= need)
        .groupBy("target")
        .agg(F.min("v").alias("v"))
        .collect()
    )
    for row in rows:
        wanted[keys[row["target"]]] = row["v"]
