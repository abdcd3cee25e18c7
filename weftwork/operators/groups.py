"""Group summaries, per-group ranking and running values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftwork.functions.frame import explode_rows
from weftwork.functions.hashing import row_hash
from weftwork.operators.scan import number_rows, prefix_scan

_FUNCS = {
    "count": F.count,
    "sum": F.sum,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "nunique": F.count_distinct,
}


def group_summary(df: DataFrame, by: Sequence[str], spec: Mapping[str, tuple[str, str | Column]]) -> DataFrame:
    """``spec``: output name -> (function, column)."""
    return df.groupBy(*by).agg(*[_FUNCS[f](c).alias(name) for name, (f, c) in spec.items()])


def top_groups(summary: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return summary.orderBy(*order).limit(n)


def group_means(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in cols])


def concat_text(df: DataFrame, by: str, text: str, order: Sequence[str], sep: str = " ", chunk_bytes: int = 64_000_000) -> DataFrame:
    """Texts of each key joined in order: (by, chunk, text).

    A chunk takes the rows that begin within its ``chunk_bytes`` bytes of the key's texts, so a key
    below that is one string, and a larger one goes on in further chunks; nothing is left out.
    """
    rows = df.select(by, *[c for c in order if c != by], F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = prefix_scan(rows.withColumn("_n", F.octet_length("_text")), order, {"_before": ("sum", "_n", False)}, by=[by])
    rows = rows.withColumn("chunk", F.floor(F.col("_before") / chunk_bytes).cast("bigint"))
    return (
        rows.groupBy(by, "chunk")
        .agg(F.sort_array(F.collect_list(F.struct(*order, "_text"))).alias("_items"))  # at most chunk_bytes and a row
        .select(by, "chunk", F.array_join(F.transform("_items", lambda x: x["_text"]), sep).alias(text))
    )


def crosstab(df: DataFrame, a: str, b: str, values: Sequence) -> DataFrame:
    """Counts of a (rows) by b (one column per listed value)."""
    out = df.groupBy(a).pivot(b, list(values)).agg(F.count(F.lit(1)))
    return out.select(a, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).cast("bigint").alias(f"{b}_{v}") for v in values])


def group_mode(df: DataFrame, by: str, col: str) -> DataFrame:
    """Most frequent value per group, the smallest on ties."""
    counts = df.groupBy(by, col).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(by).orderBy(F.desc("n"), col)
    return counts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(by, F.col(col).alias("mode"), "n")


def best_by(df: DataFrame, metrics: Sequence[str], id_col: str) -> DataFrame:
    """For each metric the row with its highest value (smallest id on ties)."""
    # rank by (metric, reversed id order): max_by on the metric, then min id among equals
    picks = [
        F.min_by(F.struct(*df.columns), F.struct((-F.col(m)).alias("m"), F.col(id_col).alias("i"))).alias(f"b{i}")
        for i, m in enumerate(metrics)
    ]
    row = df.agg(*picks)
    entries = [
        F.struct(F.lit(m).alias("metric"), F.col(f"b{i}")[id_col].alias(id_col), F.col(f"b{i}")[m].cast("double").alias("value"))
        for i, m in enumerate(metrics)
    ]
    return row.select(F.inline(F.array(*entries)))


def top_n(df: DataFrame, metric: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(metric), tie).limit(n)


def fold_summary(df: DataFrame, by: Sequence[str], metric: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.avg(metric).alias("mean"),
        F.stddev_pop(metric).alias("std_pop"),
        F.stddev_samp(metric).alias("std_samp"),
        F.min(metric).alias("min"),
        F.max(metric).alias("max"),
    )


def vocabulary_size(df: DataFrame, tokens: Column, stop: Sequence[str]) -> DataFrame:
    vocab = explode_rows(df, [], tokens, "w").distinct()
    return vocab.agg(F.count(F.lit(1)).alias("vocabulary"), F.count_if(~F.col("w").isin(*stop)).alias("vocabulary_no_stop"))


def head_per_group(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def top_words(df: DataFrame, by: str, tokens: Column, k: int, stop: Sequence[str] = ()) -> DataFrame:
    """The ``k`` most frequent words per group: (by, word, n, rank); ties by word."""
    ws = explode_rows(df, [by], tokens, "word")
    if stop:
        ws = ws.filter(~F.col("word").isin(*stop))
    counts = ws.groupBy(by, "word").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(by).orderBy(F.desc("n"), "word")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def sample_per_group(df: DataFrame, by: str, n: int, id_col: str, seed: int) -> DataFrame:
    return head_per_group(df.withColumn("_h", row_hash(id_col, seed)), [by], ["_h", id_col], n).drop("_h")


def rank_in_group(df: DataFrame, by: str, col: str, id_col: str) -> DataFrame:
    """Position of every row in its group ordered by (col, id), and the group's offset.

    The offset is the number of rows in the groups sorted before it, so rows of group after
    group stack up without gaps. Any group may be arbitrarily large.
    """
    ranked = number_rows(df, [col, id_col], "rank", by=[by], start=1)
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    offsets = prefix_scan(sizes, [by], {"offset": ("sum", "_n", False)}).select(by, F.col("offset").cast("bigint").alias("offset"))
    return ranked.join(offsets, by)


def early_stop(df: DataFrame, run: str, step: Sequence[str], metric: str, patience: int) -> DataFrame:
    """Per run: best value, the step it was reached, the number of steps, and the step at which
    ``patience`` steps in a row had brought no better value (null if never).

    ``step`` orders the history (unique per run). Any run may be arbitrarily long.
    """
    hist = prefix_scan(
        df.select(run, *step, metric),
        step,
        {"_i": ("count", None, True), "_before": ("max", metric, False)},
        by=[run],
    )
    better = F.col("_before").isNull() | (F.col(metric) > F.col("_before"))
    hist = hist.withColumn("_gain", F.when(better & F.col(metric).isNotNull(), F.col("_i")))
    seen = prefix_scan(hist, ["_i"], {"_last": ("max", "_gain", True)}, by=[run])
    waited = F.col("_i") - F.coalesce(F.col("_last"), F.lit(0))
    return seen.groupBy(run).agg(
        F.max(metric).alias("best"),
        F.max("_gain").cast("bigint").alias("best_step"),
        F.max("_i").cast("bigint").alias("steps"),
        F.min(F.when(waited >= patience, F.col("_i"))).cast("bigint").alias("stop_step"),
    )
