"""Samples, splits and folds decided by a seeded hash of the row id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftwork.functions.hashing import hash_below, row_hash
from weftwork.operators.scan import TAKE_ROWS, number_rows

_DIGITS = 4  # first hex digits of the hash: 65 536 buckets per class


def sample_n(df: DataFrame, n: int, id_col: str, seed: int) -> DataFrame:
    """The ``n`` rows of smallest hash. A large sample is cut at its last hash, found from a
    histogram, so the table is filtered rather than sorted."""
    hashed = df.withColumn("_h", row_hash(id_col, seed))
    if n <= TAKE_ROWS:
        return hashed.orderBy("_h", id_col).limit(n).drop("_h")
    ends = hash_cuts(hashed.withColumn("_all", F.lit(0)), "_all", F.array(F.least(F.lit(n).cast("bigint"), F.col("n"))), "_h", id_col)
    last = ends.first()
    return df if last is None else hashed.filter(F.col("_h") <= F.lit(last["_cuts"][0])).drop("_h")


def random_split(df: DataFrame, test_fraction: float, id_col: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash threshold: no shuffle, and a row never changes sides."""
    below = hash_below(row_hash(id_col, seed), test_fraction)
    return df.filter(~below), df.filter(below)


def hash_cuts(df: DataFrame, stratum: str, cuts: Column, h: str, id_col: str) -> DataFrame:
    """Per stratum the hashes that end each cut: (stratum, cuts as a sorted array).

    ``cuts`` maps the stratum's size ``n`` to an array of row counts. A histogram of the first
    hash digits finds the bucket holding each cut; only that bucket's rows are ranked, so a
    stratum with most of the rows is never sorted in one task.
    """
    bucket = F.col(h).substr(1, _DIGITS)
    hist = df.groupBy(F.col(stratum).alias("_s"), bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumns(
        {"_from": F.coalesce(F.sum("_n").over(run), F.lit(0)), "n": F.sum("_n").over(Window.partitionBy("_s"))}
    )
    targets = (
        hist.select("_s", "_b", "_from", "_n", F.explode(cuts).alias("_cut"))
        .filter((F.col("_cut") > F.col("_from")) & (F.col("_cut") <= F.col("_from") + F.col("_n")))
        .select("_s", "_b", "_cut", (F.col("_cut") - F.col("_from")).alias("_k"))
    )
    rows = df.select(F.col(stratum).alias("_s0"), bucket.alias("_b0"), F.col(h).alias("_h0"), F.col(id_col).alias("_id0"))
    edge = rows.join(targets, F.col("_s").eqNullSafe(F.col("_s0")) & (F.col("_b") == F.col("_b0")))
    order = Window.partitionBy("_s", "_cut").orderBy("_h0", "_id0")
    return (
        edge.withColumn("_r", F.row_number().over(order))
        .filter(F.col("_r") == F.col("_k"))
        .groupBy("_s")
        .agg(F.sort_array(F.collect_list("_h0")).alias("_cuts"))
    )


def _with_cuts(df: DataFrame, stratum: str, cuts: Column, id_col: str, seed: int) -> DataFrame:
    hashed = df.withColumn("_h", row_hash(id_col, seed))
    ends = hash_cuts(hashed, stratum, cuts, "_h", id_col)
    return hashed.join(ends, F.col("_s").eqNullSafe(F.col(stratum)), "left")


def stratified_split(df: DataFrame, label: str, test_fraction: float, id_col: str, seed: int) -> DataFrame:
    """Adds ``split``: exactly round(n * fraction) rows of each class are 'test', the rest 'train'."""
    cuts = F.array(F.floor(F.col("n") * F.lit(test_fraction) + F.lit(0.5)).cast("bigint"))
    out = _with_cuts(df, label, cuts, id_col, seed)
    test = F.coalesce(F.col("_h") <= F.col("_cuts")[0], F.lit(False))
    return out.select(*df.columns, F.when(test, "test").otherwise("train").alias("split"))


def split_with_fallback(df: DataFrame, label: str, test_fraction: float, id_col: str, seed: int) -> tuple[DataFrame, str]:
    """Stratified split when possible, else random; the reason is returned with it."""
    if label not in df.columns:
        reason = "no label column"
    elif df.select(label).distinct().limit(2).count() < 2:
        reason = "single class"
    else:
        return stratified_split(df, label, test_fraction, id_col, seed), "stratified"
    below = hash_below(row_hash(id_col, seed), test_fraction)
    return df.withColumn("split", F.when(below, "test").otherwise("train")), reason


def flag_split(df: DataFrame, flag: str) -> tuple[DataFrame, DataFrame]:
    """(rows without the flag, rows with it); an empty side is an error."""
    on = F.coalesce(F.col(flag).cast("int") == 1, F.lit(False))
    sides = df.agg(F.count_if(on).alias("on"), F.count_if(~on).alias("off")).first()
    if not sides["on"] or not sides["off"]:
        raise ValueError(f"split by {flag} leaves one side empty")
    return df.filter(~on), df.filter(on)


def stratified_folds(df: DataFrame, label: str, k: int, id_col: str, seed: int) -> DataFrame:
    """Adds ``fold`` 0..k-1 with per-class sizes that differ by at most one."""
    cuts = F.array(*[F.floor(F.col("n") * F.lit(j) / F.lit(k)).cast("bigint") for j in range(1, k)])
    out = _with_cuts(df, label, cuts, id_col, seed)
    full = F.coalesce(F.col("_cuts"), F.array().cast("array<string>"))
    # a class smaller than k has cuts of size 0, which no row ends; they shift the later folds
    empty = F.lit(k - 1) - F.size(full)
    past = F.size(F.filter(full, lambda t: t < F.col("_h")))
    return out.select(*df.columns, (past + empty).cast("int").alias("fold"))


def group_folds(df: DataFrame, group: str, k: int, seed: int, label: str | None = None, id_col: str | None = None, largest: int = 1_000) -> DataFrame:
    """Adds ``fold`` such that no group is in two folds; k is cut to the number of groups.

    Groups are dealt in the order of their sizes (ties by value): each of the ``largest`` to the
    fold that is lightest so far, the others back and forth over the folds, the lightest first.
    The latter are no larger than any of the former, so the folds stay as even as the large groups
    allow, whatever the number of groups. With at most one group: stratified folds instead.
    """
    largest = max(largest, k, 2)
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    ranked = number_rows(sizes, [F.desc("n"), F.col(group).asc_nulls_first()], "_rank")
    head = ranked.filter(F.col("_rank") < largest).collect()  # at most ``largest`` rows
    if len(head) <= 1:
        if label is None or id_col is None:
            raise ValueError("one group only: label and id are needed for stratified folds")
        return stratified_folds(df, label, k, id_col, seed)
    k = min(k, len(head))
    load, placed = [0] * k, []
    for row in sorted(head, key=lambda r: r["_rank"]):
        f = min(range(k), key=lambda i: (load[i], i))
        load[f] += row["n"]
        placed.append((row["_rank"], f))
    turn = sorted(range(k), key=lambda i: (load[i], i))
    back_and_forth = F.array(*[F.lit(f) for f in turn + turn[::-1]])
    chosen = df.sparkSession.createDataFrame(placed, "_rank bigint, _fold int")
    dealt = F.get(back_and_forth, ((F.col("_rank") - largest) % (2 * k)).cast("int"))
    folds = ranked.join(F.broadcast(chosen), "_rank", "left").select(F.col(group).alias("_g"), F.coalesce("_fold", dealt).alias("fold"))
    return df.join(folds, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def hash_fold(h: Column, k: int) -> Column:
    """Fold by hash digits: no shuffle, sizes near equal."""
    return F.pmod(F.conv(h.substr(1, 8), 16, 10).cast("bigint"), F.lit(k)).cast("int")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Per class: n, balanced weight n / (classes * n_class), and rest-to-class ratio."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = counts.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes"))
    tot = every.select(F.struct("rows", "classes").alias("t")).scalar()
    return counts.select(
        label,
        "n",
        (tot["rows"] / (tot["classes"] * F.col("n"))).alias("weight"),
        ((tot["rows"] - F.col("n")) / F.col("n")).alias("pos_weight"),
    )


def with_class_weight(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    return df.join(class_weights(df, label).select(label, F.col("weight").alias(name)), label)
