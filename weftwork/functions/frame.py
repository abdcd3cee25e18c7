"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, NumericType, StringType

from weftwork.session import write_once


def one_row(df: DataFrame) -> Column:
    """A one-row frame as a struct column for use in other plans (a scalar subquery, run once)."""
    return df.select(F.struct(*df.columns).alias("_row")).scalar()


def melt(row: DataFrame, entries: Sequence[tuple[str, dict[str, Column]]], key: str = "column") -> DataFrame:
    """Turn one row of aggregates into one row per entry: (entry name, its named values)."""
    structs = [F.struct(F.lit(name).alias(key), *[c.alias(k) for k, c in vals.items()]) for name, vals in entries]
    return row.select(F.inline(F.array(*structs)))


def numeric_names(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


BLOCK_ROWS, BLOCK_BYTES = 10_000, 8_000_000


def over_blocks(rows: DataFrame, df: DataFrame, key: str, step: Callable[[Column, bool], dict[str, Column]], block_rows: int | None = None) -> DataFrame:
    """``rows`` with what ``step`` gives for all of ``df``, a block at a time: it gets a block as an array
    of structs and whether this is the first one, and returns columns, which later blocks refine.

    A block has some BLOCK_ROWS rows and BLOCK_BYTES bytes; ``key`` deals ``df`` out. No plan holds two
    blocks: between them ``rows`` are written with the columns carried so far.
    """
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, ArrayType)]
    sizes = df.agg(F.count(F.lit(1)).alias("n"), *[F.max(F.size(c)).alias(c) for c in arrays]).first()
    width = 8 * (len(df.columns) + sum(sizes[c] or 0 for c in arrays))
    each = max(1, min(block_rows or BLOCK_ROWS, BLOCK_BYTES // width))
    blocks = -(-sizes["n"] // each) or 1
    part = F.pmod(F.xxhash64(key), F.lit(blocks))
    for i in range(blocks):
        if i:
            rows = write_once(rows)
        one = one_row(df.filter(part == i).agg(F.collect_list(F.struct(*df.columns)).alias("c")))["c"]
        rows = rows.withColumn("_block", one)
        rows = rows.withColumns(step(F.col("_block"), not i)).drop("_block")
    return rows


SMALL_BYTES = 16_000_000


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """``df``, written, and marked for broadcast if all its values take up SMALL_BYTES at most. A join on
    a key that a large share of the other side has then moves nothing."""
    df = write_once(df)
    width = sum((F.coalesce(F.octet_length(f.name), F.lit(0)) + 16 if isinstance(f.dataType, StringType) else F.lit(16) for f in df.schema.fields), F.lit(0))
    size = df.agg(F.sum(width.cast("bigint"))).first()[0] or 0
    return F.broadcast(df) if size <= SMALL_BYTES else df


def concurrently(spark: SparkSession, one: Callable, items: Sequence, parallelism: int = 4) -> list:
    """[one(item)] with several Spark jobs at a time."""
    with ThreadPool(max(min(parallelism, len(items)), 1)) as pool:
        return pool.map(inheritable_thread_target(spark)(one), items)


def explode_rows(df: DataFrame, keep: Sequence[str], values: Column, name: str) -> DataFrame:
    """One row per array element. The outer form with a filter behind it keeps Spark from adding
    a ``size(values) > 0`` filter below, which would compute a costly array twice."""
    return df.select(*keep, F.explode_outer(values).alias(name)).filter(F.col(name).isNotNull())
