"""Exact duplicates by progressive refinement, in built-in expressions only.

Three levels, each over the rows the level before left open: equal length, equal hash of the
first characters, equal SHA-256 of the whole text. The first two levels leave a fixed-size bit set
of the keys held by at least two rows (at most ``BITS / 64`` rows, the only thing broadcast); the
next level's scan looks its rows up there, so a full hash is read only where a copy is possible.
Keys that share a bit cost a hash, never a wrong answer: groups form on (length, prefix hash, SHA).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Bits of a level's set: 65,536 words of 64 bits, whatever the size of the table.
BITS = 1 << 22


def _repeated(rows: DataFrame, *key: str) -> DataFrame:
    """The bit set of the key hashes that at least two rows have: (__word, __bits)."""
    groups = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__c")).filter("__c > 1")
    bit = F.pmod(F.xxhash64(*key), F.lit(BITS))
    return groups.groupBy(F.shiftright(bit, 6).alias("__word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(pmod(xxhash64({}), 64) as int))".format(", ".join(key)))).alias("__bits")
    )


def _open(rows: DataFrame, repeated: DataFrame, *key: str) -> tuple[DataFrame, Column]:
    """The rows beside their word of the set, and whether their bit is on."""
    bit = F.pmod(F.xxhash64(*key), F.lit(BITS))
    joined = rows.withColumn("__word", F.shiftright(bit, 6)).join(F.broadcast(repeated), "__word", "left").drop("__word")
    on = F.expr("shiftright(__bits, cast(pmod(xxhash64({}), 64) as int)) & 1L".format(", ".join(key)))
    return joined, F.coalesce(on, F.lit(0)) == 1


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id`` (largest id of its equal texts), ``group_size``,
    ``kept``, and the ``carry`` columns.

    Null text counts as empty, and empty texts are equal. Rows that repeat an id and its text count
    in ``group_size`` and are kept or dropped together. A null id never outranks another one; if a
    group has no other, ``keep_id`` is null and its rows are kept. Other columns are not looked at.
    """
    carry = carry or {}
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("__id"), F.octet_length(text).alias("__n"), text.alias("__t"), *[c.alias(f"__carry_{k}") for k, c in carry.items()]
    )
    lengths = _repeated(base.select("__n"), "__n")
    head = F.xxhash64(F.substring("__t", 1, prefix))

    def level_two(rows: DataFrame) -> DataFrame:
        joined, on = _open(rows, lengths, "__n")
        return joined.withColumn("__p", F.when(on, head)).drop("__bits")

    heads = _repeated(level_two(base.select("__n", "__t")).filter("__p is not null").select("__n", "__p"), "__n", "__p")
    joined, on = _open(level_two(base), heads, "__n", "__p")
    full = F.when(F.col("__p").isNotNull() & on, F.unhex(F.sha2(F.col("__t").cast("binary"), 256)))
    hashed = joined.withColumn("__sha", full).drop("__bits", "__t")

    groups = (
        hashed.filter("__sha is not null").groupBy("__n", "__p", "__sha").agg(F.max("__id").alias("__keep"), F.count(F.lit(1)).alias("__size")).filter("__size > 1")
    )
    # The join has a key of its own, so that its input is shuffled anew and a large group is split
    # at run time; a row without a SHA is dealt out by its id and matches nothing.
    rows = hashed.withColumn("__key", F.coalesce("__sha", F.unhex(F.hex(F.xxhash64("__id")))))
    both = rows.join(groups.select(F.col("__sha").alias("__key"), "__keep", "__size"), "__key", "left")
    found = F.col("__size").isNotNull()
    keep = F.when(found, F.col("__keep")).otherwise(F.col("__id"))
    return both.select(
        F.col("__id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("__size", F.lit(1)).cast("long").alias("group_size"),
        F.col("__id").eqNullSafe(keep).alias("kept"),
        *[F.col(f"__carry_{k}").alias(k) for k in carry],
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    names = {f"c{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)}
    kept = exact_dedup(docs, id_col, text_col, carry=names).filter("kept")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
