"""Repeated lines, found by probing a sharded minimal perfect hash.

The first pass turns every long enough line into a 128-bit hash and counts, per hash, the documents
that hold it and the largest id among them. The hashes of lines that are frequent are dealt into
shards of bounded size; each shard becomes a minimal perfect hash (levels of bit arrays, as many
slots as keys) over three arrays: a 64-bit fingerprint, the count, and the keeper. The second pass
reads the documents once more and looks their lines up there, in the same task that has the text:
no line is shuffled or joined. Shards are broadcast in blocks of bounded size, one pass per block.

A line matches by slot and fingerprint, so by all 128 bits of its hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from weftwork.session import write_once

#: Keys of a shard on average, and bytes of index that one pass sends to the executors.
SHARD_KEYS = 200_000
BLOCK_BYTES = 64_000_000
#: White space that is cut from both ends of a line before it is compared.
SPACE = " \t\n\v\f\r"


def line_hashes(text: str, min_chars: int) -> list[bytes | None]:
    """The 16-byte hash of each line's key; None for keys that are too short."""
    from xxhash import xxh3_128_digest

    out = []
    for line in text.split("\n"):
        key = line.strip(SPACE)
        out.append(xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower()) if len(key) >= min_chars else None)
    return out


def _halves(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


class PerfectHash:
    """A minimal perfect hash of distinct keys (two 64-bit halves each). Level by level, keys that
    have a bit of the level's array to themselves take it; the others go on to the next level."""

    def __init__(self, levels: list[np.ndarray] | None = None):
        self.levels = levels or []  # bits as 64-bit words
        self.ranks, total = [], 0
        for words in self.levels:
            counts = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(total + np.cumsum(counts) - counts)
            total += int(counts.sum())

    @staticmethod
    def _position(a: np.ndarray, b: np.ndarray, level: int, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (a.astype(np.uint64) ^ (b.astype(np.uint64) * np.uint64(2 * level + 0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
            return (x * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(20)) % np.uint64(bits)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        levels = []
        while len(a):
            size = max(64, -(-2 * len(a) // 64) * 64)
            at = cls._position(a, b, len(levels), size).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8").copy())
            left = ~alone[at]
            a, b = a[left], b[left]
        return cls(levels)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key it was not built from, any slot or -1."""
        out, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, (words, ranks) in enumerate(zip(self.levels, self.ranks)):
            at = self._position(a[left], b[left], level, 64 * len(words))
            word, bit = words[(at >> np.uint64(6)).astype(np.int64)], at & np.uint64(63)
            on = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[on]] = (ranks[(at >> np.uint64(6)).astype(np.int64)] + below)[on]
            left = left[~on]
        return out


class Shard:
    """A perfect hash and the arrays it indexes."""

    def __init__(self, a: np.ndarray, b: np.ndarray, counts: np.ndarray, keepers: np.ndarray):
        self.hash = PerfectHash.build(a, b)
        at = self.hash.slots(a, b)
        self.prints, self.counts, self.keepers = np.empty_like(b), np.empty(len(a), np.int32), np.empty(len(a), np.int64)
        self.prints[at], self.counts[at], self.keepers[at] = b, np.minimum(counts, 2**31 - 1), keepers

    def probe(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts (0 for keys that are not here) and keepers."""
        slot = self.hash.slots(a, b)
        here = (slot >= 0) & (self.prints[slot] == b) if len(self.prints) else np.zeros(len(a), bool)
        return np.where(here, self.counts[slot], 0), np.where(here, self.keepers[slot], 0)

    def arrays(self) -> tuple:
        return self.hash.levels, self.prints, self.counts, self.keepers

    @classmethod
    def of(cls, levels, prints, counts, keepers) -> Shard:
        shard = cls.__new__(cls)
        shard.hash, shard.prints, shard.counts, shard.keepers = PerfectHash(levels), prints, counts, keepers
        return shard


def frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(a, b, count, keeper): the hashes of long lines that at least ``min_docs`` rows hold."""

    def batches(it: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in it:
            ids, hashes = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                mine = {h for h in line_hashes(text.decode("utf-8", "replace"), min_chars) if h} if text else ()
                ids.extend([row] * len(mine))
                hashes.extend(mine)
            a, b = _halves(hashes)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), batch.column(0).take(pa.array(ids, pa.int64()))], names=["a", "b", "id"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("t"))
    held = rows.mapInArrow(batches, "a bigint, b bigint, id bigint")
    return held.groupBy("a", "b").agg(F.count(F.lit(1)).alias("count"), F.max("id").alias("keeper")).filter(F.col("count") >= min_docs)


def build_index(lines: DataFrame) -> DataFrame:
    """(shard, size, data): the index of (a, b, count, keeper), in shards of some SHARD_KEYS keys.
    Lines that only rows without an id hold have no keeper and are left out."""
    import pickle

    lines = lines.filter("keeper is not null")
    shards = max(1, -(-lines.count() // SHARD_KEYS))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        data = pickle.dumps(Shard(*(group[c].to_numpy() for c in ("a", "b", "count", "keeper"))).arrays())
        return pd.DataFrame({"shard": [int(group["shard"].iloc[0])], "shards": [shards], "size": [len(data)], "data": [data]})

    dealt = lines.withColumn("shard", F.pmod("a", F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(build, "shard int, shards int, size bigint, data binary")


def _probe(rows: DataFrame, index: dict[int, bytes], shards: int, min_chars: int, min_docs: int, last: bool) -> DataFrame:
    """Add the numbers of the lines that go to ``__drop``; in the last pass, cut them out instead."""
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def batches(it: Iterator) -> Iterator:
        import pickle

        import pyarrow as pa

        parts = {k: Shard.of(*pickle.loads(v)) for k, v in shared.value.items()}
        for batch in it:
            texts = [t.decode("utf-8", "replace") if t else "" for t in batch.column(0).to_pylist()]
            ids, dropped = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            owner, number, hashes = [], [], []
            for row, text in enumerate(texts):
                for n, h in enumerate(line_hashes(text, min_chars)):
                    if h:
                        owner.append(row)
                        number.append(n)
                        hashes.append(h)
            a, b = _halves(hashes)
            shard = np.mod(a, shards)
            for k, part in parts.items():
                at = np.flatnonzero(shard == k)
                counts, keepers = part.probe(a[at], b[at])
                for i, keeper in zip(at[counts >= min_docs].tolist(), keepers[counts >= min_docs].tolist()):
                    if ids[owner[i]] != keeper:
                        dropped[owner[i]].append(number[i])
            others = batch.columns[3:]
            if not last:
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(dropped, pa.list_(pa.int32())), *others], names=batch.schema.names)
                continue
            kept, total = [], []
            for text, gone in zip(texts, dropped):
                lines, away = text.split("\n"), set(gone)
                total.append(len(lines))
                kept.append("\n".join(x for n, x in enumerate(lines) if n not in away) if away else text)
            counted = pa.array([len(set(d)) for d in dropped], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array(total, pa.int64()), counted, *others], names=["__kept", "__lines", "__dropped", *batch.schema.names[3:]])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    return rows.mapInArrow(batches, ", ".join(["__kept string", "__lines bigint", "__dropped bigint", *kinds[3:]] if last else kinds))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, ``n_lines``, ``n_dropped`` and ``kept``, the text without the
    lines that are frequent, in all but the document with the largest id that holds them.

    Lines are compared without white space at their ends and without regard to the case of A-Z; keys
    of fewer than ``min_chars`` characters always stay. Null and empty texts are one empty line. Ids
    are whole numbers; rows that repeat an id count one by one and keep their lines together. Rows
    without an id lose frequent lines like any other, but never keep one for others.
    """
    index = write_once(build_index(write_once(frequent_lines(docs, id_col, text_col, min_chars, min_docs))))
    blocks, used = [[]], 0
    for r in index.select("shard", "shards", "size").orderBy("shard").collect():  # one small row per shard
        if blocks[-1] and used + r["size"] > block_bytes:
            blocks.append([])
            used = 0
        blocks[-1].append(r)
        used += r["size"]
    rows = docs.select(
        F.col(text_col).cast("binary").alias("__text"), F.col(id_col).cast("bigint").alias("__key"), F.array().cast("array<int>").alias("__drop"), F.col(id_col).alias("__id")
    )
    for n, block in enumerate(blocks):
        wanted = [r["shard"] for r in block]
        data = {r["shard"]: bytes(r["data"]) for r in index.filter(F.col("shard").isin(wanted)).select("shard", "data").collect()} if wanted else {}
        last = n == len(blocks) - 1
        rows = _probe(rows, data, block[0]["shards"] if block else 1, min_chars, min_docs, last)
        if not last:
            rows = write_once(rows)
    return rows.select(F.col("__id").alias(id_col), F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.col("__kept").alias("kept"))
