"""Encoding of texts through a table of the chunks already encoded."""

from __future__ import annotations

import sys
from itertools import chain, repeat

import numpy as np
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Chunks, and characters of chunks, that a worker keeps at most; beyond that its table starts anew with
#: those it has met again, unless they are more than half of that.
CHUNKS, CHARACTERS = 800_000, 16_000_000


class ChunkTable:
    """Token ids of chunks of text (strings or their bytes), looked up if seen before. ``encode_many``
    encodes a list of new chunks: it gives them back in an order of its own, with a flat array of ids and the number of ids
    of each."""

    def __init__(self, encode_many):
        self.encode_many = encode_many
        self.clear()

    def clear(self) -> None:
        self.index: dict = {}
        self.characters = 0
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.again = np.zeros(1 << 14, bool)  # chunks met since they were learnt

    def renew(self) -> None:
        """Forget the chunks that were not met again: most are met once, and others would be encoded anew."""
        again = self.again.tolist()
        kept = [(c, i) for c, i in self.index.items() if again[i]]
        characters = sum(len(c) for c, _ in kept)
        if 2 * len(kept) > CHUNKS or 2 * characters > CHARACTERS:
            return self.clear()
        rows = np.array([i for _, i in kept], np.int64)
        sizes = self.size[rows]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.start[rows] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        self.clear()
        self._add([c for c, _ in kept], ids, sizes)

    def _learn(self, chunks: list) -> None:
        self._add(*self.encode_many(chunks))

    def _add(self, chunks: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(self.index), len(chunks)
        while n + m >= len(self.start):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
            self.again = np.concatenate([self.again, np.zeros(len(self.again), bool)])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.size[n : n + m] = sizes
        self.start[n : n + m] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.start[n + m] = self.used
        self.index.update(zip(chunks, range(n, n + m)))
        self.characters += sum(map(len, chunks))

    def find(self, chunks: list) -> np.ndarray:
        """The rows of chunks in the table, until the next call; new ones are encoded."""
        if len(self.index) > CHUNKS or self.characters > CHARACTERS:
            self.renew()
        rows = np.fromiter(map(self.index.get, chunks, repeat(-1)), np.int64, len(chunks))
        unknown = np.flatnonzero(rows < 0)
        self.again[rows[rows >= 0]] = True
        if len(unknown):
            new = [chunks[i] for i in unknown.tolist()]
            self._learn(list(dict.fromkeys(new)))
            rows[unknown] = np.fromiter(map(self.index.__getitem__, new), np.int64, len(new))
        return rows

    def lists(self, rows: np.ndarray):
        """The ids of the chunks in these rows, as an Arrow array of lists."""
        import pyarrow as pa

        known = pa.LargeListArray.from_arrays(self.start[: len(self.index) + 1], self.flat[: self.used])
        return known.take(pa.array(rows))

    def encode(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, given as lists of chunks, one after the other, and the number of ids of each."""
        rows = self.find(list(chain.from_iterable(texts)))
        ends = np.cumsum(self.size[rows])
        cuts = np.cumsum([len(t) for t in texts])
        at = np.concatenate([[0], ends])[cuts] if len(texts) else np.zeros(0, np.int64)
        return self.lists(rows).flatten().to_numpy(), np.diff(at, prepend=0)


def per_worker(key: str, make):
    """``make()``, once per Python worker process; workers serve many tasks in turn."""
    state = sys.modules.setdefault("weftwork-worker-state", {})  # functions sent to workers bring no module of their own
    if key not in state:
        state[key] = make()
    return state[key]


def share(spark: SparkSession, thing) -> Broadcast:
    """Broadcast an object of this package by value, so that workers need not find the package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(thing))


def open_shared(shared: Broadcast):
    """The object of ``share``; a worker process unpacks it once and keeps the last one."""
    import pickle

    kept, data = per_worker("shared", dict), shared.value
    if kept.get("data") != data:
        kept.update(thing=pickle.loads(data), data=data)
    return kept["thing"]


def without(docs: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is not among ``ids`` (one column), whatever the columns are called;
    a null id is compared as a value."""
    gone = ids.toDF("_gone").distinct().select(F.struct(F.col("_gone").alias("id")).alias("_gone"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.struct(F.col(f"`{id_col}`").alias("id")).alias("_id"))
    return rows.join(gone, F.col("_id.id").eqNullSafe(F.col("_gone.id")), "left_anti").select("_row.*")


def grouped(texts, words: int = 200_000):
    """Consecutive lists of texts with some ``words`` * 6 characters each, for steady memory."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size > words * 6:
            yield group
            group, size = [], 0
    if group:
        yield group
