"""Hierarchical clustering from the bottom up: Ward's linkage over micro-clusters.

Rows are summed up in micro-clusters, the leaves of a pivot index, each as its number of rows and
mean; where there are no more distinct rows than MICRO, each is one of its own and the result is exact.
Ward's distance follows from numbers and means alone, so the merges are found by nearest-neighbour
chains over the micro-clusters, of which there are a bounded number, and rows take the label of theirs.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from weftwork.operators.neighbors import index_points, numbered
from weftwork.operators.scan import number_rows
from weftwork.session import materialise, write_once

MICRO = 4_000


def ward_merges(n: np.ndarray, mean: np.ndarray) -> list[tuple[int, int, float, int]]:
    """The merges (a, b, height, rows) of clusters of ``n`` rows, lowest first. Clusters are numbered from
    0, and merge i gives cluster len(n) + i. The height is the distance of two single rows whose merge
    would add as much to the sum of squares."""
    m, n, mean = len(n), n.astype(float).copy(), mean.astype(float).copy()
    active, chain, found = np.ones(m, bool), [], []
    while len(found) < m - 1:
        if not chain:
            chain.append(int(np.flatnonzero(active)[0]))
        a = chain[-1]
        gap = np.where(active, 2.0 * n * n[a] / (n + n[a]) * ((mean - mean[a]) ** 2).sum(1), np.inf)
        gap[a] = np.inf
        b = int(gap.argmin())
        if len(chain) > 1 and gap[chain[-2]] <= gap[b]:  # each other's nearest
            b = chain[-2]
            del chain[-2:]
            a, b, height = min(a, b), max(a, b), float(np.sqrt(gap[b]))
            mean[a] = (n[a] * mean[a] + n[b] * mean[b]) / (n[a] + n[b])
            n[a] += n[b]
            active[b] = False  # the merged cluster keeps the place of the smaller one
            found.append((a, b, height, int(n[a])))
        else:
            chain.append(b)
    name, out = list(range(m)), []
    for step, (a, b, height, rows) in enumerate(sorted(found, key=lambda f: f[2])):
        out.append((min(name[a], name[b]), max(name[a], name[b]), height, rows))
        name[a] = m + step
    return out


class Ward(NamedTuple):
    """Rows with their micro-cluster (key, micro), the micro-clusters' merges, and the ids' name."""

    rows: DataFrame
    micro: int
    merges: list[tuple[int, int, float, int]]
    id_col: str
    back: Callable[[DataFrame, str], DataFrame]

    def dendrogram(self) -> DataFrame:
        """(step, a, b, height, rows) of every merge; micro-clusters are numbered by their smallest id."""
        return self.rows.sparkSession.createDataFrame([(i, *m) for i, m in enumerate(self.merges)], "step int, a int, b int, height double, rows bigint")

    def cut(self, k: int) -> DataFrame:
        """(id, cluster): ``k`` clusters, or as many as there are micro-clusters, numbered by their smallest id."""
        top = list(range(self.micro + len(self.merges)))
        for step, (a, b, _, _) in enumerate(self.merges[: max(self.micro - k, 0)]):
            top[a] = top[b] = self.micro + step
        for i in reversed(range(len(top))):  # a cluster's parent has a larger number
            top[i] = top[top[i]] if top[i] != i else i
        first: dict[int, int] = {}
        label = [first.setdefault(top[i], len(first)) for i in range(self.micro)]
        names = self.rows.sparkSession.createDataFrame(list(enumerate(label)), "micro int, cluster int")
        out = self.rows.join(F.broadcast(names), "micro").select(F.col("key").alias(self.id_col), "cluster")  # one row per micro-cluster
        return self.back(out, self.id_col).select(self.id_col, "cluster")


def ward(df: DataFrame, id_col: str, features: str, micro: int = MICRO) -> Ward:
    """Ward's hierarchy of the rows of ``df`` by an array column. Ids are of any type with an order; copies
    of a row are one point that counts as many."""
    rows, back = numbered(df.select(id_col, F.col(features).cast("array<double>").alias("x")), id_col)
    rows = write_once(rows.select("key", "x"))
    points = materialise(rows.groupBy("x").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n")))
    count = points.count()
    if count <= micro:
        placed = points.withColumn("leaf", F.col("key"))
    else:
        placed, _ = index_points(points, block_rows=max(2, -(-count // micro)))
    placed = write_once(placed.select("x", "key", "n", "leaf"))
    sums = placed.groupBy("leaf").agg(F.min("key").alias("least"), F.sum("n").alias("n"), vector_to_array(Summarizer.mean(array_to_vector("x"), F.col("n").cast("double"))).alias("mean"))
    sums = write_once(number_rows(sums, ["least"], "micro").withColumn("micro", F.col("micro").cast("int")))
    found = sums.orderBy("micro").collect()  # micro-clusters, at most the leaves of an index
    merges = ward_merges(np.array([r["n"] for r in found]), np.array([r["mean"] for r in found])) if found else []
    labelled = rows.join(placed.join(sums.select("leaf", "micro"), "leaf").select("x", "micro"), "x").select("key", "micro")
    return Ward(write_once(labelled), len(found), merges, id_col, back)
