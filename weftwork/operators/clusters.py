"""Clustering: k-means, bisecting k-means, nearest centre, DBSCAN on a grid or on metric cells."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from weftwork.functions.frame import concurrently, over_blocks
from weftwork.operators.neighbors import BLOCK_ROWS, in_space, index_points, meet, numbered, pack, visit, wanting
from weftwork.operators.scan import number_rows
from weftwork.session import materialise, write_once

MAX_CENTRES = 10_000  # in one block
FIRST_SPLIT = 8  # sub-cells per cell side
PAIR_LIMIT = 10_000  # points of two sub-cells compared one by one


def fit_kmeans(df: DataFrame, k: int, n_init: int = 1, seed: int = 42, max_iter: int = 20):
    """The model of lowest cost among ``n_init`` seeded starts."""
    models = concurrently(df.sparkSession, lambda i: KMeans(k=k, seed=seed + i, maxIter=max_iter).fit(df), range(n_init))
    return min(models, key=lambda m: m.summary.trainingCost)


def elbow(df: DataFrame, ks: Sequence[int], seed: int = 42) -> DataFrame:
    """(k, cost): sum of squared distances to the centres; one cluster is the spread around the mean."""

    def cost(k: int) -> tuple[int, float]:
        if k == 1:
            v = vector_to_array(Summarizer.variance(F.col("features")))
            spread = df.agg(F.aggregate(v, F.lit(0.0), lambda a, x: a + x) * (F.count(F.lit(1)) - 1))
            return 1, float(spread.first()[0])
        return int(k), float(fit_kmeans(df, k, seed=seed).summary.trainingCost)

    return df.sparkSession.createDataFrame(concurrently(df.sparkSession, cost, list(ks)), "k int, cost double")


def fit_hierarchical(df: DataFrame, k: int, seed: int = 42):
    """Top-down tree of clusters cut at ``k`` leaves."""
    return BisectingKMeans(k=k, seed=seed).fit(df)


def assign_nearest(df: DataFrame, centres: DataFrame, id_col: str, features: str) -> DataFrame:
    """(id, cluster, distance) of the nearest centre (cluster, centre); ties to the smallest cluster.

    Centres travel as arrays, in blocks of bounded size, a pass over the rows for each.
    """
    packed = write_once(centres.select("cluster", F.col("centre").cast("array<double>").alias("m")))
    rows = df.select(id_col, F.col(features).cast("array<double>").alias("_x"))
    gap = lambda m: F.aggregate(F.zip_with(F.col("_x"), m, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, v: a + v)

    def step(block, first):
        near = F.array_min(F.transform(block, lambda c: F.struct(gap(c["m"]).alias("d"), c["cluster"].alias("cluster"))))
        return {"_b": near if first else F.least("_b", near)}

    return over_blocks(rows, packed, "cluster", step, MAX_CENTRES).select(id_col, F.col("_b.cluster").alias("cluster"), F.sqrt("_b.d").alias("distance"))


# ---- DBSCAN ------------------------------------------------------------------------------


def _offsets(dims: int) -> list[tuple[int, ...]]:
    """Cells whose points may lie within eps, the cell's diagonal being eps."""
    reach = math.ceil(math.sqrt(dims))
    near = []
    for o in itertools.product(range(-reach, reach + 1), repeat=dims):
        if sum(max(abs(v) - 1, 0) ** 2 for v in o) <= dims:  # box distance <= eps in units of the side
            near.append(o)
    return near


def _shifted(cell: str, offsets: Sequence[tuple[int, ...]]) -> Column:
    """The neighbouring cells of ``cell`` as an array of arrays."""
    steps = F.array(*[F.array(*[F.lit(v).cast("bigint") for v in o]) for o in offsets])
    return F.transform(steps, lambda o: F.zip_with(F.col(cell), o, lambda a, b: a + b))


def _sq_gap(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable over undirected ``edges`` (a, b).

    Labels are taken from neighbours and then from the label's own label, so the number of
    rounds grows with the logarithm of the longest path; each round is written out.
    """
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialise(nodes.select("node", F.col("node").alias("comp")))
    while True:
        offer = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("comp").alias("offer"))
        step = labels.join(offer, labels.node == offer.a, "left").select(
            "node", F.least("comp", F.coalesce("offer", "comp")).alias("next"), F.col("comp").alias("was")
        )
        step = materialise(step)
        jump = step.select(F.col("node").alias("_n"), F.col("next").alias("_far"))
        new = step.join(jump, step.next == jump._n).select("node", F.least("next", "_far").alias("comp"), "was")
        new = materialise(new)
        changed = new.filter("comp <> was").limit(1).count()
        labels = new.select("node", "comp")
        if not changed:
            return labels


def _touching_cells(core: DataFrame, offsets: Sequence[tuple[int, ...]], side: float, eps_sq: float, dims: int) -> DataFrame:
    """(a, b): neighbouring cells holding core points within eps of each other.

    The points of a cell are summed up in the boxes of sub-cells. Two boxes whose farthest
    corners are within eps connect their cells, two that are farther apart do not; undecided
    boxes are split further while they hold many points, and compared by points once they hold few.
    """
    scale = FIRST_SPLIT
    lows = F.array(*[F.min(F.col("x")[i]) for i in range(dims)]).alias("lo")
    highs = F.array(*[F.max(F.col("x")[i]) for i in range(dims)]).alias("hi")
    zero = F.lit(0.0)
    apart = sum((F.greatest(F.col("lb")[i] - F.col("ha")[i], F.col("la")[i] - F.col("hb")[i], zero) ** 2 for i in range(dims)), zero)
    widest = sum((F.greatest(F.col("hb")[i] - F.col("la")[i], F.col("ha")[i] - F.col("lb")[i]) ** 2 for i in range(dims)), zero)

    def split(points: DataFrame) -> DataFrame:
        return points.withColumn("sub", F.transform("x", lambda v: F.floor(v * scale / side).cast("bigint")))

    def boxes_of(points: DataFrame, *keys: str) -> DataFrame:
        return points.groupBy(*keys, "sub").agg(lows, highs, F.count(F.lit(1)).alias("n"))

    def sides(boxes: DataFrame, s: str, *keys: Column) -> DataFrame:
        return boxes.select(*keys, F.col("node").alias(s), F.col("sub").alias(f"s{s}"), F.col("lo").alias(f"l{s}"), F.col("hi").alias(f"h{s}"), F.col("n").alias(f"n{s}"))

    def judge(pairs: DataFrame) -> DataFrame:
        kept = pairs.withColumns({"near": apart, "wide": widest}).filter(F.col("near") <= eps_sq * (1 + 1e-9))
        return materialise(kept.select("a", "b", "sa", "sb", "na", "nb", (F.col("wide") <= eps_sq * (1 - 1e-9)).alias("sure")))

    points = materialise(split(core))
    boxes = materialise(boxes_of(points, "cell", "node"))
    half = [o for o in offsets if o > tuple([0] * dims)]
    judged = judge(sides(boxes, "a", F.explode(_shifted("cell", half)).alias("cell")).join(sides(boxes, "b", F.col("cell")), "cell"))
    found = judged.filter("sure").select("a", "b").distinct()
    while True:
        found = materialise(found)
        left = materialise(judged.filter(~F.col("sure")).join(found, ["a", "b"], "left_anti"))
        few = left.filter(F.col("na") * F.col("nb") <= PAIR_LIMIT)
        pa = points.select(F.col("node").alias("a"), F.col("sub").alias("sa"), F.col("x").alias("xa"))
        pb = points.select(F.col("node").alias("b"), F.col("sub").alias("sb"), F.col("x").alias("xb"))
        close = few.join(pa, ["a", "sa"]).join(pb, ["b", "sb"]).filter(_sq_gap(F.col("xa"), F.col("xb")) <= eps_sq)
        found = found.unionByName(close.select("a", "b").distinct()).distinct()
        many = left.filter(F.col("na") * F.col("nb") > PAIR_LIMIT)
        if not many.limit(1).count():
            return found
        wanted = many.select(F.col("a").alias("node"), F.col("sa").alias("sub")).unionByName(
            many.select(F.col("b").alias("node"), F.col("sb").alias("sub"))).distinct()
        inner = points.join(wanted, ["node", "sub"]).select("node", F.col("sub").alias("up"), "x")
        scale *= 2
        points = materialise(split(inner))
        boxes = materialise(boxes_of(points, "node", "up"))
        pairs = many.select("a", "b", F.col("sa").alias("ua"), F.col("sb").alias("ub"))
        judged = judge(pairs.join(sides(boxes, "a", F.col("up").alias("ua")), ["a", "ua"]).join(sides(boxes, "b", F.col("up").alias("ub")), ["b", "ub"]))
        found = found.unionByName(judged.filter("sure").select("a", "b")).distinct()


def dbscan(df: DataFrame, id_col: str, cols: Sequence[str] | str, eps: float, min_samples: int) -> DataFrame:
    """(id, cluster): density clusters, -1 for noise; a row's own copy counts as its neighbour.

    ``cols``: columns, or one array column. Clusters are numbered by their smallest core id; a border
    row joins the smallest cluster that reaches it. Ids are of any type with an order. Up to four
    columns, space is cut into a grid; more, or an array, are clustered on cells around pivots.
    """
    x = F.col(cols).cast("array<double>") if isinstance(cols, str) else F.array(*[F.col(c).cast("double") for c in cols])
    rows, name = numbered(df.select(id_col, x.alias("x")), id_col)
    rows = rows.select(F.col("key").alias("id"), "x")
    on_grid = not isinstance(cols, str) and len(cols) <= 4
    found = _dbscan_grid(rows, len(cols), eps, min_samples) if on_grid else _dbscan_cells(rows, eps, min_samples)
    return name(found, "id").select(F.col("id").alias(id_col), "cluster")


def _renumbered(rows: DataFrame, points: DataFrame, labelled: DataFrame, comps: DataFrame) -> DataFrame:
    """(id, cluster) of every row: the component of its point as a number from 0, or -1."""
    numbers = number_rows(comps.select("comp").distinct(), ["comp"], "cluster")
    by_point = points.select("id", "x").join(labelled, "id", "left").join(numbers, "comp", "left")
    by_point = by_point.select(F.col("x"), F.coalesce("cluster", F.lit(-1)).cast("bigint").alias("cluster"))
    return rows.join(by_point, "x").select("id", "cluster")


def _dbscan_grid(rows: DataFrame, dims: int, eps: float, min_samples: int) -> DataFrame:
    """On rows (id, x). Equal points are merged first. Cells have eps as diagonal, so points of one cell
    are neighbours and a cell of ``min_samples`` points is all core: pairs are only looked at for points
    of sparse cells. Whether two core cells touch is decided on the boxes of their sub-cells, and on
    points only where the boxes leave it open."""
    side = eps / math.sqrt(dims)
    offsets = _offsets(dims)
    eps_sq = float(eps) * float(eps)

    points = rows.groupBy("x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    points = points.withColumn("cell", F.transform("x", lambda v: F.floor(v / side).cast("bigint")))
    points = materialise(points)
    dense = points.groupBy("cell").agg((F.sum("n") >= min_samples).alias("dense"))
    points = materialise(points.join(dense, "cell"))

    # neighbours of points in sparse cells; a sparse cell has fewer than min_samples points
    sparse = points.filter(~F.col("dense")).select("id", "x", F.explode(_shifted("cell", offsets)).alias("cell"))
    there = points.select("cell", F.col("x").alias("y"), "n")
    counts = (
        sparse.join(there, "cell").filter(_sq_gap(F.col("x"), F.col("y")) <= eps_sq).groupBy("id").agg(F.sum("n").alias("around"))
    )
    cored = points.join(counts, "id", "left").withColumn("core", F.col("dense") | (F.coalesce("around", F.lit(0)) >= min_samples))
    cored = materialise(cored.select("id", "x", "cell", "core"))
    core = cored.filter("core").select("id", "x", "cell")

    # cells with core points are nodes, named by their smallest core id
    cells = materialise(core.groupBy("cell").agg(F.min("id").alias("node")))
    edges = _touching_cells(core.join(cells, "cell").select("node", "cell", "x"), offsets, side, eps_sq, dims)
    comps = connected_components(cells.select("node"), edges)
    placed = materialise(cells.join(comps, "node").select("cell", "comp"))
    core_label = core.join(placed, "cell").select("id", "x", "cell", "comp")
    border = cored.filter(~F.col("core")).select("id", "x", F.explode(_shifted("cell", offsets)).alias("cell"))
    reach = core_label.select("cell", F.col("x").alias("y"), "comp")
    edge_label = border.join(reach, "cell").filter(_sq_gap(F.col("x"), F.col("y")) <= eps_sq).groupBy("id").agg(F.min("comp").alias("comp"))
    labelled = core_label.select("id", "comp").unionByName(edge_label)
    return _renumbered(rows, cored, labelled, placed)


# ---- DBSCAN in any number of dimensions --------------------------------------------------


def _links(near: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a forest with the same components as the pairs of nodes ``near`` marks: every node that
    has a pair, to the least node it reaches."""
    rows, cols = near.any(1), near.any(0)
    near, a, b = near[rows][:, cols], a[rows], b[cols]
    if not near.size:
        return a, a
    top = np.iinfo(np.int64).max
    left, right = a.copy(), b.copy()
    while True:
        new_right = np.minimum(right, np.where(near, left[:, None], top).min(0))
        new_left = np.minimum(left, np.where(near, new_right[None, :], top).min(1))
        if (new_left == left).all() and (new_right == right).all():
            return np.concatenate([a, b]), np.concatenate([left, right])
        left, right = new_left, new_right


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes in order, the least node each reaches) over edges between numbered nodes."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while (label[a] != label[b]).any():
        a_root, b_root = label[a], label[b]
        low = np.minimum(a_root, b_root)
        np.minimum.at(label, a_root, low)
        np.minimum.at(label, b_root, low)
        while ((hop := label[label]) != label).any():
            label = hop
    return nodes, nodes[label]


def _dbscan_cells(rows: DataFrame, eps: float, min_samples: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """On rows (id, x). Equal points are merged first and assigned to the leaves of a pivot index. A point
    meets the leaves that reach within eps of it; one that leaves within eps as a whole make core is not
    compared with their points. A leaf no wider than eps with ``min_samples`` points is all core and one
    node. Core points that meet link their nodes, a task giving a forest and never all pairs; the
    components of the nodes are the clusters."""
    points = rows.groupBy("x").agg(F.min("id").alias("key"), F.count(F.lit(1)).alias("n"))
    points, leaves = index_points(write_once(points), 2, block_rows, fine=eps / 2)
    dense = (2 * leaves.radius <= eps * (1 - 1e-9)) & (leaves.count >= min_samples)
    spark = rows.sparkSession
    flags = spark.createDataFrame([(i, bool(v)) for i, v in enumerate(dense)], "leaf int, dense boolean")
    points = materialise(points.join(F.broadcast(flags), "leaf"))  # one row per leaf
    near_pairs = lambda a, b: _near(a, b, eps)

    def sure(d, arrays, here):
        whole = (d + here.radius <= eps) & (here.count > 0)
        q = np.flatnonzero(whole.any(1))
        return q, np.zeros(len(q), np.int32), (whole * here.count)[q].sum(1).astype(np.int64)

    # counts of points that no dense leaf makes core
    asked = points.filter("not dense").select("key", "x", "leaf")
    certain = visit(asked.select("key", "x"), leaves, ["key"], sure, "around bigint").select("key", "around")
    certain = materialise(certain)
    open_ = materialise(asked.join(certain.filter(F.col("around") >= min_samples), "key", "left_anti"))

    order = in_space(leaves.pivots)
    rank = np.argsort(order)
    there = pack(points, ["key", "n"], leaves, order, block_rows)

    def within(d, arrays, here):
        return d - here.radius <= eps

    class Count:
        """Points within eps of each query."""

        x = None

        def ask(self, x, ours):
            found, self.x, self.key, self.n = self.end(), x, ours["key"], np.zeros(len(x), np.int64)
            return found

        def meet(self, b, theirs):
            self.n += near_pairs(self.x, b) @ theirs["n"]

        def end(self):
            import pyarrow as pa

            return None if self.x is None else pa.RecordBatch.from_arrays([pa.array(self.key), pa.array(self.n)], names=["key", "around"])

    unsure = pack(open_, ["key"], leaves, order, block_rows, there.parts)
    counted = meet(wanting(unsure, ["key"], leaves, there, within), there, ["key"], ["n"], Count, "key bigint, around bigint")
    certain = certain.filter(F.col("around") >= min_samples)  # the others have been counted whole
    core_keys = certain.unionByName(counted).groupBy("key").agg(F.sum("around").alias("around")).filter(F.col("around") >= min_samples).select("key")
    core_keys = core_keys.unionByName(points.filter("dense").select("key"))
    core = points.join(core_keys, "key").withColumnRenamed("leaf", "home")
    named = core.groupBy("home").agg(F.min("key").alias("least"))
    core = materialise(core.join(F.broadcast(named), "home").withColumn("node", F.when(F.col("dense"), F.col("least")).otherwise(F.col("key"))))
    node_of = {r["home"]: r["least"] for r in named.filter(F.col("home").isin([int(i) for i in np.flatnonzero(dense)])).collect()} if dense.any() else {}
    nodes = np.array([node_of.get(i, -1) for i in range(len(dense))], np.int64)  # of dense leaves

    # links: each pair of leaves is met from the later one; leaves that lie within reach as a whole are
    # linked without looking at their points
    def sure_links(d, arrays, here):
        if not dense.any():
            return np.zeros(d.shape, bool)
        homes, at = np.unique(arrays["home"], return_inverse=True)
        gap = np.sqrt(np.maximum((here.pivots[homes] ** 2).sum(1)[:, None] + (here.pivots**2).sum(1)[None, :] - 2 * here.pivots[homes] @ here.pivots.T, 0))
        joined = (dense[homes][:, None] & dense[None, :] & (gap + here.radius[homes][:, None] + here.radius[None, :] <= eps))[at]
        return (dense[None, :] & (here.count > 0)[None, :]) & (joined | (d + here.radius <= eps))

    def touching(d, arrays, here):
        home = arrays["home"][:, None]
        own = dense[None, :] & (np.arange(len(here.count))[None, :] == home)
        return (rank[None, :] <= rank[home]) & ~own & (d - here.radius <= eps) & ~sure_links(d, arrays, here)

    def linked(d, arrays, here):
        sure = sure_links(d, arrays, here)
        a, b = _links(sure[:, dense], arrays["node"], nodes[dense])
        return np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), a, b

    class Link:
        """A forest that links the nodes of all points within eps that a task has met."""

        def __init__(self):
            self.nodes, self.least = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def ask(self, x, ours):
            self.x, self.node = x, ours["node"]

        def reached(self, node):
            if not len(self.nodes):
                return node
            i = np.minimum(np.searchsorted(self.nodes, node), len(self.nodes) - 1)
            return np.where(self.nodes[i] == node, self.least[i], node)

        def meet(self, b, theirs):
            mine, other = self.reached(self.node), self.reached(theirs["node"])
            if mine.min() == mine.max() == other.min() == other.max():
                return  # one component already
            u, v = _links(near_pairs(self.x, b), mine, other)
            if (u != v).any():
                self.nodes, self.least = forest(np.concatenate([self.nodes, u]), np.concatenate([self.least, v]))

        def end(self):
            import pyarrow as pa

            return pa.RecordBatch.from_arrays([pa.array(self.nodes), pa.array(self.least)], names=["a", "b"])

    cored = core.select(F.col("home").alias("leaf"), "x", "key", "home", "node")
    members = pack(cored, ["key", "home", "node"], leaves, order, block_rows)
    seekers = pack(cored, ["home", "node"], leaves, order, block_rows, members.parts)
    edges = meet(wanting(seekers, ["home", "node"], leaves, members, touching), members, ["home", "node"], ["node"], Link, "a bigint, b bigint")
    if dense.any():
        known = visit(core.select("x", "home", "node"), leaves, ["home", "node"], linked, "a bigint, b bigint")
        edges = edges.unionByName(known.select("a", "b"))
    edges = edges.filter("a <> b").distinct()
    comps = materialise(connected_components(core.select("node").distinct(), materialise(edges)))
    placed = core.join(comps, "node").select(F.col("key").alias("id"), F.col("home").alias("leaf"), "x", "comp")
    placed = materialise(placed)

    # border points
    border = points.join(core.select("key"), "key", "left_anti").select("leaf", "x", "key")

    class Smallest:
        """The smallest component that reaches each query."""

        x = None

        def ask(self, x, ours):
            found, self.x, self.key, self.comp = self.end(), x, ours["key"], np.full(len(x), np.iinfo(np.int64).max)
            return found

        def meet(self, b, theirs):
            near = near_pairs(self.x, b)
            some = np.flatnonzero(near.any(1))
            if len(some):
                self.comp[some] = np.minimum(self.comp[some], np.where(near[some], theirs["comp"][None, :], np.iinfo(np.int64).max).min(1))

        def end(self):
            import pyarrow as pa

            if self.x is None:
                return None
            some = self.comp < np.iinfo(np.int64).max
            return pa.RecordBatch.from_arrays([pa.array(self.key[some]), pa.array(self.comp[some])], names=["id", "comp"])

    clustered = pack(placed, ["comp"], leaves, order, block_rows)
    outside = pack(border, ["key"], leaves, order, block_rows, clustered.parts)
    reached = meet(wanting(outside, ["key"], leaves, clustered, within), clustered, ["key"], ["comp"], Smallest, "id bigint, comp bigint")
    reached = materialise(reached.groupBy("id").agg(F.min("comp").alias("comp")))  # so that chunks meet once
    labelled = placed.select("id", "comp").unionByName(reached)
    return _renumbered(rows, points.select(F.col("key").alias("id"), "x"), labelled, comps)


def _near(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Whether rows of the two matrices are within eps, decided by the plain sum of squares where the
    matrix form is in doubt."""
    sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
    limit = float(eps) * float(eps)
    out = sq <= limit
    doubt = 1e-9 * (1.0 + (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :])
    q, c = np.nonzero(np.abs(sq - limit) <= doubt)
    out[q, c] = ((a[q] - b[c]) ** 2).sum(1) <= limit
    return out
