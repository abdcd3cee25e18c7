"""The trie of the shared beginnings of conversations, rolled up by centroid decomposition.

A node is a distinct sequence of first turns. Prefixes are told apart by their length and 128 bits:
the exclusive or, over the turns, of hashes that hold the turn and its place, a running value that
``prefix_scan`` computes without ever holding a conversation. A node is named by its smallest member
and its depth, so (conversation, depth) leads to a node by a plain join.

Sums over subtrees come from a centroid decomposition of the parent edges. What a node's subtree
weighs in turns, copies included, is known from the grouping that makes the nodes; a component's
nodes that weigh over half of it are the path from its top to its centroid. What the component has
at or below the centroid is added to every node of that path, the centroid goes, and the subtrees
below it and the rest above go on as components of at most half the weight. So a node is handled in
as many rounds as the logarithm of the turns, whatever the depth, and each pair of a node and one
below it meets exactly once. Components of many nodes are split by joins, one round for all; those
of at most ``block`` nodes are dealt to tasks and finished there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from weftwork.functions.frame import one_row
from weftwork.operators.scan import number_rows, prefix_scan
from weftwork.session import materialise, write_once

#: Nodes of a component that one task finishes.
BLOCK = 32_768
#: Ids joined to one text, of the ids hashed for a node.
PIECE = 50_000
_NO_IDS = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of nothing


def turn_digests(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, digest, chars): turns numbered from 1 in their conversation, a digest of role and
    text, and the code points of the text. Rows without a conversation are left out; a null role or
    text is empty; a null turn comes first; turns of one number are ordered by digest."""
    role_, text_ = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = conversations.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv"),
        F.col(turn).alias("turn"),
        F.md5(F.concat_ws(":", F.octet_length(role_), role_, text_)).alias("digest"),
        F.char_length(text_).cast("bigint").alias("chars"),
    )
    return number_rows(rows, [F.col("turn").asc_nulls_first(), "digest"], "pos", by=["conv"], start=1).drop("turn")


def with_heads(turns: DataFrame, base: str = "conv - conv % 100", heads: str = "crc32(cast(cast(conv as string) as binary)) % 6", most: int = 5) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) of conversations rebuilt to begin alike: the first ``heads`` turns of
    conversation ``base``, then the own turns after as many. Both are SQL expressions of ``conv``;
    ``most`` is the largest number of heads. The second result lists all conversations, those
    without a turn included."""
    turns = write_once(turns)
    convs = turns.groupBy("conv").agg(F.max("pos").alias("own")).withColumns({"base": F.expr(base).cast("bigint"), "h": F.expr(heads).cast("bigint")})
    lengths = convs.select(F.col("conv").alias("base"), F.col("own").alias("base_own"))
    convs = write_once(convs.join(lengths, "base", "left").withColumn("got", F.least("h", F.coalesce("base_own", F.lit(0)))))
    first = turns.filter(F.col("pos") <= most).withColumnRenamed("conv", "base")
    taken = convs.select("conv", "base", "h").join(first, "base").filter("pos <= h").select("conv", "pos", "digest", "chars")
    kept = turns.join(convs.select("conv", "h", "got"), "conv").filter("pos > h")
    rest = kept.select("conv", (F.col("pos") - F.col("h") + F.col("got")).alias("pos"), "digest", "chars")
    return taken.unionByName(rest), convs.select("conv")


# ---- nodes -------------------------------------------------------------------------------


def _prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, a, b, pa, pb, chars): a row for every conversation and depth with the key of
    its prefix and of the prefix before."""
    keyed = turns.withColumns({"ha": F.xxhash64("pos", "digest"), "hb": F.xxhash64("digest", F.lit("b"), "pos")})
    scanned = prefix_scan(keyed.drop("digest"), ["pos"], {"a": ("xor", "ha", True), "b": ("xor", "hb", True)}, by=["conv"])
    before = lambda c, h: F.col(c).bitwiseXOR(F.col(h))
    return scanned.select("conv", F.col("pos").alias("depth"), "a", "b", before("a", "ha").alias("pa"), before("b", "hb").alias("pb"), "chars")


def joined_digest(rows: DataFrame, keys: Sequence[str], number: str, piece: int = PIECE) -> DataFrame:
    """(keys, sha256): the SHA-256 of each group's numbers, ascending, in decimal, joined by commas.
    Groups of any size: sorted over ranges, joined to pieces there, and the pieces of a group are
    then hashed one after the other as they stream by."""
    kinds = ", ".join(f"{k} bigint" for k in keys)
    rows = rows.select(*[F.col(k).cast("bigint") for k in keys], F.col(number).cast("bigint").alias("_n"))

    def pieces(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                new = (pdf[list(keys)].diff() != 0).any(axis=1).to_numpy()
                at = np.flatnonzero(new | (np.arange(len(pdf)) % piece == 0))
                text = pdf["_n"].astype(str).to_numpy()
                joined = [",".join(text[i:j]) for i, j in zip(at, [*at[1:], len(pdf)])]
                yield pdf.iloc[at].assign(_text=joined)

    ranged = rows.repartitionByRange(*keys, "_n").sortWithinPartitions(*keys, "_n")
    parts = ranged.mapInPandas(pieces, f"{kinds}, _n bigint, _text string")

    def hashed(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        now, state = None, None
        for pdf in it:
            done = []
            for *key, _, text in pdf[[*keys, "_n", "_text"]].itertuples(index=False, name=None):
                if key != now:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield pd.DataFrame(done, columns=[*keys, "sha256"])
        if now is not None:
            yield pd.DataFrame([(*now, state.hexdigest())], columns=[*keys, "sha256"])

    dealt = parts.repartition(*keys).sortWithinPartitions(*keys, "_n")
    return dealt.mapInPandas(hashed, f"{kinds}, sha256 string")


# ---- centroid decomposition --------------------------------------------------------------


def _preorder(parent: list[int], order: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(place of each node in a depth-first order, last place of its subtree); ``order`` goes down
    by depth and ``parent`` is -1 at the tops."""
    size = [1] * len(parent)
    for i in reversed(order):
        if parent[i] >= 0:
            size[parent[i]] += size[i]
    place, free, top = [0] * len(parent), [0] * len(parent), 0
    for i in order:
        if parent[i] >= 0:
            place[i] = free[parent[i]]
            free[parent[i]] += size[i]
        else:
            place[i] = top
            top += size[i]
        free[i] = place[i] + 1
    at = np.array(place)
    return at, at + np.array(size) - 1


def decompose(parent: np.ndarray, depth: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (nodes x columns) over the subtree of every node of some trees, by centroid
    decomposition of all of them at once. ``weight``: what the subtree of a node weighs, more than
    its children's together; ``parent`` is -1 at the tops."""
    n = len(parent)
    place, last = _preorder(parent.tolist(), np.argsort(depth, kind="stable").tolist())
    order = np.argsort(place)
    up = np.where(parent[order] >= 0, place[parent[order]], -1)
    end, w, own = last[order], weight[order].astype(np.int64).copy(), values[order]
    sums = np.zeros_like(own)
    top = np.maximum.accumulate(np.where(up < 0, np.arange(n), 0))
    live = np.arange(n)
    while len(live):
        live = live[np.argsort(top[live], kind="stable")]  # by component, depth-first in each
        comp = top[live]
        path = 2 * w[live] > w[comp]
        centroid = np.zeros(n, np.int64)
        np.maximum.at(centroid, comp[path], live[path])
        c = centroid[comp]
        below = (live >= c) & (live <= end[c])
        for k in range(own.shape[1]):
            total = np.zeros(n, own.dtype)
            np.add.at(total, comp[below], own[live[below], k])
            sums[live[path], k] += total[comp[path]]
        w[live[path]] -= np.where(live[path] == c[path], 0, w[c[path]])
        child = np.maximum.accumulate(np.where(up[live] == c, np.arange(len(live)), 0))
        under = below & (live != c)
        top[live[under]] = live[child[under]]
        live = live[live != c]
    out = np.empty_like(sums)
    out[order] = sums
    return out


def _finish(blocks: DataFrame, values: Sequence[str]) -> DataFrame:
    """Components of bounded size, several at a time, in the tasks they are dealt to."""
    sums = [f"sum_{v}" for v in values]
    schema = ", ".join(["conv bigint", "depth bigint", *[f"{s} bigint" for s in sums]])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        here = pdf[["top_conv", "top_depth", "conv", "depth"]].assign(_at=np.arange(len(pdf)))
        above = pdf[["top_conv", "top_depth"]].assign(conv=pdf["up"], depth=pdf["depth"] - 1)
        parent = above.merge(here, "left", ["top_conv", "top_depth", "conv", "depth"])["_at"].fillna(-1).to_numpy(np.int64)
        parent[(pdf["conv"] == pdf["top_conv"]) & (pdf["depth"] == pdf["top_depth"])] = -1
        found = decompose(parent, pdf["depth"].to_numpy(), pdf["weight"].to_numpy(), pdf[list(values)].to_numpy(np.int64))
        out = pdf[["conv", "depth"]].copy()
        for k, s in enumerate(sums):
            out[s] = pdf[s] + found[:, k]
        return out

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for pdf in it:
            if not len(pdf):
                continue
            last = (pdf["top_conv"] == pdf["top_conv"].iloc[-1]) & (pdf["top_depth"] == pdf["top_depth"].iloc[-1])
            if last.all() and (not rest or (rest[0][["top_conv", "top_depth"]].iloc[0] == pdf[["top_conv", "top_depth"]].iloc[0]).all()):
                rest.append(pdf)  # the component may go on
                continue
            whole = pd.concat([*rest, pdf[~last]])
            rest = [pdf[last]]
            yield solve(whole)
        if rest:
            yield solve(pd.concat(rest))

    dealt = blocks.repartition("top_conv", "top_depth").sortWithinPartitions("top_conv", "top_depth", "depth", "conv")
    return dealt.mapInPandas(batches, schema)


def rollup(nodes: DataFrame, paths: DataFrame, values: Sequence[str], block: int = BLOCK) -> DataFrame:
    """(conv, depth, sum_<value>...): sums of ``values`` over the subtree of every node.

    ``nodes``: conv, depth, up (conv of the parent at depth - 1), weight, and the values. ``paths``:
    (conv, depth, node, up) for every conversation that names a node: the node it passes at each
    depth and the one before.
    """
    sums = [f"sum_{v}" for v in values]
    root = one_row(nodes.filter("depth = 0").agg(F.min("conv").alias("conv")))["conv"]
    zero = F.lit(0).cast("bigint")
    live = nodes.select("conv", "depth", "up", "weight", *values, *[zero.alias(s) for s in sums], zero.alias("top_depth"), root.alias("top_conv"))
    steps = paths.select(F.col("conv").alias("_conv"), F.col("depth").alias("_depth"), F.col("node").alias("_node"), F.col("up").alias("_up"))
    comp = ["top_conv", "top_depth"]
    small, done = [], []
    while True:
        live = write_once(live) if not done else live
        comps = materialise(live.groupBy(*comp).agg(F.count(F.lit(1)).alias("_nodes"), F.max("weight").alias("_whole")))
        large = comps.filter(F.col("_nodes") > block).drop("_nodes")
        small.append(live.join(comps.filter(F.col("_nodes") <= block).select(*comp), comp))
        if not large.limit(1).count():
            break
        weighed = live.join(large, comp)
        path = F.col("weight") * 2 > F.col("_whole")
        deepest = weighed.filter(path).groupBy(*comp).agg(F.max(F.struct("depth", "conv", "weight")).alias("_c"))
        split = weighed.withColumn("_path", path).join(deepest, comp)
        split = split.join(steps, (F.col("conv") == F.col("_conv")) & (F.col("_c.depth") + 1 == F.col("_depth")), "left")
        here = (F.col("conv") == F.col("_c.conv")) & (F.col("depth") == F.col("_c.depth"))
        under = F.coalesce(F.col("_up") == F.col("_c.conv"), F.lit(False)) & (F.col("depth") > F.col("_c.depth"))
        split = split.withColumns({"_here": here, "_under": under})
        split = write_once(split.select(
            *[c for c in live.columns if c != "weight"],
            F.when(F.col("_path") & ~F.col("_here"), F.col("weight") - F.col("_c.weight")).otherwise(F.col("weight")).alias("weight"),
            "_path", "_here", "_under", "_node", (F.col("_c.depth") + 1).alias("_below"),
        ))
        totals = materialise(split.filter("_here or _under").groupBy(*comp).agg(*[F.sum(v).alias(f"_t_{v}") for v in values]))
        # only nodes on a path get a total
        raised = split.filter("_path").join(totals, comp).withColumns({f"sum_{v}": F.col(f"sum_{v}") + F.col(f"_t_{v}") for v in values})
        raised = raised.select(*split.columns).unionByName(split.filter("not _path"))
        done.append(raised.filter("_here").select("conv", "depth", *sums))
        into = {"top_conv": F.when(F.col("_under"), F.col("_node")).otherwise(F.col("top_conv")), "top_depth": F.when(F.col("_under"), F.col("_below")).otherwise(F.col("top_depth"))}
        live = raised.filter("not _here").withColumns(into).select(*live.columns)
    left = small[0]
    for more in small[1:]:
        left = left.unionByName(more)
    out = _finish(left, values)
    for more in done:
        out = out.unionByName(more)
    return out


# ---- the trie ----------------------------------------------------------------------------


def prefix_trie(turns: DataFrame, conversations: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs,
    n_children, n_leaves, saved_tokens (code points that members share, summed over the subtree) and
    ends_sha256 (of the conversations that end there, see ``joined_digest``).

    ``turns``: (conv, pos, digest, chars) as ``turn_digests`` gives, positions from 1 without gaps.
    ``conversations`` lists those without turns too (else the ones that have some); they belong to the
    root. Without any conversation there is no node. Conversations that repeat others are members of
    the same nodes; conversations and turns may be of any number and length, texts too.
    """
    rows = write_once(_prefixes(turns))
    if conversations is None:
        conversations = rows.select("conv").distinct()
    lengths = rows.groupBy("conv").agg(F.max("depth").alias("length"))
    convs = write_once(conversations.distinct().join(lengths, "conv", "left").select("conv", F.coalesce("length", F.lit(0)).cast("bigint").alias("length")))
    counted = rows.join(convs, "conv").groupBy("depth", "a", "b").agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("length") - F.col("depth") + 1).alias("weight"),
        F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("chars").alias("chars"),
    )
    zero = F.lit(0).cast("bigint")
    root = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("length") + 1).alias("weight")).filter("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv", "n_convs", "weight", zero.alias("pa"), zero.alias("pb"), zero.alias("chars"))
    found = write_once(counted.unionByName(root))
    above = found.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv").alias("up"))
    linked = write_once(found.join(above, ["depth", "pa", "pb"], "left"))
    children = linked.filter("depth > 0").groupBy(F.col("up").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = linked.join(children, ["conv", "depth"], "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("bigint"), "saved": (F.col("n_convs") - 1) * F.col("chars")})
    nodes = write_once(nodes)

    naming = nodes.select("conv").distinct()
    named = rows.join(naming, "conv", "left_semi").select("conv", "depth", "a", "b")
    paths = named.join(linked.select("depth", "a", "b", F.col("conv").alias("node"), "up"), ["depth", "a", "b"]).select("conv", "depth", "node", "up")
    summed = rollup(nodes.select("conv", "depth", "up", "weight", "leaf", "saved"), paths, ["leaf", "saved"], block)

    ends = rows.join(convs, "conv").filter("depth = length").select("depth", "a", "b", "conv")
    ends = ends.unionByName(convs.filter("length = 0").select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv"))
    hashes = joined_digest(ends, ["depth", "a", "b"], "conv")
    out = nodes.join(summed, ["conv", "depth"]).join(hashes, ["depth", "a", "b"], "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children",
        F.col("sum_leaf").alias("n_leaves"), F.col("sum_saved").alias("saved_tokens"), F.coalesce("sha256", F.lit(_NO_IDS)).alias("ends_sha256"),
    )
