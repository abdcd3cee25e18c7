"""The conversation trie against a plain recursion over Python tuples."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from weftwork.llm.prefix_trie import decompose, joined_digest, prefix_trie, turn_digests, with_heads

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def order(row):
    _, turn, role, text = row
    raw = f"{len((role or '').encode())}:{role or ''}:{text or ''}"
    return (turn is not None, turn or 0, hashlib.md5(raw.encode()).hexdigest())


def brute(rows):
    """{(smallest member, depth): the other columns}."""
    own = defaultdict(list)
    for row in rows:
        if row[0] is not None:
            own[row[0]].append(row)
    own = {c: [(r[2] or "", r[3] or "") for r in sorted(v, key=order)] for c, v in own.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    built = {c: own.get(c - c % 100, [])[: heads[c]] + v[heads[c] :] for c, v in own.items()}
    nodes, kids = defaultdict(list), defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    sums, out = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        leaves = sum(sums[q][0] for q in kids[k]) if kids[k] else 1
        saved = sum(sums[q][1] for q in kids[k]) + (len(nodes[k]) - 1) * (len(k[-1][1]) if k else 0)
        sums[k] = leaves, saved
        ends = ",".join(str(c) for c in sorted(nodes[k]) if len(built[c]) == len(k))
        parent = min(nodes[k[:-1]]) if k else None
        out[min(nodes[k]), len(k)] = (parent, len(nodes[k]), len(kids[k]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def trie(spark, rows, block=32_768):
    turns, convs = with_heads(turn_digests(spark.createDataFrame(rows, SCHEMA)))
    return {(r[0], r[1]): tuple(r[2:]) for r in prefix_trie(turns, convs, block).collect()}


def test_decompose_equals_plain_sums():
    rng = np.random.default_rng(3)
    for n, reach in [(1, 1), (60, 1), (300, 3), (400, 400)]:  # reach 1 is one long chain
        parent = np.array([-1] + [int(rng.integers(max(0, i - reach), i)) for i in range(1, n)])
        parent[rng.random(n) < 0.02] = -1
        depth, values = np.zeros(n, int), rng.integers(0, 9, (n, 2))
        own, whole = rng.integers(1, 50, n), values.copy()
        for i in range(n):
            depth[i] = depth[parent[i]] + 1 if parent[i] >= 0 else 0
        weight = own.copy()
        for i in reversed(range(n)):
            if parent[i] >= 0:
                whole[parent[i]] += whole[i]
                weight[parent[i]] += weight[i]
        shuffled = rng.permutation(n)
        place = np.argsort(shuffled)
        moved = np.where(parent[shuffled] >= 0, place[parent[shuffled]], -1)
        assert (decompose(moved, depth[shuffled], weight[shuffled], values[shuffled]) == whole[shuffled]).all()


@pytest.mark.parametrize("block", [32_768, 7])
def test_trie_of_hot_deep_and_odd_conversations(spark, block):
    rows = [(c, t, "user" if t % 2 else None, "hello" if t < 2 else f"x{c % 3}") for c in range(100, 130) for t in range(c % 7)]
    rows += [(200 + c, t, "user", "same") for c in range(12) for t in range(4)]  # copies, and prefixes of one another
    rows += [(305, t, "user", f"deep {t}") for t in range(60)] + [(306, t, "user", f"deep {t}" if t < 50 else "other") for t in range(60)]
    rows += [(417, None, "user", "null turn"), (417, 3, None, None), (417, 3, "", ""), (417, 3, "", "é" * 5000), (None, 1, "user", "no conversation")]
    assert trie(spark, rows, block) == brute(rows)


def test_empty_table_and_conversations_without_turns(spark):
    assert trie(spark, []) == {}
    rows = [(c, 0, "user", "one") for c in (1, 2, 3, 101)]  # no base conversation, so heads are lost
    assert trie(spark, rows) == brute(rows)


def test_sampled_table(spark, root):
    rows = [tuple(r) for r in spark.read.parquet(f"{root}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert trie(spark, rows, 16) == brute(rows)


def test_extra_columns_with_clashing_names(spark):
    from pyspark.sql import functions as F

    rows = [(100, 0, "user", "a"), (101, 0, "user", "a")]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("pos", "digest", "chars", "conv", "_range", "depth"):
        df = df.withColumn(name, F.lit("clash"))
    turns, convs = with_heads(turn_digests(df))
    assert {(r[0], r[1]): tuple(r[2:]) for r in prefix_trie(turns, convs).collect()} == brute(rows)


def test_digest_of_a_group_in_pieces(spark):
    rows = spark.range(1000).selectExpr("id % 3 as k", "id as n")
    found = {r["k"]: r["sha256"] for r in joined_digest(rows, ["k"], "n", piece=7).collect()}
    assert found == {k: hashlib.sha256(",".join(str(n) for n in range(k, 1000, 3)).encode()).hexdigest() for k in range(3)}
