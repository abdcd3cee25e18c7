"""Near duplicates by SimHash fingerprints, with pigeonring candidate filtering.

A fingerprint is cut into m = max_bits + 1 segments on a ring. Of two fingerprints that differ in
at most max_bits bits, some chain of consecutive segments keeps every prefix within its share: the
first l segments differ in at most floor(l * max_bits / m) bits. So the first segment is equal and
the second differs in one bit at most, which leaves one of its halves equal: (segment, half of the
next) is the signature that candidates meet on. Candidates that break a later budget of the chain
are pruned before all 64 bits are compared.

A signature shared by more than ``BUCKET`` distinct fingerprints yields no pairs. There, every
fingerprint visits the points one bit away from it in the bits the signature leaves free: two of
them meet in such a point exactly if they differ in at most two bits, and each links to the least
fingerprint it meets. That is exact for max_bits <= 2 and linear in the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from weftwork.llm.chunks import without
from weftwork.llm.components import components
from weftwork.session import write_once

#: Distinct fingerprints of a signature that are still compared pair by pair.
BUCKET = 64
#: Shingles hashed at a time, which bounds a task's memory for a text of any length.
BLOCK = 1 << 15


def _votes(text: bytes, words: int, seed: int = 42):
    """How many shingles of a text set each bit, and the number of shingles."""
    import numpy as np
    import xxhash

    parts = text.lower().split()
    if not parts:
        return None, 0
    width = min(words, len(parts))
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    joined, starts, ends = b" ".join(parts), (ends - sizes)[: len(parts) - width + 1].tolist(), ends[width - 1 :].tolist()
    votes, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for at in range(0, len(starts), BLOCK):
        hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])])
        votes += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return votes, len(starts)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): the 64-bit fingerprint as a long. Null or blank text: fingerprint zero."""

    def batches(it: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in it:
            out = np.zeros(batch.num_rows, np.int64)
            for i, t in enumerate(batch.column(1)):
                votes, n = _votes(t.as_py() or b"", words)
                if n:
                    out[i] = int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big", signed=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(batches, f"id {kind}, fp bigint")


def _segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of the segments of the ring."""
    m = max_bits + 1
    cuts = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _cut(fp: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))


def _halves(at: int, width: int) -> list[tuple[int, int]]:
    return [(at, width // 2), (at + width // 2, width - width // 2)]


def _signatures(fps: DataFrame, max_bits: int) -> DataFrame:
    """(fp, chain, half, sig): the keys on which candidates meet."""
    ring, keys = _segments(max_bits), []
    for i, (at, width) in enumerate(ring):
        for h, (b, w) in enumerate(_halves(*ring[(i + 1) % len(ring)])):
            keys.append(F.struct(F.lit(i).alias("chain"), F.lit(h).alias("half"), F.xxhash64(F.lit(i), F.lit(h), _cut(F.col("fp"), at, width), _cut(F.col("fp"), b, w)).alias("sig")))
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.*")


def _chain_holds(x: Column, max_bits: int) -> Column:
    """Whether the chain that starts at ``chain`` keeps every prefix within its budget."""
    ring = _segments(max_bits)
    m, any_chain = len(ring), F.lit(False)
    for i in range(m):
        total, ok = F.lit(0), F.col("chain") == i
        for length in range(1, m + 1):
            at, width = ring[(i + length - 1) % m]
            total = total + F.bit_count(_cut(x, at, width))
            ok = ok & (total <= length * max_bits // m)
        any_chain = any_chain | ok
    return any_chain


def _free_bits(max_bits: int) -> Column:
    """The bits that a signature leaves free, as an array of masks chosen by (chain, half)."""
    ring, choice = _segments(max_bits), None
    for i, (at, width) in enumerate(ring):
        for h, (b, w) in enumerate(_halves(*ring[(i + 1) % len(ring)])):
            fixed = {*range(at, at + width), *range(b, b + w)}
            masks = F.array(F.lit(0).cast("long"), *[F.lit((1 << k) - (1 << 64 if k == 63 else 0)) for k in range(64) if k not in fixed])
            hit = (F.col("chain") == i) & (F.col("half") == h)
            choice = F.when(hit, masks) if choice is None else choice.when(hit, masks)
    return choice


def links(fps: DataFrame, max_bits: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that differ in at most ``max_bits`` bits; their
    transitive closure is that of all such pairs."""
    if not 1 <= max_bits <= 2:
        raise ValueError("max_bits must be 1 or 2")
    sigs = _signatures(fps, max_bits)
    sizes = sigs.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = write_once(sigs.join(sizes, "sig"))

    few = shared.filter(F.col("n") <= bucket)
    pairs = few.select("sig", "chain", F.col("fp").alias("a")).join(few.select("sig", F.col("fp").alias("b")), "sig").filter("a > b")
    x = F.col("a").bitwiseXOR(F.col("b"))
    near = pairs.filter(_chain_holds(x, max_bits)).filter(F.bit_count(x) <= max_bits).select("a", "b")

    reach = F.transform(_free_bits(max_bits), lambda m: F.col("fp").bitwiseXOR(m)) if max_bits == 2 else F.array("fp")
    points = shared.filter(F.col("n") > bucket).select("sig", "fp", F.explode(reach).alias("z"))
    if max_bits == 1:  # a point is shared by the fingerprint itself and those one bit away from it
        points = points.select("sig", "fp", "z").union(
            shared.filter(F.col("n") > bucket).select("sig", "fp", F.explode(F.transform(_free_bits(max_bits), lambda m: F.col("fp").bitwiseXOR(m))).alias("z")).filter("z < fp")
        ).distinct()
    least = points.groupBy("sig", "z").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = points.join(least, ["sig", "z"]).select(F.col("fp").alias("a"), "b").filter("a <> b")
    return near.union(met.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per row of ``docs``: id, ``fp`` and ``component_id``, the least id that links reach.

    Null and blank texts have fingerprint zero and link like any other. Equal fingerprints are one
    class, whatever its size; links join classes. A null id belongs to a component but never names
    one unless it has no other id.
    """
    rows = write_once(fingerprints(docs, id_col, text_col, words))
    classes = rows.groupBy("fp").agg(F.min("id").alias("least"))
    # tables between the joins are written, so that each join shuffles its sides itself and can split
    # a large component or class
    roots = components(links(classes.select("fp"), max_bits))
    named = write_once(roots.join(classes, roots.node == classes.fp).select("node", "root", "least"))
    names = write_once(named.groupBy("root").agg(F.min("least").alias("name")))
    of = named.join(names, "root").select(F.col("node").alias("fp"), "name")
    table = write_once(classes.join(of, "fp", "left").select("fp", F.coalesce("name", "least").alias("component_id")))
    return rows.join(table, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs`` whose id names their component, with all their columns; a component of
    null ids only stays."""
    found = simhash_components(docs, id_col, text_col, words, max_bits)
    return without(docs, id_col, found.filter(~F.col(id_col).eqNullSafe(F.col("component_id"))).select(id_col))
