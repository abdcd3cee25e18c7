"""Words that differ by one character, found by a dictionary of pairs of trie nodes.

All words form two tries, one of their beginnings and one of their reversed endings, whose nodes are
numbered. Sorted words bring the nodes along: a word's first characters that it shares with the word
before are that word's nodes, each further one is a new node. A range of sorted words is numbered in
one task, from what the driver makes of the first and last word of each range.

A word of L characters then is L + 1 *splits* (node of the first i characters, node of the rest) and
L *skips* (node of the first i, node of those after the next one). Words that share a skip differ by
one replaced character there; a skip that is another word's split deletes or inserts one. Both are
equality of two integers, so neighbours are exact and one shuffle by the pair finds all of them. A
pair holds one word for each character that may stand in the gap, and one split, so its group is
bounded by the alphabet. A deletion from a run of equal characters gives one word however it is made;
only the skip of the run's first character may delete.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from weftwork.session import materialise, write_once

#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000
LETTERS = "a-zÀ-ÿ"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 7, min_count: int = 2, slip: int | None = None) -> DataFrame:
    """(word, n): the runs of Latin letters of whole texts, A-Z lower-cased, that have ``min_chars``
    characters and occur ``min_count`` times. Null texts have none. With ``slip``, a run loses a
    character where that number divides the CRC-32 of ``<id>:<run>``, the one at the checksum modulo
    the run's length (planted misspellings); a null id reads as empty text there."""

    def batches(it: Iterator) -> Iterator:
        import re
        import zlib
        from collections import Counter

        import pyarrow as pa

        # a run that is too short stays so
        find = re.compile(f"[{LETTERS}]{{{max(min_chars, 1)},}}").findall
        table: Counter = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(list(table), pa.string()), pa.array(list(table.values()), pa.int64())], names=["word", "n"])
            table.clear()
            return batch

        for batch in it:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                runs = Counter(find(text.lower().decode("utf-8", "replace"))) if text else {}  # bytes: only A-Z is lower-cased
                start = zlib.crc32(b"%s:" % (row or "").encode())
                for word, n in runs.items():
                    h = zlib.crc32(word.encode(), start) if slip else 1
                    if slip and h % slip == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < min_chars:
                            continue
                    table[word] += n
                if len(table) > COUNTED:
                    yield out()
        yield out()

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(batches, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _shared(a: str, b: str) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    i = 0
    while a[i] == b[i]:
        i += 1
    return i


def trie_nodes(keys: DataFrame, key: str, runs: bool = False) -> DataFrame:
    """Adds to distinct, non-null ``key``: ``rank``, its place in code-point order from 0, and ``nodes``,
    the trie nodes of its first 0, 1, ... characters (0 is the root). ``runs`` adds ``starts``: whether
    each character differs from the one before."""
    staged = materialise(keys.repartitionByRange(key).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id()))

    def ends(it: Iterator) -> Iterator:
        import pyarrow as pa

        part, rows, used, first, before, nodes = 0, 0, 0, "", "", []
        for batch in it:
            words = batch.column(batch.schema.get_field_index(key)).to_pylist()
            for word in words:
                same = _shared(before, word) if rows else 0
                nodes[same:] = range(used, used + len(word) - same)
                used += len(word) - same
                first, before, rows = (first if rows else word), word, rows + 1
            if words:
                part = batch.column(batch.schema.get_field_index("_part"))[0].as_py()
        yield pa.RecordBatch.from_pylist([{"part": part, "rows": rows, "used": used, "first": first, "last": before, "nodes": nodes}] if rows else [], schema=pa.schema(
            [("part", pa.int32()), ("rows", pa.int64()), ("used", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("nodes", pa.list_(pa.int64()))]))

    found = staged.mapInArrow(ends, "part int, rows bigint, used bigint, first string, last string, nodes array<bigint>").collect()
    plan, before, path, free, rank = {}, "", [0], 1, 0  # one entry per range
    for r in sorted(found, key=lambda r: r["part"]):
        same = _shared(before, r["first"])
        carried = path[: same + 1]
        plan[r["part"]] = (rank, free, before[:same], carried)
        opening = carried + list(range(free, free + len(r["first"]) - same))
        stays = _shared(r["first"], r["last"])
        path = opening[: stays + 1] + [free + n - same for n in r["nodes"][stays:]]
        before, free, rank = r["last"], free + r["used"] - same, rank + r["rows"]

    def number(it: Iterator) -> Iterator:
        import pyarrow as pa

        now = None
        for batch in it:
            words = batch.column(batch.schema.get_field_index(key)).to_pylist()
            if not words:
                continue
            if now is None:
                now, free, before, path = plan[batch.column(batch.schema.get_field_index("_part"))[0].as_py()]
                path = list(path)
            flat, sizes, starts = [], [], []
            for word in words:
                same = _shared(before, word)
                new = len(word) - same
                path[same + 1 :] = range(free, free + new)
                free, before = free + new, word
                flat.extend(path)
                sizes.append(len(path))
                if runs:
                    starts.extend(x != y for x, y in zip(word, " " + word))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            columns = [pa.array(np.arange(now, now + len(words))), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))]
            if runs:
                columns.append(pa.ListArray.from_arrays(pa.array(offsets - np.arange(len(offsets), dtype=np.int32)), pa.array(starts, pa.bool_())))
            now += len(words)
            keep = [c for n, c in zip(batch.schema.names, batch.columns) if n != "_part"]
            yield pa.RecordBatch.from_arrays([*keep, *columns], names=[*[n for n in batch.schema.names if n != "_part"], "rank", "nodes", *(["starts"] if runs else [])])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema.fields]
    return staged.mapInArrow(number, ", ".join([*kinds, "rank bigint, nodes array<bigint>", *(["starts array<boolean>"] if runs else [])]))


def neighbours(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words, links) of distinct (word, n): the words with their ``rank`` in code-point order, and
    (rank, n_near, best_n, best) for each word that has neighbours: how many, and the one of largest n,
    the smallest word on ties."""
    forward = write_once(trie_nodes(words.select("word", "n"), "word", runs=True))
    backward = trie_nodes(forward.select(F.col("rank").alias("word_rank"), F.reverse("word").alias("reversed")), "reversed")
    backward = backward.select(F.col("word_rank").alias("rank"), F.col("nodes").alias("back"))
    both = forward.select("rank", "n", "nodes", "starts").join(backward, "rank")
    length = F.size("starts")
    entry = lambda i, tail, kind: F.struct(F.get("nodes", i).alias("p"), F.get("back", tail).alias("s"), kind.cast("tinyint").alias("kind"))
    skips = F.transform(F.sequence(F.lit(0), length - 1), lambda i: entry(i, length - i - 1, F.when(F.get("starts", i), 2).otherwise(1)))
    splits = F.transform(F.sequence(F.lit(0), length), lambda i: entry(i, length - i, F.lit(0)))
    pairs = both.filter(length > 0).select((-F.col("n")).alias("neg"), "rank", F.inline(F.concat(skips, splits)))

    # a pair: at most one split, and one skip for each character of the alphabet
    group = Window.partitionBy("p", "s").orderBy((F.col("kind") == 0), "neg", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = F.struct("neg", "rank")
    of = lambda kind: F.when(F.col("kind") == kind, one)
    seen = pairs.withColumns({
        "_skips": F.count(F.when(F.col("kind") > 0, 1)).over(group),
        "_first": F.first(one).over(group),
        "_second": F.nth_value(one, 2).over(group),
        "_deletes": F.count(of(2)).over(group),
        "_longer": F.min(of(2)).over(group),
        "_shorter": F.min(of(0)).over(group),
    })
    skip, canonical = F.col("kind") > 0, F.col("kind") == 2
    replaced = F.when(F.col("_skips") > 1, F.when(F.col("_first.rank") == F.col("rank"), F.col("_second")).otherwise(F.col("_first")))
    shorter = F.when(canonical, F.col("_shorter"))
    near = F.when(skip, F.col("_skips") - 1 + shorter.isNotNull().cast("int")).otherwise(F.col("_deletes"))
    best = F.when(skip, F.least(replaced, shorter)).otherwise(F.col("_longer"))
    links = seen.select("rank", near.alias("near"), best.alias("best")).filter("near > 0")
    links = links.groupBy("rank").agg(F.sum("near").alias("n_near"), F.min("best").alias("b"))
    return forward.select("rank", "word", "n"), links.select("rank", "n_near", (-F.col("b.neg")).alias("best_n"), F.col("b.rank").alias("best"))


def last_forms(steps: DataFrame) -> DataFrame:
    """(rank, root) from (rank, form): where following forms ends. Each round doubles the way; forms
    never lead back."""
    steps = materialise(steps.select("rank", "form"))
    while True:
        ahead = steps.select(F.col("rank").alias("_r"), F.col("form").alias("_f"))
        far = materialise(steps.join(ahead, F.col("form") == F.col("_r"), "left").select("rank", F.coalesce("_f", "form").alias("form"), "_f"))
        steps = far.select("rank", "form")
        if not far.filter("_f is not null").limit(1).count():
            return steps.withColumnRenamed("form", "root")


def spelling_variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """One row per row of ``words`` (word, n; distinct, not null): form, the neighbour of largest n
    (ties: smallest in code-point order) if that is at least ``factor`` times the word's own, which
    must be over 1; root, the end of the chain of forms, the word itself if it has none; n_near,
    neighbours by one inserted, deleted or replaced character; form_n, the form's n.

    The empty word has no neighbours. Words of any length work. Further columns are dropped.
    """
    if factor <= 1:
        raise ValueError("with a factor of 1 forms may lead in circles")
    ranked, links = neighbours(words)
    links = write_once(links)
    all_ = ranked.join(links, "rank", "left")
    chosen = F.when(F.col("best_n") >= factor * F.col("n"), F.col("best"))
    all_ = write_once(all_.select("rank", "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), chosen.alias("form")))
    roots = last_forms(all_.filter("form is not null"))
    named = all_.select(F.col("rank").alias("form"), F.col("word").alias("form_word"), F.col("n").alias("form_n"))
    ends = all_.select(F.col("rank").alias("root"), F.col("word").alias("root_word"))
    formed = all_.filter("form is not null").select("rank", "form").join(roots, "rank").join(named, "form").join(ends, "root")
    out = all_.drop("form").join(formed.select("rank", "form_word", "root_word", "form_n"), "rank", "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
