"""Benchmark decontamination by edit distance over words.

A document is contaminated by a benchmark item of n words if some stretch of it is within
floor((1 - similarity) * n) word edits of the whole item.

Candidates are windows of the item's size. The CGK embedding sends a random walker along a window: at
each step it writes the word it stands on, and moves on or stays by a random bit of the step and the
word. Walkers that left each other at an edit meet again by chance, so few edits become few differing
steps, a small Hamming distance. Bit sampling then compares the item and the window on a few sampled
steps, in as many independent repetitions as the target recall asks for; a window that agrees in one
of them is verified by exact edit distance, all words of the item in one number, with k words more on
both sides. How many repetitions that takes is measured on items with as many edits as allowed, for
each kind of edit, between foreign words: the worst kind counts, and there is no limit.

Windows are laid where they can match at all: k edits leave at least one of 2k + 1 word pairs of an
item intact, so each item names its 2k + 1 longest pairs, and a window is laid for every place where
the document has one of them and has enough of the item's words around. By itself this loses nothing
where an item has 2k + 1 pairs (from similarity 0.7 on).
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from weftwork.llm.chunks import grouped, open_shared, share, without

#: Characters of benchmark text in one block of items; each block is one pass over the documents.
BLOCK_CHARS = 16_000_000
#: Walkers that are moved side by side.
WALKERS = 1 << 20


@dataclass
class Settings:
    similarity: float = 0.8
    min_words: int = 5
    #: Steps sampled for a comparison at most, and the share of matches that the repetitions shall find.
    sampled: int = 3
    recall: float = 0.999
    seed: int = 42


#: Scripts written without spaces: each of their characters is a word.
_UNSPACED = "\u0e00-\u0eff\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff"
_WORDS = re.compile(f"[{_UNSPACED}]|[^\\W{_UNSPACED}]+")


def split_words(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


# ---- the embedding -----------------------------------------------------------------------


def word_hashes(words: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 7) | 1 for w in words], np.uint64)


class Walks:
    """The random bits and sampled steps of ``repetitions`` walkers for windows of n words."""

    def __init__(self, n: int, repetitions: int, sampled: int, seed: int):
        rng = np.random.default_rng([seed, n, sampled])
        self.n, self.steps = n, 2 * n
        self.bits = rng.integers(1, 1 << 63, (repetitions, self.steps), dtype=np.uint64) | np.uint64(1)
        order = rng.random((repetitions, self.steps)).argsort(axis=1)
        self.wanted = order < min(sampled, self.steps)

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """(windows x repetitions): the words that the walkers write at their sampled steps, as one number.
        ``windows`` holds word hashes, 0 past a window's end, where a walker writes 0 and stays."""
        many = len(self.bits)
        chunk = max(1, WALKERS // max(many, 1))
        parts = []
        for i in range(0, len(windows), chunk):
            rows = np.concatenate([windows[i : i + chunk], np.zeros((len(windows[i : i + chunk]), 1), np.uint64)], axis=1)
            at, key = np.zeros((len(rows), many), np.int64), np.full((len(rows), many), 17, np.uint64)
            line = np.arange(len(rows))[:, None]
            for step in range(self.steps):
                h = rows[line, at]
                write = self.wanted[:, step]
                if write.any():
                    key[:, write] = key[:, write] * np.uint64(0x9E3779B97F4A7C15) + h[:, write] + np.uint64(1)
                at += ((h * self.bits[:, step]) >> np.uint64(63)).astype(np.int64)
            parts.append(key)
        return np.concatenate(parts) if parts else np.zeros((0, many), np.uint64)


def _edited(rng: random.Random, item: list[int], k: int, kind: str) -> list[tuple[int, int | None]]:
    """``item`` after k edits as (word, its place in the item or None)."""
    out: list[tuple[int, int | None]] = [(w, i) for i, w in enumerate(item)]
    for at in sorted(rng.sample(range(len(item)), k), reverse=True):
        one = kind if kind != "mixed" else rng.choice(("changed", "deleted", "inserted"))
        out[at : at + (one != "inserted")] = [] if one == "deleted" else [(rng.getrandbits(62) | 1, None)]
    return out


def _chances(n: int, k: int, sampled: int, seed: int, matches: int = 16, tries: int = 48, windows: int = 8) -> dict[str, np.ndarray]:
    """For each kind of edit, the chance of a repetition to find a match, for some random matches: items
    with k edits between foreign words, with windows laid at some of the word pairs left."""
    rng, walks = random.Random(f"{seed} {n} {k}"), Walks(n, tries, sampled, seed + 1)
    word = lambda: rng.getrandbits(62) | 1
    out = {}
    for kind in ("changed", "deleted", "inserted", "mixed"):
        chance = []
        for _ in range(matches):
            item = [word() for _ in range(n)]
            doc = [(word(), None) for _ in range(n)] + _edited(rng, item, k, kind) + [(word(), None) for _ in range(2 * n)]
            intact = [p - doc[p][1] for p in range(len(doc) - 1) if doc[p][1] is not None and doc[p + 1][1] == doc[p][1] + 1]
            starts = sorted({max(0, p) for p in rng.sample(intact, min(windows, len(intact)))})
            laid = np.array([[w for w, _ in doc[p : p + n]] for p in starts], np.uint64).reshape(len(starts), n)
            mine = walks.keys(np.array([item], np.uint64))
            chance.append((walks.keys(laid) == mine).any(axis=0).mean() if len(starts) else 0.0)
        out[kind] = np.array(chance)
    return out


def plan(n: int, k: int, s: Settings) -> tuple[int, int]:
    """(sampled steps, repetitions) for items of n words with k edits to be found with the target recall,
    whatever the kind of edit. Fewer steps are sampled where more would take many repetitions. A match
    that was never hit in the trials is given half a hit."""
    if not k:
        return s.sampled, 1
    for sampled in range(s.sampled, 0, -1):
        worst = 1
        for chance in _chances(n, k, sampled, s.seed).values():
            chance = np.maximum(chance, 0.5 / 48)
            many = 1
            while ((1 - chance) ** many).mean() > 1 - s.recall:
                many += 1
            worst = max(worst, many)
        if worst <= 32:
            break
    return sampled, worst


def _measured(n: int) -> int:
    """The length at which the plan for items of n words is measured: lengths a quarter apart, rounded up,
    where the share of edits is the same and the walkers have longer to part."""
    at = 5
    while at < n:
        at = max(at + 1, at * 5 // 4)
    return at


# ---- items in texts ----------------------------------------------------------------------


def least_edits(item: list[str], words: list[str], most: int) -> tuple[int, int]:
    """The least number of word edits that turn ``item`` into some stretch of ``words``, and where the
    best stretch ends; gives up with ``most + 1`` once that is exceeded."""
    above, end, best = list(range(len(item) + 1)), 0, len(item)
    for j, w in enumerate(words, 1):
        now = [0]
        for i, x in enumerate(item, 1):
            now.append(min(above[i - 1] + (x != w), above[i] + 1, now[i - 1] + 1))
        above = now
        if now[-1] < best:
            best, end = now[-1], j
    return (best, end) if best <= most else (most + 1, 0)


def least_edits_by_bits(places: dict[str, int], n: int, words: list[str]) -> tuple[int, int]:
    """As ``least_edits`` without a limit, for an item of n words of which ``places`` has the bits where
    each stands: the differences down a column of the table are kept in two numbers."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, now, best, end = full, 0, n, n, 0
    for j, w in enumerate(words, 1):
        equal = places.get(w, 0)
        v = equal | down
        h = ((equal & up) + up ^ up) | equal
        rises, falls = down | ~(h | up) & full, up & h
        if rises & top:
            now += 1
        elif falls & top:
            now -= 1
            if now < best:
                best, end = now, j
        rises, falls = rises << 1 & full, falls << 1 & full
        up, down = falls | ~(v | rises) & full, rises & v
    return best, end


@dataclass
class ItemIndex:
    """What the workers need of a block of items."""

    settings: Settings
    ids: list = field(default_factory=list)
    words: list[list[str]] = field(default_factory=list)
    edits: list[int] = field(default_factory=list)
    pairs: dict[str, dict[str, list[tuple[int, int]]]] = field(default_factory=dict)
    places: list[dict[str, int]] = field(default_factory=list)  # the bits where an item's words stand
    walks: dict[int, Walks] = field(default_factory=dict)  # by the number of words
    keys: list[np.ndarray] = field(default_factory=list)


def build_index(items: list[tuple[object, str | None]], s: Settings) -> ItemIndex:
    """Items of fewer than ``min_words`` words are left out: they are found in any text (see
    ``short_items``)."""
    index, plans = ItemIndex(s), {}
    for item_id, text in items:
        words = split_words(text)
        if len(words) < s.min_words:
            continue
        n, number, k = len(words), len(index.ids), int((1 - s.similarity) * len(words) + 1e-9)
        index.ids.append(item_id)
        index.words.append(words)
        index.edits.append(k)
        bits: dict[str, int] = {}
        for i, w in enumerate(words):
            bits[w] = bits.get(w, 0) | 1 << i
        index.places.append(bits)
        places = sorted(range(n - 1), key=lambda i: (-len(words[i]) - len(words[i + 1]), i))[: 2 * k + 1]
        for i in places:
            index.pairs.setdefault(words[i], {}).setdefault(words[i + 1], []).append((number, i))
        if n not in index.walks:
            at = _measured(n)
            if at not in plans:
                plans[at] = plan(at, int((1 - s.similarity) * at + 1e-9), s)
            sampled, many = plans[at]
            index.walks[n] = Walks(n, many, sampled, s.seed)
        index.keys.append(index.walks[n].keys(word_hashes(words)[None, :])[0])
    return index


def _windows(words: list[str], index: ItemIndex) -> Iterator[tuple[int, int]]:
    """(item number, start) of the windows that can match; windows of the same words once."""
    starts: dict[int, dict[int, None]] = {}
    pairs = index.pairs
    for i, w in enumerate(words):
        if w in pairs and i + 1 < len(words):
            for number, offset in pairs[w].get(words[i + 1], ()):
                starts.setdefault(number, {})[max(0, i - offset)] = None
    for number, mine in starts.items():
        n, k, places, tried = len(index.words[number]), index.edits[number], index.places[number], set()
        for start in sorted(mine):
            around = words[max(0, start - k) : start + n + k]
            if sum(w in places for w in around) < n - k:
                continue
            seen = tuple(around)
            if seen not in tried:
                tried.add(seen)
                yield number, start


def find_in_texts(texts: list[str | None], index: ItemIndex) -> list[list[tuple[int, int, int, int]]]:
    """For each text, (item number, edits, first word, words) of the items in it, each where it takes the
    least edits, the first of such places."""
    split = [split_words(t) for t in texts]
    by_length: dict[int, list[tuple[int, int, int]]] = {}
    for t, words in enumerate(split):
        for number, start in _windows(words, index):
            by_length.setdefault(len(index.words[number]), []).append((t, number, start))
    best: list[dict[int, tuple[int, int, int, int]]] = [{} for _ in texts]
    for n, laid in by_length.items():
        windows = np.zeros((len(laid), n), np.uint64)
        for i, (t, _, start) in enumerate(laid):
            hashes = word_hashes(split[t][start : start + n])
            windows[i, : len(hashes)] = hashes
        agree = (index.walks[n].keys(windows) == np.stack([index.keys[number] for _, number, _ in laid])).any(axis=1)
        for t, number, start in (laid[i] for i in np.flatnonzero(agree)):
            k = index.edits[number]
            first = max(0, start - k)
            edits, end = least_edits_by_bits(index.places[number], n, split[t][first : start + n + k])
            if edits <= k:
                match = (number, edits, max(0, first + end - n), n)
                known = best[t].get(number)
                if known is None or (match[1], match[2]) < (known[1], known[2]):
                    best[t][number] = match
    return [list(b.values()) for b in best]


def find_items(text: str | None, index: ItemIndex) -> list[tuple[int, int, int, int]]:
    """``find_in_texts`` for one text."""
    return find_in_texts([text], index)[0]


def short_items(benchmark: DataFrame, text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """The rows of ``benchmark`` that ``contamination`` cannot look for, being empty or too short."""
    least = (settings or Settings()).min_words

    @F.udf("int")
    def count(text):
        return len(split_words(text))

    return benchmark.filter(count(F.col(text_col)) < least)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", settings: Settings | None = None) -> DataFrame:
    """One row per document row and item found in it: id, item id, ``edits``, ``first_word`` (where
    the match begins, within its edits) and ``n_words``.

    Null and empty texts and items match nothing, and items of fewer than ``min_words`` words are not
    looked for (``short_items`` lists them). A character of a script without spaces is a word. Rows that
    repeat an id or a text are matched one by one; an item that occurs several times in a text is found
    once, where it takes the least edits, then first. Texts are read whole, whatever their length. Items
    are dealt into blocks of some ``BLOCK_CHARS`` characters; only one block is sent to the executors
    with a pass.
    """
    s = settings or Settings()
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).filter("t is not null").distinct()
    size = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-size // BLOCK_CHARS) or 1
    id_type, item_type = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("binary").alias("__text"))
    out = None
    for block in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).orderBy("i", "t").collect()
        index = build_index([(r["i"], r["t"]) for r in mine], s)
        shared = share(spark, index)

        def batches(it: Iterator, shared=shared) -> Iterator:
            import pyarrow as pa

            index = open_shared(shared)
            for batch in it:
                at, hits, row = [], [], 0
                for texts in grouped((t.decode("utf-8", "replace") if t else "") for t in batch.column(1).to_pylist()):
                    for got in find_in_texts(texts, index):
                        at.extend([row] * len(got))
                        hits.extend(got)
                        row += 1
                ids = batch.column(0).take(pa.array(at, pa.int64()))
                columns = [pa.array([h[c] for h in hits], pa.int32()) for c in range(4)]
                yield pa.RecordBatch.from_arrays([ids, *columns], names=["__id", "item", "edits", "first_word", "n_words"])

        found = rows.mapInArrow(batches, f"__id {id_type.simpleString()}, item int, edits int, first_word int, n_words int")
        names = spark.createDataFrame([(n, i) for n, i in enumerate(index.ids)], f"item int, __item {item_type.simpleString()}")
        part = found.join(F.broadcast(names), "item").select(F.col("__id").alias(id_col), F.col("__item").alias(item_col), "edits", "first_word", "n_words")
        out = part if out is None else out.union(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", settings: Settings | None = None) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns. A null id is compared as a value."""
    found = contamination(docs, benchmark, id_col, text_col, item_col, settings)
    return without(docs, id_col, found.select(id_col))
