"""License scans by patience alignment.

A template is aligned with a stretch of a text word by word: the words that are unique in both are
anchors, the longest increasing subsequence of them is kept, and the gaps between anchors are
aligned the same way; where a gap has no unique words, equal words at its ends are taken. Coverage
is the share of the template's words that are aligned.

Stretches are laid in a text where a match is possible: at coverage c, at most (1 - c) n of the
template's n words are missing, so of any more distinct words than that one is in place. Those that
the text has least often are taken, and a stretch is laid around each place where one stands. What
is found there is aligned again with ``reach`` words on both sides, and so are the places where
nothing was found, by longest common subsequences: up to that many inserted words cost no coverage.

Words that tell a template from others must be aligned, and words that make it another must not
stand between its own: those are read off the alignments of the templates with each other, and
``license_texts`` names more for the statements it holds.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, functions as F

from weftwork.llm.license_texts import FOREIGN, STATEMENTS, TELLING


def split_words(text: str | None) -> list[str]:
    return re.findall(r"\w+", text.lower()) if text else []


def longest_increasing(values: list[int]) -> list[int]:
    """The places of a longest strictly increasing subsequence."""
    tails, ends, before = [], [], []
    for i, v in enumerate(values):
        at = bisect_left(tails, v)
        before.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(v)
            ends.append(i)
        else:
            tails[at], ends[at] = v, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs (place in a, place in b) of equal words, increasing in both."""
    pairs, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {w: i for i, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = [(i, at[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in at]
        if not anchors:
            continue
        kept = [anchors[k] for k in longest_increasing([j for _, j in anchors])]
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *kept], [*kept, (a1, b1)]):
            todo.append((i + 1, k, j + 1, m))
        pairs.extend(kept)
    return sorted(pairs)


def common_length(words: list[str], bits: Mapping[str, int], n: int) -> int:
    """The length of the longest common subsequence with a template of n words; ``bits`` has each
    word's places in it."""
    full = (1 << n) - 1
    left = full
    for w in words:
        if w in bits:
            met = left & bits[w]
            left = (left + met | left - met) & full
    return n - left.bit_count()


def longest_common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs (place in a, place in b) of a longest common subsequence, the one that ends first in a,
    from there back as late as can be."""
    rows = [[0] * (len(b) + 1)]
    for x in a:
        above, now = rows[-1], [0]
        for j, y in enumerate(b):
            now.append(above[j] + 1 if x == y else max(above[j + 1], now[j]))
        rows.append(now)
    i, j, pairs = next(i for i, row in enumerate(rows) if row[-1] == rows[-1][-1]), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif rows[i - 1][j] == rows[i][j]:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def telling_words(templates: Mapping[str, list[str]], coverage: float) -> dict[str, tuple[set[str], set[str]]]:
    """For each template: the words that must be aligned, and those that must not stand between
    aligned ones, so that no text of a similar template passes for it."""
    out = {}
    for name, template in templates.items():
        must, never = set(), set()
        for other in templates.values():
            pairs = longest_common(other, template) if other != template else []
            if pairs and len(pairs) >= coverage * max(len(template), len(other)) - 1e-9:
                must |= set(template) - set(other)
                never |= set(other[pairs[0][0] : pairs[-1][0]]) - set(template)
        out[name] = must, never
    return out


def scan(words: list[str], templates: Mapping[str, list[str]], coverage: float, telling: Mapping[str, tuple[set[str], set[str]]] | None = None) -> list[tuple[str, float, int, int]]:
    """(template, coverage, first word, words) of the best stretches; of two that share over half of one, the better."""
    found, counts, places = [], None, None
    present = set(words)
    for name, template in templates.items():
        n = len(template)
        missing = int((1 - coverage) * n + 1e-9)
        distinct = set(template)
        must, never = telling[name] if telling and name in telling else (set(), set())
        if not n or not must <= present or sum(w not in present for w in template) > missing:
            continue
        if places is None:
            places = {}
            counts = Counter(words)
        rare = sorted(distinct, key=lambda w: (counts[w], w))[: missing + 1]
        for w in rare:
            if w not in places:
                places[w] = [i for i, x in enumerate(words) if x == w] if counts[w] else []
        bits: dict[str, int] = {}
        for i, w in enumerate(template):
            bits[w] = bits.get(w, 0) | 1 << i
        need = coverage * n - 1e-9

        def fits(pairs, start):
            """(-aligned, first word, end) of an alignment that is a match, else None."""
            if len(pairs) < need or not must <= {template[j] for _, j in pairs}:
                return None
            first, last = start + pairs[0][0], start + pairs[-1][0] + 1
            return None if never and not never.isdisjoint(words[first:last]) else (-len(pairs), first, last)

        def apart(one, others):
            return all(2 * (min(one[2], y) - max(one[1], x)) <= min(one[2] - one[1], y - x) for _, x, y in others)

        reach, slack, best, seen = n + 8, max(1, missing), [], set()
        anchors = sorted({(at, at - offset) for w in rare for offset in (i for i, x in enumerate(template) if x == w) for at in places[w]})
        for _, begin in anchors:
            start, end = max(0, begin - slack), min(len(words), begin + n + slack)
            if (start, end) in seen:
                continue
            seen.add((start, end))
            if common_length(words[start:end], bits, n) >= need:
                best.append(fits(patience(words[start:end], template), start))
        taken: list[tuple[int, int, int]] = []
        for one in sorted(filter(None, best)):
            if apart(one, taken):
                taken.append(one)
        # the same with inserted words, up to the next match on either side
        for k, (score, first, last) in enumerate(taken):
            if -score < n:
                start = max([first - reach, 0, *(y for _, x, y in taken if x < first)])
                end = min([last + reach, len(words), *(x for _, x, y in taken if y > last)])
                if start <= first and last <= end and common_length(words[start:end], bits, n) > -score:
                    taken[k] = fits(longest_common(words[start:end], template), start) or taken[k]
        wide, seen = [], set()
        for at, begin in anchors:
            if any(x <= at < y for _, x, y in taken):
                continue
            start = max([begin - reach, 0, *(y for _, x, y in taken if y <= at)])
            end = min([begin + n + reach, len(words), *(x for _, x, y in taken if x > at)])
            if (start, end) not in seen:
                seen.add((start, end))
                if common_length(words[start:end], bits, n) >= need:
                    wide.append(fits(longest_common(words[start:end], template), start))
        for one in sorted(filter(None, wide)):
            if apart(one, taken):
                taken.append(one)
        found.extend((name, -score / n, first, last - first) for score, first, last in taken)
    return found


def license_matches(docs: DataFrame, templates: Mapping[str, str] | None = None, coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per place where a document has a template: id, ``license``, ``coverage``,
    ``first_word`` and ``n_words``. Null and empty texts, and empty templates, match nothing. Texts are read
    whole, whatever their length. Rows that repeat an id or a text each give their own matches; a text that
    has several templates, or one in several places, gives a row for each. Other columns are not looked at."""
    wanted = {k: split_words(v) for k, v in (STATEMENTS if templates is None else templates).items()}
    telling = telling_words(wanted, coverage)
    if templates is None:
        telling = {k: (must | set(split_words(TELLING.get(k, ""))), never | (FOREIGN - set(wanted[k]))) for k, (must, never) in telling.items()}
    shared = docs.sparkSession.sparkContext.broadcast((wanted, telling))

    def batches(it: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in it:
            rows, hits = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                got = scan(split_words(text.decode("utf-8", "replace") if text else ""), shared.value[0], coverage, shared.value[1])
                rows.extend([row] * len(got))
                hits.extend(got)
            columns = [pa.array([h[c] for h in hits], t) for c, t in enumerate((pa.string(), pa.float64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns], names=["id", "license", "coverage", "first_word", "n_words"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    found = rows.mapInArrow(batches, f"id {kind}, license string, coverage double, first_word int, n_words int")
    return found.withColumnRenamed("id", id_col)
