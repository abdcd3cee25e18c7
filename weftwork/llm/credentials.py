"""Secrets in texts: three fixed patterns, and whatever else has the format of what they found.

What the patterns find are labelled credentials. For each kind a sample of them is written as strings
of character classes, laid out as a prefix tree, and states of that tree whose continuations do not
differ by more than the Hoeffding bound allows are merged, the most frequent first, each with the
compatible state that makes its own continuations likeliest (ALERGIA in the red-blue order). The
result is a deterministic automaton with probabilities; another is inferred from ordinary tokens.

All tokens of all texts that may be a secret are then scored: by the log likelihood of their format
under a kind's automaton, less that under the automaton of ordinary tokens. A token outside the fixed
patterns' finds becomes a span of kind ``grammar`` if its odds and its fit both pass thresholds; what fits is
set on credentials that no automaton has seen.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from weftwork.llm.chunks import grouped
from weftwork.session import write_once

#: Distinct strings of a kind that its automaton and thresholds are fitted on, and their longest length.
SAMPLE, LONGEST = 1_500, 256
#: The kinds in order, and what may be in the way of the fixed patterns.
KINDS = ("assign", "access", "hex", "grammar")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Tokens that may be a secret.
CANDIDATE = r"[A-Za-z0-9+/_.-]{12,}={0,2}"
#: Character classes, in order; the strings between them and the end of a string.
CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", ".", "=", "-")


def _class_table() -> np.ndarray:
    table = np.full(256, len(CLASSES), np.int64)  # anything else
    for k, members in enumerate(CLASSES):
        table[[ord(c) for c in members]] = k
    return table


SYMBOLS = len(CLASSES) + 1


class Finder:
    """The fixed patterns and the candidates of a text."""

    def __init__(self):
        self.assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII).finditer
        self.access = re.compile("AKIA[A-Z0-9]+").finditer
        self.hex = re.compile("[0-9a-f]{16,}").finditer  # runs are maximal, so shorter ones only drop out
        self.candidate = re.compile(CANDIDATE).finditer

    def base(self, text: str) -> list[tuple[int, int, int, str]]:
        """(kind, start, end, secret) of the fixed patterns, by start and kind."""
        out = []
        low = text.lower()
        if any(word in low for word in ("password", "passwd", "secret", "token", "apikey", "api_key")):
            out += [(0, *m.span(), m[2]) for m in self.assign(text) if len(m[2]) >= 12]
        if "AKIA" in text:
            out += [(1, *m.span(), m[0]) for m in self.access(text) if len(m[0]) >= 18]
        out += [(2, *m.span(), m[0]) for m in self.hex(text)]
        return sorted(out, key=lambda s: (s[1], s[0]))

    def others(self, text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
        """(start, end, token) of candidates that no fixed pattern touches."""
        found = [(*m.span(), m[0]) for m in self.candidate(text)]
        if not base:
            return found
        ends = np.maximum.accumulate([b[2] for b in base])
        starts = np.array([b[1] for b in base])
        free = lambda a, z: (k := int(np.searchsorted(starts, z))) == 0 or ends[k - 1] <= a
        return [c for c in found if free(c[0], c[1])]


# ---- grammar inference -------------------------------------------------------------------


class Automaton:
    """States with counts; state 0 is the start."""

    def __init__(self, strings: list[list[int]]):
        """The prefix tree of ``strings``."""
        self.count, self.end, self.to, self.uses = [0], [0], [{}], [{}]
        for s in strings:
            at = 0
            self.count[0] += 1
            for x in s:
                if x not in self.to[at]:
                    self.to[at][x] = len(self.count)
                    for part in (self.count, self.end):
                        part.append(0)
                    self.to.append({})
                    self.uses.append({})
                self.uses[at][x] = self.uses[at].get(x, 0) + 1
                at = self.to[at][x]
                self.count[at] += 1
            self.end[at] += 1

    def fit(self, red: int, blue: int, gamma: float) -> float | None:
        """Log likelihood of what follows ``blue`` as continuations of ``red``; None if they differ."""
        total, todo = 0.0, [(red, blue)]
        while todo:
            r, b = todo.pop()
            n, m = self.count[r], self.count[b]
            bound = gamma * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.end[r] / n - self.end[b] / m) > bound:
                return None
            total += self.end[b] * math.log((self.end[r] + 0.1) / (n + 0.1 * (SYMBOLS + 1)))
            for x in self.uses[r].keys() | self.uses[b].keys():
                f, g = self.uses[r].get(x, 0), self.uses[b].get(x, 0)
                if abs(f / n - g / m) > bound:
                    return None
                if g:
                    total += g * math.log((f + 0.1) / (n + 0.1 * (SYMBOLS + 1)))
                    if f:
                        todo.append((self.to[r][x], self.to[b][x]))
        return total

    def fold(self, red: int, blue: int) -> None:
        """Add the tree below ``blue`` to ``red`` and what follows it."""
        todo = [(red, blue)]
        while todo:
            r, b = todo.pop()
            self.count[r] += self.count[b]
            self.end[r] += self.end[b]
            for x, child in self.to[b].items():
                known = x in self.to[r]
                self.uses[r][x] = self.uses[r].get(x, 0) + self.uses[b][x]
                if known:
                    todo.append((self.to[r][x], child))
                else:
                    self.to[r][x] = child

    def merge(self, alpha: float) -> list[int]:
        """Merge compatible states; the states that are left."""
        gamma = math.sqrt(0.5 * math.log(2 / alpha))
        red = [0]
        while True:
            settled = set(red)
            blue = [(-self.count[child], child, r, x) for r in red for x, child in self.to[r].items() if child not in settled]
            if not blue:
                return red
            _, state, parent, x = min(blue)
            fits = [(s, -r) for r in red if (s := self.fit(r, state, gamma)) is not None]
            if fits:
                into = -max(fits)[1]
                self.to[parent][x] = into
                self.fold(into, state)
            else:
                red.append(state)


def infer(strings: list[str], alpha: float = 0.05) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(next state, log probability: states x symbols; log probability of the end) of the automaton of
    ``strings``. A symbol that never followed a state leads to a last state, which knows the symbols'
    overall shares only."""
    table = _class_table()
    coded = [table[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)].tolist() for s in strings]
    automaton = Automaton(coded)
    states = automaton.merge(alpha)
    number = {s: i for i, s in enumerate(states)}
    lost = len(states)
    step = np.full((lost + 1, SYMBOLS), lost, np.int64)
    uses, ends = np.zeros((lost + 1, SYMBOLS)), np.zeros(lost + 1)
    for s, i in number.items():
        for x, child in automaton.to[s].items():
            step[i, x], uses[i, x] = number[child], automaton.uses[s][x]
        ends[i] = automaton.end[s]
    uses[lost], ends[lost] = uses.sum(0), ends.sum()
    whole = (uses.sum(1) + ends + 0.01 * (SYMBOLS + 1))[:, None]
    return step, np.log((uses + 0.01) / whole), np.log((ends + 0.01) / whole[:, 0])


def log_likelihood(tokens: list[str], model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Log likelihood of each token's format, all tokens moving through the automaton side by side."""
    step, logs, ends = model
    size = np.array([len(t) for t in tokens], np.int64)
    order = np.argsort(-size, kind="stable")
    flat = _class_table()[np.frombuffer("".join(tokens).encode("latin-1", "replace"), np.uint8)]
    first, size = (np.cumsum(size) - size)[order], size[order]
    state, total = np.zeros(len(tokens), np.int64), np.zeros(len(tokens))
    at, running = 0, len(tokens)
    while running and size[0] > at:
        running = int(np.searchsorted(-size, -at, "left"))  # tokens longer than at
        x = flat[first[:running] + at]
        total[:running] += logs[state[:running], x]
        state[:running] = step[state[:running], x]
        at += 1
    out = np.empty(len(tokens))
    out[order] = total + ends[state]
    return out


def labelled_strings(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(kind, secret): of each fixed pattern's secrets and of the other tokens, the ``sample`` distinct
    ones of least hash, of all rows of ``docs``; those over LONGEST characters are not taken."""

    def batches(it: Iterator) -> Iterator:
        import heapq

        import pyarrow as pa
        import xxhash

        find, least = Finder(), {k: {} for k in range(len(KINDS))}  # the least of this task

        def shrink(kind: int) -> None:
            least[kind] = dict(heapq.nsmallest(sample, least[kind].items(), key=lambda kv: (kv[1], kv[0])))

        for batch in it:
            for texts in grouped((t.decode("utf-8", "replace") if t else "") for t in batch.column(0).to_pylist()):
                for text in texts:
                    base = find.base(text)
                    for kind, s in [(b[0], b[3]) for b in base] + [(3, o[2]) for o in find.others(text, base)]:
                        if len(s) <= LONGEST and s not in least[kind]:
                            least[kind][s] = xxhash.xxh64_intdigest(s) >> 1
                for kind in least:
                    if len(least[kind]) > 4 * sample:
                        shrink(kind)
        for kind in least:
            shrink(kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(least[kind]), pa.int32()), pa.array(list(least[kind]), pa.string()), pa.array(list(least[kind].values()), pa.int64())],
                names=["kind", "secret", "h"])

    rows = docs.select(F.col(text_col).cast("binary").alias("t")).mapInArrow(batches, "kind int, secret string, h bigint")
    found = write_once(rows.distinct())
    # the bucket of the hash in which the last one taken lies, for each kind
    bucket = F.shiftright("h", 47)
    sizes = found.groupBy("kind", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))  # at most 65,536 a kind
    upto = Window.partitionBy("kind").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut = sizes.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).filter(F.col("before") < sample).groupBy("kind").agg(F.max("bucket").alias("last"))
    near = found.join(F.broadcast(cut), "kind").filter(bucket <= F.col("last"))  # four rows
    nth = F.row_number().over(Window.partitionBy("kind").orderBy("h", "secret"))
    return near.withColumn("_nth", nth).filter(F.col("_nth") <= sample).select("kind", "secret", "h")


def fit_formats(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, alpha: float = 0.05, odds: float = 1000.0, miss: float = 0.01) -> dict:
    """The automata by kind and their thresholds, as plain arrays and numbers.

    Three of four sampled strings infer the automata, each in a task of its own; the others set the
    thresholds: a token fits a kind if its likelihood per character is above that of the worst ``miss``
    of the kind's credentials. Its odds against an ordinary token must be over ``odds``. The sample of
    ordinary tokens may hold unlabelled credentials: those that fit a kind and are likelier there are
    taken out and the automaton of ordinary tokens is inferred again, until none is left.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        import pickle

        strings = pdf.sort_values(["h", "secret"])
        seen = strings["secret"][strings["h"] % 4 != 0].tolist() or strings["secret"].tolist()
        return pd.DataFrame({"kind": pdf["kind"].iloc[:1], "data": [pickle.dumps(infer(seen, alpha))]})

    import pickle

    strings = write_once(labelled_strings(docs, text_col, sample))
    kinds = {r["kind"]: pickle.loads(bytes(r["data"])) for r in strings.groupBy("kind").applyInPandas(one, "kind int, data binary").collect()}  # four rows
    plain = kinds.pop(len(KINDS) - 1, None)
    held, ordinary = {k: [] for k in kinds}, []
    for r in strings.orderBy("h", "secret").collect():  # the sample
        if r["kind"] not in held:
            ordinary.append(r["secret"])
        elif r["h"] % 4 == 0:
            held[r["kind"]].append(r["secret"])
    floors = {k: float(np.quantile(_each(held[k], m, plain)[1], miss)) if held[k] else -math.inf for k, m in kinds.items()}
    formats = {"kinds": kinds, "plain": plain, "floors": floors, "odds": 0.0}
    while ordinary:
        taken = judge(ordinary, formats)[1]
        if not taken.any():
            break
        ordinary = [s for s, t in zip(ordinary, taken) if not t]
        formats["plain"] = infer(ordinary, alpha) if ordinary else None
    return formats | {"odds": math.log(odds)}


def _each(tokens: list[str], model: tuple, plain: tuple | None) -> tuple[np.ndarray, np.ndarray]:
    """(log odds against an ordinary token, log likelihood per symbol) of each token."""
    if not tokens:
        return np.zeros(0), np.zeros(0)
    own = log_likelihood(tokens, model)
    other = log_likelihood(tokens, plain) if plain is not None else np.full(len(tokens), -math.inf)
    return own - other, own / (np.array([len(t) for t in tokens]) + 1)


def judge(tokens: list[str], formats: dict) -> tuple[np.ndarray, np.ndarray]:
    """(score, accepted): the best log odds over the kinds, and whether a kind accepts the token."""
    score, accepted = np.full(len(tokens), -math.inf), np.zeros(len(tokens), bool)
    for kind, model in formats["kinds"].items():
        odds, fit = _each(tokens, model, formats["plain"])
        score = np.maximum(score, odds)
        accepted |= (odds > formats["odds"]) & (fit >= formats["floors"][kind])
    return score, accepted


def secret_spans(docs: DataFrame, formats: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for every row of ``docs``: an array of (kind, start, stop, secret, score) by start and
    kind, positions in code points, ``stop`` exclusive, ``score`` the log odds of the secret's format
    (null without an automaton).

    Whole texts are read; a null text has no spans. Rows that repeat an id, or each other, each give
    their own. Spans of the fixed patterns may overlap those of another, and start ties go by kind;
    ``grammar`` spans overlap nothing. The result has these columns only, whatever else is in ``docs``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(formats)  # a few automata of a bounded sample
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(id_col).schema.fields]

    def batches(it: Iterator) -> Iterator:
        import pyarrow as pa

        find, model = Finder(), shared.value
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("secret", pa.string()), ("score", pa.float64())])
        for batch in it:
            row, out = 0, []
            for texts in grouped((t.decode("utf-8", "replace") if t else "") for t in batch.column(1).to_pylist()):
                found = []
                for text in texts:
                    base = find.base(text)
                    found.append((base, find.others(text, base)))
                place = {}
                for base, others in found:
                    for s in [b[3] for b in base] + [o[2] for o in others]:
                        place.setdefault(s, len(place))
                score, accepted = judge(list(place), model)
                for base, others in found:
                    spans = [(k, a, z, s) for k, a, z, s in base] + [(3, a, z, s) for a, z, s in others if accepted[place[s]]]
                    value = lambda s: float(v) if np.isfinite(v := score[place[s]]) else None
                    out.append([{"kind": KINDS[k], "start": a, "stop": z, "secret": s, "score": value(s)} for k, a, z, s in sorted(spans, key=lambda s: (s[1], s[0]))])
                row += len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(span))], names=[id_col, "spans"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("__text"))
    return rows.mapInArrow(batches, f"{kinds[0]}, spans array<struct<kind:string,start:bigint,stop:bigint,secret:string,score:double>>")
