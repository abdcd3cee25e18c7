"""Toxicity by subword bags: character n-gram vectors, averaged into a linear softmax.

A word is the mean of the vectors of its hashed character n-grams, a window of
consecutive words is the mean of its words, and a softmax over two classes reads the window. Vectors
and softmax are trained jointly in numpy by Adagrad. Since words enter only through n-grams, a
misspelling never seen shares most of its vector with the word it was made from.

Labels belong to documents, while a few words make a document toxic. So training starts from
windows that carry their document's label, and then, epoch by epoch, keeps as positive only the
windows of a toxic document that the model itself finds most toxic. A document's score is a
logistic function of its most toxic window and of its number of windows, fitted on a part of the
sample that the vectors have not seen.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from weftwork.llm.chunks import open_shared, share


@dataclass
class Settings:
    buckets: int = 1 << 16
    dim: int = 8
    window: int = 4
    grams: tuple[int, int] = (3, 5)
    #: Passes over the windows: as many as make ``steps`` batches, within these bounds.
    epochs: tuple[int, int] = (6, 60)
    steps: int = 1500
    #: Batches before the model picks the positive windows itself.
    warm_up: int = 200
    batch: int = 2048
    rate: float = 0.1
    seed: int = 42
    #: Bound of the labelled sample: documents of each class, and characters in all.
    toxic_docs: int = 2_000
    clean_docs: int = 4_000
    sample_chars: int = 16_000_000


def split_words(text: str | None) -> list[str]:
    import re

    return re.findall(r"\w+", text.lower()) if text else []


def word_buckets(word: str, buckets: int, low: int, high: int) -> list[int]:
    from zlib import crc32

    framed = f"<{word}>"
    grams = [framed[i : i + n] for n in range(low, high + 1) for i in range(len(framed) - n + 1)]
    return [crc32(g.encode("utf-8", "surrogatepass")) % buckets for g in grams or [framed]]


def _window_sums(values: np.ndarray, width: int) -> np.ndarray:
    """The mean of each window; a short last window counts as half a window at least."""
    starts = np.arange(0, len(values), width)
    sizes = np.minimum(width, len(values) - starts)
    return np.add.reduceat(values, starts) / np.maximum(sizes, width // 2)


@dataclass
class Model:
    """``logits``: what each bucket adds to the log odds; ``rise`` turns (most toxic window,
    log number of windows, 1) into a document's log odds; ``prior`` is the score of an empty text."""

    logits: np.ndarray
    rise: np.ndarray
    prior: float
    settings: Settings


def document_scorer(model: Model):
    """A function from a text to its score; words already seen are looked up."""
    s, known, held = model.settings, {}, [0]  # characters of the words kept
    low, high = s.grams

    def score(text: str | None) -> float:
        words = split_words(text)
        if not words:
            return model.prior
        new = set(words).difference(known)
        if len(known) > 400_000 or held[0] > 16_000_000:
            known.clear()
            held[0], new = 0, set(words)
        held[0] += sum(map(len, new))
        for w in new:
            known[w] = float(model.logits[word_buckets(w, s.buckets, low, high)].mean())
        values = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
        means = _window_sums(values, s.window)
        z = model.rise @ np.array([means.max(), np.log(len(means)), 1.0])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return score


class Lexicon:
    """The words of a sample as numbers, and the n-gram buckets of each: arrays instead of strings,
    since the sample stays in the driver's memory."""

    def __init__(self, texts: list[str | None], s: Settings):
        self.index: dict[str, int] = {}
        grams, sizes, self.docs = array("i"), array("i"), []
        for text in texts:
            words = split_words(text)
            for w in words:
                if w not in self.index:
                    self.index[w] = len(self.index)
                    buckets = word_buckets(w, s.buckets, *s.grams)
                    grams.extend(buckets)
                    sizes.append(len(buckets))
            self.docs.append(np.fromiter(map(self.index.__getitem__, words), np.int32, len(words)))
        self.grams, self.sizes = np.array(grams, np.int32), np.array(sizes, np.int64)
        self.start = np.cumsum(self.sizes) - self.sizes

    def word_logits(self, per_bucket: np.ndarray) -> np.ndarray:
        return np.add.reduceat(per_bucket[self.grams], self.start) / self.sizes


def _train_vectors(lexicon: Lexicon, docs: list[np.ndarray], toxic: np.ndarray, s: Settings) -> np.ndarray:
    """The bucket logits after joint training of vectors and softmax."""
    rng = np.random.default_rng(s.seed)
    grams, gram_sizes, gram_at = lexicon.grams, lexicon.sizes, lexicon.start

    # windows as rows of word numbers; -1 is the padding at the end
    rows, owner, lengths = [], [], []
    for d, words in enumerate(docs):
        n = -(-len(words) // s.window)
        padded = np.full(n * s.window, -1, np.int32)
        padded[: len(words)] = words
        rows.append(padded.reshape(n, s.window))
        owner.append(np.full(n, d, np.int32))
        lengths.append(np.minimum(s.window, len(words) - np.arange(n) * s.window))
    windows, owner = np.concatenate(rows), np.concatenate(owner)
    sizes = np.maximum(np.concatenate(lengths), s.window // 2).astype(np.float32)

    # vectors start at zero, so that n-grams never seen in training say nothing
    vec = np.zeros((s.buckets, s.dim), np.float32)
    out = rng.normal(0, 0.3, (s.dim, 2)).astype(np.float32)
    bias, vec_g, out_g = np.zeros(2, np.float32), np.full((s.buckets, s.dim), 1e-4, np.float32), np.full((s.dim, 2), 1e-2, np.float32)

    def window_logits() -> np.ndarray:
        per_word = np.append(lexicon.word_logits(vec @ (out[:, 1] - out[:, 0])), 0)  # -1 is the pad
        return per_word[windows].sum(axis=1) / sizes

    label = toxic[owner]
    use = np.arange(len(windows))
    for epoch in range(int(np.clip(-(-s.steps * s.batch // len(windows)), *s.epochs))):
        if epoch * len(windows) >= s.warm_up * s.batch or epoch and len(windows) >= s.warm_up * s.batch:
            z = window_logits()
            top = np.full(len(docs), -np.inf)
            np.maximum.at(top, owner, z)
            # of a toxic document: its best window, and those nearly as good that no clean text has;
            # of the clean ones: those taken for toxic most, and a part of the others
            clean = z[label == 0]
            bar, hard = (np.quantile(clean, 0.999), np.quantile(clean, 0.8)) if len(clean) else (-np.inf, 0)
            best = (label == 1) & (z >= np.maximum(np.minimum(top[owner], bar), top[owner] * 0.6))
            use = np.flatnonzero(best | (label == 0) & ((z >= hard) | (rng.random(len(z)) < 0.1)))
        share = max(1, int((label[use] == 1).sum()))
        weight = np.where(label == 1, min(20.0, max(1.0, (len(use) - share) / share / 2)), 1.0).astype(np.float32)
        order = rng.permutation(use)
        for start in range(0, len(order), s.batch):
            pick = order[start : start + s.batch]
            batch, n = windows[pick], sizes[pick]
            uniq, inv = np.unique(batch, return_inverse=True)
            inv = inv.reshape(batch.shape)
            real = uniq[uniq >= 0]
            if not len(real):
                continue
            pad = len(uniq) - len(real)
            lens = gram_sizes[real]
            spans = np.repeat(gram_at[real] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
            ids = grams[spans]
            wv = np.zeros((len(uniq), s.dim), np.float32)
            wv[pad:] = np.add.reduceat(vec[ids], np.cumsum(lens) - lens, axis=0) / lens[:, None]
            mean = wv[inv].sum(axis=1) / n[:, None]
            z = mean @ out + bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), label[pick]] -= 1
            g = p * (weight[pick] / weight[pick].sum())[:, None]
            g_out, g_mean = mean.T @ g, (g @ out.T) / n[:, None]
            g_word = np.stack([np.bincount(inv.ravel(), np.repeat(g_mean[:, k], s.window), len(uniq)) for k in range(s.dim)], axis=1)[pad:]
            spread = np.repeat(g_word / lens[:, None], lens, axis=0)
            touched, slot = np.unique(ids, return_inverse=True)
            g_vec = np.stack([np.bincount(slot, spread[:, k], len(touched)) for k in range(s.dim)], axis=1).astype(np.float32)
            g_vec *= len(pick) / s.window  # the mean over the batch, back to the scale of a word
            vec_g[touched] += g_vec**2
            vec[touched] -= s.rate * g_vec / np.sqrt(vec_g[touched])
            out_g += g_out**2
            out -= s.rate * g_out / np.sqrt(out_g)
            bias -= s.rate * g.sum(axis=0)
    return (vec @ (out[:, 1] - out[:, 0])).astype(np.float64)


def _fit_rise(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] * (x.shape[1] - 1) + [1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * np.maximum(p * (1 - p), 1e-9)[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[str | None], toxic: list[int], settings: Settings | None = None) -> Model:
    """Train on a sample of texts with labels 0 and 1. With one class only, every score is that class's share."""
    s = settings or Settings()
    y = np.array(toxic, np.int64)
    lexicon = Lexicon(texts, s)
    full = np.flatnonzero([len(d) > 0 for d in lexicon.docs])
    prior = float(y.mean()) if len(y) else 0.0
    if len(set(y[full].tolist())) < 2:
        return Model(np.zeros(s.buckets), np.array([0.0, 0.0, 30.0 * (2 * prior - 1)]), prior, s)
    order = full[np.random.default_rng(s.seed).permutation(len(full))]
    aside = np.concatenate([order[y[order] == c][::4] for c in (0, 1)])  # every fourth of each class
    learn = np.setdiff1d(full, aside)
    if len(set(y[learn].tolist())) < 2:
        learn = full
    logits = _train_vectors(lexicon, [lexicon.docs[i] for i in learn], y[learn], s)
    per_word, x = lexicon.word_logits(logits), []
    for i in aside:
        means = _window_sums(per_word[lexicon.docs[i]], s.window)
        x.append([means.max(), np.log(len(means)), 1.0])
    return Model(logits, _fit_rise(np.array(x), y[aside].astype(float)), prior, s)


def held_out(id_col: str = "doc_id") -> Column:
    """Documents whose labels are never learnt from; a null id counts as an empty one."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", settings: Settings | None = None):
    """Texts and labels of at most ``toxic_docs`` + ``clean_docs`` documents and ``sample_chars``
    characters, drawn by a hash of the id from the labelled rows that are not held out. Each class has
    its share of the characters; a document that does not fit is passed over."""
    s = settings or Settings()
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("__lid")).agg(F.max(F.col(label_col).cast("int")).alias("__toxic"))
    drawn = known.withColumn("__draw", F.xxhash64(F.lit(s.seed), "__lid"))
    picked = drawn.filter("__toxic = 1").orderBy("__draw", "__lid").limit(s.toxic_docs).union(drawn.filter("__toxic = 0").orderBy("__draw", "__lid").limit(s.clean_docs))
    rows = docs.select(F.col(id_col).alias("__lid"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).join(F.broadcast(picked), "__lid")
    limit = s.toxic_docs + s.clean_docs
    sizes = rows.select("__toxic", "__draw", F.length("__text").alias("__n"))
    left, fitting = {}, {}
    for toxic, docs_of in ((1, s.toxic_docs), (0, s.clean_docs)):
        left[toxic] = s.sample_chars * docs_of // limit
        for r in sizes.filter(F.col("__toxic") == toxic).orderBy("__draw", "__n").limit(docs_of).collect():
            if r["__n"] <= left[toxic]:
                left[toxic] -= r["__n"]
                fitting[toxic, r["__draw"], r["__n"]] = fitting.get((toxic, r["__draw"], r["__n"]), 0) + 1
    if not fitting:
        return [], []
    wanted = docs.sparkSession.createDataFrame([(*k, n) for k, n in fitting.items()], "__toxic int, __draw bigint, __n int, __most int")
    same = Window.partitionBy("__toxic", "__draw", "__n").orderBy("__text")  # rows of one id and length
    fits = rows.withColumn("__n", F.length("__text")).join(F.broadcast(wanted), ["__toxic", "__draw", "__n"])
    chosen = fits.withColumn("__k", F.row_number().over(same)).filter("__k <= __most").select("__draw", "__text", "__toxic")
    got = sorted((r["__draw"], r["__text"], r["__toxic"]) for r in chosen.collect())
    return [g[1] for g in got], [g[2] for g in got]


def score_column(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The score of each row's whole text; null and empty texts get the prior."""
    shared = share(docs.sparkSession, model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = document_scorer(open_shared(shared))
        for batch in texts:
            yield pd.Series([scorer(t) for t in batch], dtype="float64")

    return score(F.col(text_col))


def fit_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", settings: Settings | None = None) -> Model:
    return fit(*labelled_sample(docs, labels, id_col, text_col, label_col, settings), settings)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", settings: Settings | None = None) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``score`` and ``predicted`` (score >= 0.5).

    Only texts are scored; labels are learnt from rows that are not held out. Null labels are left
    out, a document labelled twice is toxic if any label says so. Without labels every score is 0. Rows
    that repeat an id or a text each have a row, and equal texts equal scores; null and empty texts have
    that of no evidence. Texts are read whole. Other columns are not looked at.
    """
    model = fit_model(docs, labels, id_col, text_col, label_col, settings)
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), score_column(docs, model, text_col).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", settings: Settings | None = None) -> DataFrame:
    """The rows of ``docs`` whose score is below 0.5, with all their columns."""
    model = fit_model(docs, labels, id_col, text_col, label_col, settings)
    return docs.filter(score_column(docs, model, text_col) < 0.5)
