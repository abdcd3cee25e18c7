"""TF-IDF vectors as a fitted stage: what ``terms.tfidf`` gives as a long table, for models."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import ElementwiseProduct, Normalizer
from pyspark.ml.linalg import DenseVector, VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from weftwork.operators.scan import top_rows


def rows_of(struct) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each row, indices, values) of an Arrow column of vectors, sparse or dense."""
    import pyarrow.compute as pc

    kind = pc.struct_field(struct, "type").to_numpy(zero_copy_only=False)
    indices, values = pc.struct_field(struct, "indices"), pc.struct_field(struct, "values")
    sizes = pc.list_value_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flat = pc.list_flatten(values).to_numpy(zero_copy_only=False)
    if (kind == 0).all():
        return starts, pc.list_flatten(indices).to_numpy(zero_copy_only=False), flat
    places = np.arange(len(flat)) - np.repeat(starts[:-1], sizes)  # of a dense row
    sparse = np.repeat(kind == 0, sizes)
    places[sparse] = pc.list_flatten(indices).to_numpy(zero_copy_only=False)
    return starts, places, flat


def sparse_column(size: int, starts: np.ndarray, indices: np.ndarray, values: np.ndarray):
    """An Arrow column of sparse vectors."""
    import pyarrow as pa

    n, offsets = len(starts) - 1, pa.array(starts, pa.int32())
    return pa.StructArray.from_arrays(
        [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), pa.ListArray.from_arrays(offsets, pa.array(indices, pa.int32())),
         pa.ListArray.from_arrays(offsets, pa.array(values, pa.float64()))],
        names=["type", "size", "indices", "values"])


#: Bytes of rows that a task works on at a time: what it builds for them is several times as much, and for
#: texts, whose n-grams it cuts, some fifty times.
SLICE_BYTES, TEXT_BYTES = 8_000_000, 500_000
#: N-grams that a task counts before it hands the counts on.
KNOWN_GRAMS = 300_000
#: Rows of a long table that a task hands on at a time.
LONG_ROWS = 200_000


def slices(it: Iterator, size: int = SLICE_BYTES) -> Iterator:
    """Arrow batches cut into pieces of some ``size`` bytes."""
    for batch in it:
        step = max(1, int(batch.num_rows * size / max(batch.nbytes, size)))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def word_grams(word: str, lo: int, hi: int) -> list[str]:
    """The n-grams of a word with a blank on both sides, repeats included; a shorter one gives itself."""
    padded = f" {word} "
    if len(padded) < lo:
        return [padded]
    return [padded[i : i + n] for n in range(lo, hi + 1) for i in range(len(padded) - n + 1)]


def gram_keys(texts: list[str], lo: int, hi: int, across: bool = False):
    """(row, key, times, alphabet) of the distinct n-grams inside the words of texts, or ``across`` them, by row
    and key: a key is the places of its characters in the alphabet, from 1, as digits. None if they do not fit
    in 63 bits."""
    chars = np.frombuffer((" " + "  ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    there = np.zeros(0x110000, bool)
    there[chars] = True
    alphabet = np.flatnonzero(there)
    base = len(alphabet) + 1
    if base**hi >= 2**63 or not across and lo != 3:  # a blank on both sides leaves no word shorter than 3
        return None
    starts = np.cumsum([0] + [len(t) + 2 for t in texts])
    digit = np.zeros(0x110000, np.int64)
    digit[alphabet] = np.arange(1, base)
    digits, inside = digit[chars], chars != 32
    if across:  # only the blanks around a text part grams
        inside = np.ones(len(chars), bool)
        inside[starts[:-1]] = inside[starts[1:] - 1] = False
    # a gram's last place is n - 1 on; of words, blanks are at its ends alone
    keys, found, places = np.zeros(len(chars), np.int64), [], []
    valid = np.ones(len(chars), bool)
    for n in range(1, hi + 1):
        size = max(len(chars) - n + 1, 0)
        keys, valid = keys[:size] + digits[n - 1 :] * base ** (hi - n), valid[:size]
        if across:
            valid = valid & inside[n - 1 : n - 1 + size]
        elif n > 2:
            valid = valid & inside[n - 2 : n - 2 + size]
        if n >= lo:
            at = np.flatnonzero(valid)
            found.append(keys[at])
            places.append(at)
    bounds = [np.searchsorted(at, starts) for at in places]
    rows, out, times = [], [], []
    for i in range(len(texts)):
        mine = np.sort(np.concatenate([k[b[i] : b[i + 1]] for k, b in zip(found, bounds)]))
        if len(mine):
            first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
            out.append(mine[first])
            times.append(np.diff(first, append=len(mine)))
            rows.append(np.full(len(first), i))
    none = np.zeros(0, np.int64)
    return *(np.concatenate([none, *parts]) for parts in (rows, out, times)), alphabet


def code_points(terms: list[str], hi: int) -> np.ndarray:
    """A row of ``hi`` code points for each term, one beyond all of them after its last."""
    there = np.arange(hi) < np.array([len(t) for t in terms], int)[:, None]
    out = np.full(there.shape, 0x110000, np.uint32)
    out[there] = np.frombuffer("".join(t[:hi] for t in terms).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def keys_of(points: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """The keys of terms given as ``code_points``, -1 if the alphabet lacks a character."""
    digit = np.full(0x110001, -1, np.int64)
    digit[alphabet] = np.arange(1, len(alphabet) + 1)
    digit[0x110000] = 0
    digits, base, hi = digit[points], len(alphabet) + 1, points.shape[1]
    keys = digits @ np.array([base ** (hi - n) for n in range(1, hi + 1)], np.int64)
    return np.where((digits < 0).any(axis=1), -1, keys)


def terms_of(keys: np.ndarray, alphabet: np.ndarray, hi: int) -> list[str]:
    chars = np.concatenate([[0], alphabet]).astype(np.uint32)
    base = len(alphabet) + 1
    digits = np.stack([keys // base ** (hi - n) % base for n in range(1, hi + 1)], axis=1)
    sizes = (digits > 0).sum(axis=1).tolist()
    flat = chars[digits].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [flat[i * hi : i * hi + size] for i, size in enumerate(sizes)]


def counted_grams(texts: list[str | None], lo: int, hi: int, across: bool = False) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """(row, grams, times) of each text, for those that ``gram_keys`` has no keys for."""
    for row, text in enumerate(texts):
        counts: dict[str, int] = {}
        if across:
            counts = Counter(text[i : i + n] for n in range(lo, hi + 1) for i in range(len(text) - n + 1)) if text else counts
        else:
            for word, k in Counter((text or "").split(" ")).items():
                for g in word_grams(word, lo, hi) if word else ():
                    counts[g] = counts.get(g, 0) + k
        yield row, list(counts), np.array(list(counts.values()), np.int64)


def gram_stats(texts: DataFrame, lo: int, hi: int, across: bool = False) -> DataFrame:
    """(term, df, cf) of the n-grams of the one text column of ``texts``: counted in the tasks, so that only
    sums are shuffled."""

    def sums_of(rows: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        cut = gram_keys(rows, lo, hi, across)
        if cut is None:
            for _, grams, times in counted_grams(rows, lo, hi, across):
                yield grams, np.ones(len(grams), np.int64), times
        else:
            _, key, times, alphabet = cut
            order = np.argsort(key)
            key, times = key[order], times[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            yield terms_of(key[first], alphabet, hi), np.diff(first, append=len(key)), np.add.reduceat(times, first) if len(first) else first

    def count(it: Iterator) -> Iterator:
        import pyarrow as pa

        numbers: dict[str, int] = {}
        sums = np.zeros((2, KNOWN_GRAMS), np.int64)
        names = ["term", "df", "cf"]
        for batch in slices(it, TEXT_BYTES):
            for grams, df, cf in sums_of([t or "" for t in batch.column(0).to_pylist()]):
                at = np.fromiter((numbers.setdefault(g, len(numbers)) for g in grams), np.int64, len(grams))
                if len(numbers) > sums.shape[1]:
                    sums = np.pad(sums, ((0, 0), (0, 2 * len(numbers) - sums.shape[1])))
                sums[0, at] += df  # each gram is there once
                sums[1, at] += cf
                if len(numbers) >= KNOWN_GRAMS:
                    yield pa.RecordBatch.from_arrays([pa.array(list(numbers), pa.string()), *(pa.array(x[: len(numbers)].copy()) for x in sums)], names=names)
                    numbers.clear()
                    sums[:] = 0
        if numbers:
            yield pa.RecordBatch.from_arrays([pa.array(list(numbers), pa.string()), *(pa.array(x[: len(numbers)].copy()) for x in sums)], names=names)

    parts = texts.mapInArrow(count, "term string, df bigint, cf bigint")
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def with_column(df: DataFrame, name: str, add, kind=None, size: int = SLICE_BYTES) -> DataFrame:
    """``df`` and a column made in Arrow batches: ``add`` takes a batch, of some ``size`` bytes, and gives
    the column."""
    fields = [f for f in df.schema.fields if f.name != name]

    def batches(it: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(it, size):
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(f)) for f in names], add(batch)], names=[*names, name])

    names = [f.name for f in fields]
    return df.mapInArrow(batches, StructType([*fields, StructField(name, kind or VectorUDT())]))


class _TermParams(HasInputCol, HasOutputCol):
    maxFeatures = Param(Params._dummy(), "maxFeatures", "terms kept, those with the highest corpus counts", TypeConverters.toInt)
    minDF = Param(Params._dummy(), "minDF", "documents a term must be in", TypeConverters.toInt)
    sublinear = Param(Params._dummy(), "sublinear", "whether a count n weighs 1 + ln n", TypeConverters.toBoolean)
    grams = Param(Params._dummy(), "grams", "least and largest size of the character n-grams of a text; none: the input is counts", TypeConverters.toListInt)
    across = Param(Params._dummy(), "across", "whether n-grams run across words", TypeConverters.toBoolean)

    def _defaults(self) -> None:
        self._setDefault(inputCol="counts", outputCol="tfidf", maxFeatures=50_000, minDF=2, sublinear=True, grams=[], across=False)

    def _slice_bytes(self) -> int:
        return TEXT_BYTES if self.getOrDefault("grams") else SLICE_BYTES


class TermVectorizer(Estimator, _TermParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits terms and idf on a column of counts (array of (term, n), one entry per term, as
    ``terms.run_lengths`` gives), or with ``grams`` (least and largest size) on a column of texts, whose
    words blanks part: its terms are the n-grams that ``terms.gram_counts`` counts inside words, or ``across``
    them, cut where the text is, so that no table of counts is built. idf is ln((1 + N) / (1 + df)) + 1; ties at
    ``maxFeatures`` go by term. The model holds ``maxFeatures`` terms at most."""

    @keyword_only
    def __init__(self, *, inputCol="counts", outputCol="tfidf", maxFeatures=50_000, minDF=2, sublinear=True, grams=(), across=False):
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> TermVectorizerModel:
        grams = self.getOrDefault("grams")
        if grams:
            stats = gram_stats(dataset.select(self.getInputCol()), *grams, self.getOrDefault("across"))
        else:
            entries = dataset.select(F.explode(self.getInputCol()).alias("c")).select("c.term", "c.n")
            stats = entries.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("cf"))
        stats = stats.filter(F.col("df") >= self.getOrDefault("minDF"))
        kept = top_rows(stats, [F.desc("cf"), "term"], self.getOrDefault("maxFeatures")).select("term", "df").orderBy("term").collect()
        n = dataset.count()
        idf = np.log((1.0 + n) / (1.0 + np.array([r["df"] for r in kept], float))) + 1.0
        model = TermVectorizerModel([r["term"] for r in kept], idf)
        return self._copyValues(model)


class TermVectorizerModel(Model, _TermParams, MLWritable, MLReadable):
    """Adds unit-length TF-IDF vectors; terms it does not know count for nothing."""

    def __init__(self, terms: list[str] = (), idf: np.ndarray = ()):
        super().__init__()
        self._defaults()
        self.terms, self.idf = list(terms), np.asarray(idf, float)

    def _reader(self, dataset: DataFrame):
        """A function of a batch: (its rows, row, place and count of each known entry by row and place)."""
        source, grams, across = self.getInputCol(), self.getOrDefault("grams"), self.getOrDefault("across")
        words = dataset.sparkSession.sparkContext.broadcast(self.terms)  # at most maxFeatures terms
        known: dict[str, object] = {}  # of this task: terms as code points, and their places

        def cut(batch):
            lo, hi = grams
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(source)).to_pylist()]
            keyed = gram_keys(texts, lo, hi, across)
            if keyed is None:
                if "places" not in known:
                    known["places"] = {t: i for i, t in enumerate(words.value)}
                parts = [(row, known["places"][g], n) for row, found, times in counted_grams(texts, lo, hi, across) for g, n in zip(found, times) if g in known["places"]]
                row, place, n = np.array(parts, np.int64).reshape(-1, 3).T
            else:
                row, key, n, alphabet = keyed
                if "terms" not in known:
                    known["terms"] = code_points(words.value, hi)
                mine = keys_of(known["terms"], alphabet)
                order = np.argsort(mine)
                at = np.searchsorted(mine, key, sorter=order)
                place = order[np.minimum(at, len(order) - 1)] if len(order) else at
                hit = mine[place] == key if len(order) else np.zeros(len(key), bool)
                row, place, n = row[hit], place[hit], n[hit]
            order = np.lexsort((place, row))
            return len(texts), row[order], place[order], n[order].astype(float)

        def look_up(batch):
            import pyarrow as pa
            import pyarrow.compute as pc

            counts = batch.column(batch.schema.get_field_index(source))
            sizes = pc.fill_null(pc.list_value_length(counts), 0).to_numpy(zero_copy_only=False)
            flat = pc.list_flatten(counts)
            place = pc.fill_null(pc.index_in(pc.struct_field(flat, "term"), value_set=pa.array(words.value, pa.string())), -1).to_numpy(zero_copy_only=False)
            n = pc.struct_field(flat, "n").to_numpy(zero_copy_only=False).astype(float)
            row = np.repeat(np.arange(len(sizes)), sizes)
            known = place >= 0
            row, place, n = row[known], place[known], n[known]
            order = np.lexsort((place, row))
            return len(sizes), row[order], place[order], n[order]

        return (cut if grams else look_up), words

    def _weigher(self, dataset: DataFrame, unit: bool = True):
        """A function of a batch: (its rows, row, place and weight of each known entry by row and place).
        Weights are of unit length per row, or as they are if not ``unit``."""
        sublinear = self.getOrDefault("sublinear")
        read, words = self._reader(dataset)
        shared = dataset.sparkSession.sparkContext.broadcast(self.idf)  # at most maxFeatures numbers

        def weigh(batch):
            rows, row, place, n = read(batch)
            w = (1.0 + np.log(n) if sublinear else n) * shared.value[place]
            return rows, row, place, w / np.sqrt(np.bincount(row, w * w, rows))[row] if unit else w

        return weigh, words

    def _vectors(self, dataset: DataFrame, name: str, weigh) -> DataFrame:
        size = len(self.terms)

        def add(batch):
            rows, row, place, w = weigh(batch)
            starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))])
            return sparse_column(size, starts, place, w)

        return with_column(dataset, name, add, size=self._slice_bytes())

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self._vectors(dataset, self.getOutputCol(), self._weigher(dataset)[0])

    def written(self, dataset: DataFrame, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``transform`` without the input column, with what ``write`` reads again between the counts and
        their weights: counts have few values, so that a columnar file of them is a fraction of the vectors'."""
        sublinear = self.getOrDefault("sublinear")
        read, _ = self._reader(dataset)

        def counted(batch):
            rows, row, place, n = read(batch)
            return rows, row, place, 1.0 + np.log(n) if sublinear else n

        rows = write(self._vectors(dataset, "_tf", counted).drop(self.getInputCol()))
        weighed = ElementwiseProduct(scalingVec=DenseVector(self.idf), inputCol="_tf", outputCol="_w").transform(rows)
        return Normalizer(p=2.0, inputCol="_w", outputCol=self.getOutputCol()).transform(weighed).drop("_tf", "_w")

    def weights(self, dataset: DataFrame, id_col: str, unit: bool = True) -> DataFrame:
        """The same in long form: (id, term, tfidf), each row of ``dataset`` being one document."""
        weigh, words = self._weigher(dataset, unit)
        size = self._slice_bytes()

        def batches(it: Iterator) -> Iterator:
            import pyarrow as pa

            known = pa.array(words.value, pa.string())
            for batch in slices(it, size):
                _, row, place, w = weigh(batch)
                for i in range(0, len(row), LONG_ROWS):
                    ids, named = (c.take(pa.array(at[i : i + LONG_ROWS], pa.int64())) for c, at in ((batch.column(0), row), (known, place)))
                    yield pa.RecordBatch.from_arrays([ids, named, pa.array(w[i : i + LONG_ROWS])], names=[id_col, "term", "tfidf"])

        kind = dict(dataset.dtypes)[id_col]
        return dataset.select(id_col, self.getInputCol()).mapInArrow(batches, f"{id_col} {kind}, term string, tfidf double")

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader(cls)


class _ModelWriter(MLWriter):
    def __init__(self, instance: TermVectorizerModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        rows = [(i, t, float(v)) for i, (t, v) in enumerate(zip(self.instance.terms, self.instance.idf))]
        self.sparkSession.createDataFrame(rows, "i int, term string, idf double").write.parquet(f"{path}/terms")


class _ModelReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> TermVectorizerModel:
        session = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, session)
        rows = session.read.parquet(f"{path}/terms").orderBy("i").collect()
        model = self.cls([r["term"] for r in rows], [r["idf"] for r in rows])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
