"""Token dictionaries, bags of words, n-gram counts and TF-IDF as long tables.

A document is a row, or all rows of one ``by`` key. Counts are combined map side before every
shuffle, so frequent terms do not make hot tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftwork.functions import text as T
from weftwork.functions.frame import broadcast_if_small, explode_rows, one_row
from weftwork.operators.scan import number_rows, prefix_scan, top_rows
from weftwork.operators.vectorize import TermVectorizer, TermVectorizerModel
from weftwork.session import write_once


def run_lengths(df: DataFrame, id_cols: Sequence[str], tokens: Column) -> DataFrame:
    """(ids, counts: array of (term, n)) per row, counted inside the row without a shuffle."""
    rows = df.select(*id_cols, F.sort_array(tokens).alias("_s"))
    # positions at which a new term starts; the position before the first one is null
    starts = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: ~F.get("_s", i).eqNullSafe(F.get("_s", i - 1)))
    rows = rows.withColumn("_at", F.when(F.size("_s") > 0, starts).otherwise(F.array().cast("array<int>")))
    ends = F.concat(F.slice("_at", F.lit(2), F.size("_at")), F.array(F.size("_s")))
    counted = F.zip_with(
        F.col("_at"), ends, lambda a, b: F.struct(F.get("_s", a).alias("term"), (b - a).cast("bigint").alias("n"))
    )
    none = F.array().cast("array<struct<term:string,n:bigint>>")
    return rows.select(*id_cols, F.when(F.size("_at") > 0, counted).otherwise(none).alias("counts"))


#: Entries that leave a task in one batch, but for those of one row, and words whose grams a task remembers.
BATCH_ENTRIES, KNOWN_WORDS = 200_000, 50_000


def gram_text(text: Column, within_words: bool = True) -> Column:
    """A text with a blank for each run of white space, or of two or more, as ``TermVectorizer`` cuts into
    n-grams inside words, or across them."""
    return F.regexp_replace(text, rf"{T.SPACE}+" if within_words else rf"{T.SPACE}{T.SPACE}+", " ")


def gram_counts(df: DataFrame, id_cols: Sequence[str], text: Column, lo: int, hi: int, within_words: bool = True) -> DataFrame:
    """(ids, counts: array of (term, n), in no order) per row: what ``run_lengths`` gives for
    ``T.word_char_ngrams`` or ``T.char_ngrams``. A list of all grams of a text is never built, and the
    grams of a word are cut once for all its places."""
    id_cols = list(id_cols)
    rows = df.select(*id_cols, gram_text(text, within_words).alias("_s"))

    def cut(s: str) -> Iterator[str]:
        return (s[i : i + n] for n in range(lo, hi + 1) for i in range(len(s) - n + 1))

    def count(s: str, known: dict) -> dict[str, int]:
        if not within_words:
            return Counter(cut(s))
        out: dict[str, int] = {}
        for word, k in Counter(s.split(" ")).items():
            grams = known.get(word)
            if grams is None:
                padded = f" {word} "
                grams = () if not word else (padded,) if len(padded) < lo else tuple(cut(padded))
                if len(known) >= KNOWN_WORDS:
                    known.clear()
                if len(word) <= 32:
                    known[word] = grams
            for g in grams:
                out[g] = out.get(g, 0) + k
        return out

    def batches(it: Iterator) -> Iterator:
        import pyarrow as pa

        known: dict[str, tuple] = {}
        for batch in it:
            source, first, names, ns, ends = batch.column(len(id_cols)), 0, [], [], [0]
            for i in range(batch.num_rows):
                counts = count(source[i].as_py() or "", known)
                names.extend(counts)
                ns.extend(counts.values())
                ends.append(len(ns))
                if len(ns) < BATCH_ENTRIES and i + 1 < batch.num_rows:
                    continue
                entries = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(ns, pa.int64())], names=["term", "n"])
                ids = [batch.column(j).slice(first, i + 1 - first) for j in range(len(id_cols))]
                yield pa.RecordBatch.from_arrays([*ids, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)], names=[*id_cols, "counts"])
                first, names, ns, ends = i + 1, [], [], [0]

    kinds = "".join(f"{n} {t}, " for n, t in rows.dtypes[:-1])
    return rows.mapInArrow(batches, f"{kinds}counts array<struct<term:string,n:bigint>>")


def document_terms(df: DataFrame, id_col: str, tokens: Column | None, once: bool = False) -> DataFrame:
    """(id, term, n), one row of ``df`` being one document; without ``tokens``, ``df`` has the ``counts``
    that ``run_lengths`` gives. ``once``: the counts of each row are written and read again, for a
    result that several jobs or branches use."""
    counted = df.select(id_col, "counts") if tokens is None else run_lengths(df, [id_col], tokens)
    rows = explode_rows(write_once(counted) if once else counted, [id_col], F.col("counts"), "c")
    return rows.select(id_col, "c.term", "c.n")


def group_terms(df: DataFrame, by: str, tokens: Column) -> DataFrame:
    """(by, term, n), all rows of a key being one document."""
    return explode_rows(df, [by], tokens, "term").groupBy(by, "term").agg(F.count(F.lit(1)).alias("n"))


# ---- dictionary and bag of words ---------------------------------------------------------


def token_stats(df: DataFrame, id_col: str, tokens: Column | None) -> DataFrame:
    """(token, df, cf): documents holding the token and its total count; one shuffle on token."""
    return document_terms(df, id_col, tokens).groupBy(F.col("term").alias("token")).agg(
        F.count(F.lit(1)).alias("df"), F.sum("n").alias("cf")
    )


def build_dictionary(stats: DataFrame) -> DataFrame:
    """Adds ``token_id`` 0.. in order of (df descending, token)."""
    return number_rows(stats, [F.desc("df"), F.col("token")], "token_id")


def filter_extremes(stats: DataFrame, documents: int, no_below: int = 2, no_above: float = 0.8, keep_n: int = 100_000) -> DataFrame:
    """Tokens in at least ``no_below`` documents and at most that share, the most frequent kept."""
    return top_rows(_within(stats, documents, no_below, no_above), [F.desc("df"), "token"], keep_n)


def _within(stats: DataFrame, documents: int, no_below: int, no_above: float) -> DataFrame:
    return stats.filter((F.col("df") >= no_below) & (F.col("df") <= F.lit(no_above * documents)))


def kept_dictionary(stats: DataFrame, documents: int, no_below: int = 2, no_above: float = 0.8, keep_n: int = 100_000) -> DataFrame:
    """The dictionary of what ``filter_extremes`` keeps; the numbers that order it also cut it."""
    return build_dictionary(_within(stats, documents, no_below, no_above)).filter(F.col("token_id") < keep_n)


def doc2bow(df: DataFrame, id_col: str, tokens: Column | None, dictionary: DataFrame) -> DataFrame:
    """(id, bow: array of (token_id, n) by token_id) of documents with a dictionary token."""
    long = document_terms(df, id_col, tokens).withColumnRenamed("term", "token")
    pairs = long.join(broadcast_if_small(dictionary.select("token", "token_id")), "token")
    return pairs.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("token_id", "n"))).alias("bow"))


def bag_of_words(df: DataFrame, id_col: str, tokens: Column | None, dictionary: DataFrame) -> DataFrame:
    """The same in long form (id, token_id, n), for further aggregation."""
    long = document_terms(df, id_col, tokens).withColumnRenamed("term", "token")
    return long.join(broadcast_if_small(dictionary.select("token", "token_id")), "token").select(id_col, "token_id", "n")


# ---- frequencies and n-grams -------------------------------------------------------------


def term_frequencies(df: DataFrame, tokens: Column, stop: Sequence[str] = (), top: int | None = None) -> DataFrame:
    ws = explode_rows(df, [], tokens, "term")
    if stop:
        ws = ws.filter(~F.col("term").isin(*stop))
    counts = ws.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return counts if top is None else top_rows(counts, [F.desc("n"), "term"], top)


def boundary_ngrams(df: DataFrame, by: str, order: Sequence[str], tokens: str, n: int) -> DataFrame:
    """(by, term): the n-grams of each group's concatenated tokens that span two or more rows.

    Only the first and last n-1 tokens of a row travel: rows are numbered within their group,
    each hands its tail to the next n-1 rows, and a row joins what it got with its own head.
    Groups of any size work, and the concatenated text is never built.
    """
    narrow = df.select(
        by,
        *order,
        F.slice(tokens, 1, n - 1).alias("_head"),
        F.slice(tokens, F.greatest(F.size(tokens) - F.lit(n - 2), F.lit(1)), F.lit(n - 1)).alias("_tail"),
    ).withColumn("_some", (F.size("_head") > 0).cast("bigint"))
    rows = prefix_scan(narrow, order, {"_i": ("sum", "_some", False)}, by=[by]).filter("_some = 1")
    handed = rows.select(by, "_i", "_tail", F.explode(F.sequence(F.lit(1), F.lit(n - 1))).alias("_d")).select(
        by, (F.col("_i") + F.col("_d")).alias("_i"), F.struct((-F.col("_d")).alias("d"), F.col("_tail").alias("t")).alias("_p")
    )
    before = handed.groupBy(by, "_i").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list("_p")), lambda x: x["t"])).alias("_b")  # at most n-1 parts
    )
    context = F.slice("_b", F.greatest(F.size("_b") - F.lit(n - 2), F.lit(1)), F.lit(n - 1))
    spans = rows.join(before, [by, "_i"]).select(by, context.alias("_c"), F.concat(context, F.col("_head")).alias("_all"))
    starts = F.least(F.size("_c"), F.size("_all") - F.lit(n - 1))
    grams = F.transform(F.sequence(F.lit(1), starts), lambda i: F.array_join(F.slice("_all", i, n), " "))
    return explode_rows(spans, [by], F.when(starts > 0, grams), "term")


def group_ngrams(df: DataFrame, by: str, order: Sequence[str], tokens: str, n: int) -> DataFrame:
    """(by, term) rows: n-grams of each group's concatenated tokens; rows without a group are left out."""
    df = df.filter(F.col(by).isNotNull())
    inside = explode_rows(df, [by], T.ngrams(F.col(tokens), n), "term")
    return inside if n == 1 else inside.unionByName(boundary_ngrams(df, by, order, tokens, n))


def ngram_counts(df: DataFrame, by: str, order: Sequence[str], tokens: str, n: int) -> DataFrame:
    """(term, n) over all groups."""
    return group_ngrams(df, by, order, tokens, n).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def special_bigrams(unigrams: DataFrame, bigrams: DataFrame, k: int = 20, smoothing: float = 50.0) -> DataFrame:
    """Bigrams more frequent than their words suggest: n12 / ((n1 + s)(n2 + s)), top ``k``."""
    pair = F.split("term", " ")
    b = bigrams.select("term", F.col("n").alias("n12"), pair[0].alias("w1"), pair[1].alias("w2"))
    u = unigrams.select("term", "n")
    u1 = u.select(F.col("term").alias("w1"), F.col("n").alias("n1"))
    u2 = u.select(F.col("term").alias("w2"), F.col("n").alias("n2"))
    ratio = F.col("n12") / ((F.col("n1") + smoothing) * (F.col("n2") + smoothing))
    return b.join(u1, "w1").join(u2, "w2").select("term", "n12", ratio.alias("ratio")).orderBy(F.desc("ratio"), "term").limit(k)


# ---- TF-IDF ------------------------------------------------------------------------------


def fit_idf(terms: DataFrame, documents: Column | int, min_df: int = 1, max_features: int | None = None) -> DataFrame:
    """(term, idf) from (id, term, n): ln((1 + N) / (1 + df)) + 1.

    ``max_features`` keeps the terms with the highest corpus counts (ties by term).
    """
    stats = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("cf"))
    if min_df > 1:
        stats = stats.filter(F.col("df") >= min_df)
    if max_features is not None:
        stats = top_rows(stats, [F.desc("cf"), "term"], max_features)
    n = F.lit(documents) if isinstance(documents, int) else documents
    return stats.select("term", (F.log((n + F.lit(1.0)) / (F.col("df") + F.lit(1.0))) + F.lit(1.0)).alias("idf"))


def transform_tfidf(terms: DataFrame, idf: DataFrame, id_col: str, sublinear: bool = False, row_documents: bool = False) -> DataFrame:
    """(id, term, tfidf) with unit Euclidean length per document; the idf table is the model.

    ``row_documents`` tells that a document is one row of text: its terms then fit a window
    over the id, and nothing is computed twice. Group documents of any size use a join.
    """
    tf = F.lit(1.0) + F.log(F.col("n").cast("double")) if sublinear else F.col("n").cast("double")
    raw = terms.join(broadcast_if_small(idf), "term").select(id_col, "term", (tf * F.col("idf")).alias("_w"))
    if row_documents:
        norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(id_col)))
        return raw.select(id_col, "term", (F.col("_w") / norm).alias("tfidf"))
    norms = raw.groupBy(id_col).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    return raw.join(norms, id_col).select(id_col, "term", (F.col("_w") / F.col("_norm")).alias("tfidf"))


def document_count(df: DataFrame, id_col: str) -> Column:
    return one_row(df.agg(F.count_distinct(id_col).alias("n")))["n"]


def tfidf(
    df: DataFrame, id_col: str, tokens: Column, min_df: int = 1, max_features: int | None = None, sublinear: bool = False
) -> DataFrame:
    """TF-IDF where each row is a document."""
    return _counted_tfidf(write_once(run_lengths(df, [id_col], tokens)), id_col, min_df, max_features, sublinear)


def _row_tfidf(model: TermVectorizerModel, rows: DataFrame, id_col: str) -> DataFrame:
    """(id, term, tfidf): a row is weighed where it is; only rows that share an id are brought together,
    since they have one length."""
    several = rows.groupBy(F.col(id_col).alias("_id")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select("_id")
    several = broadcast_if_small(several)
    if several.isEmpty():
        return model.weights(rows, id_col)
    same = F.col(id_col).eqNullSafe(F.col("_id"))
    raw = model.weights(rows.join(several, same, "left_semi"), id_col, unit=False)
    norm = F.sqrt(F.sum(F.col("tfidf") * F.col("tfidf")).over(Window.partitionBy(id_col)))
    alone = model.weights(rows.join(several, same, "left_anti"), id_col)
    return alone.unionByName(raw.withColumn("tfidf", F.col("tfidf") / norm))


def _counted_tfidf(counted: DataFrame, id_col: str, min_df: int, max_features: int | None, sublinear: bool) -> DataFrame:
    counts = document_terms(counted, id_col, None)
    rows = one_row(counted.agg(F.count(F.lit(1)).alias("n")))["n"]
    idf = fit_idf(counts, rows, min_df, max_features)
    return transform_tfidf(counts, idf, id_col, sublinear, row_documents=True)


def char_tfidf(
    df: DataFrame,
    id_col: str,
    text: str,
    lo: int = 3,
    hi: int = 5,
    within_words: bool = True,
    min_df: int = 2,
    max_features: int | None = None,
    sublinear: bool = True,
    strip_accents: bool = True,
) -> DataFrame:
    """TF-IDF of character n-grams, inside word boundaries or over the raw text.

    Grams are counted inside the row first, so what leaves a task is one record per distinct gram. With
    ``max_features`` the terms are few enough to weigh them there too: texts are written and cut where they
    are read, and only statistics of the grams are shuffled.
    """
    c = F.lower(F.coalesce(F.col(text), F.lit("")))
    if strip_accents:
        c = T.strip_accents(c)
    if max_features is not None:
        plain = write_once(df.select(id_col, gram_text(c, within_words).alias("_s")))
        model = TermVectorizer(inputCol="_s", maxFeatures=max_features, minDF=min_df, sublinear=sublinear, grams=[lo, hi], across=not within_words).fit(plain)
        return _row_tfidf(model, plain, id_col)
    counts = write_once(gram_counts(df, [id_col], c, lo, hi, within_words))
    return _counted_tfidf(counts, id_col, min_df, max_features, sublinear)


def top_terms(weights: DataFrame, by: str, k: int) -> DataFrame:
    """The ``k`` heaviest terms per document (ties by term)."""
    w = Window.partitionBy(by).orderBy(F.desc("tfidf"), "term")
    return weights.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bow_tfidf(bow: DataFrame, documents: Column | int, id_col: str) -> DataFrame:
    """TF-IDF on a bag of words (id, token_id, n): n * log2(N / df), unit length per document."""
    n = F.lit(documents) if isinstance(documents, int) else documents
    dfs = bow.groupBy("token_id").agg(F.count(F.lit(1)).alias("df"))
    raw = bow.join(broadcast_if_small(dfs), "token_id").select(id_col, "token_id", (F.col("n") * F.log2(n / F.col("df"))).alias("_w"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(id_col)))  # one text's tokens
    return raw.filter(F.col("_w") > 0).select(id_col, "token_id", (F.col("_w") / norm).alias("tfidf"))
