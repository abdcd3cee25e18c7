"""N-grams that the vectoriser cuts from texts, against counts in a table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftwork.functions import text as T
from weftwork.functions import wordlists as wl
from weftwork.operators import models, terms, vectorize
from weftwork.operators.vectorize import TermVectorizer

TEXTS = ["ab abc abc", "", None, "a", "aaaaaa aaa  b", "é\U0001F600x abc", "c\0\0d abc ab", " abc aaaaaa ", "一二"]


@pytest.mark.parametrize("alphabet", ["narrow", "wide"])
def test_texts_give_the_vectors_of_their_counts(spark, monkeypatch, alphabet):
    """A wide alphabet leaves no room for keys."""
    more = ["".join(chr(0x4E00 + i) for i in range(7000)) + " abc"] if alphabet == "wide" else []
    monkeypatch.setattr(vectorize, "KNOWN_GRAMS", 8)
    df = spark.createDataFrame(list(enumerate(TEXTS + more)), "id int, text string").coalesce(1)
    counts = terms.gram_counts(df, ["id"], F.coalesce("text", F.lit("")), 3, 5)
    df = df.withColumn("plain", terms.gram_text(F.col("text")))
    old = TermVectorizer(minDF=1).fit(counts)
    new = TermVectorizer(inputCol="plain", grams=[3, 5], minDF=1).fit(df)
    assert new.terms == old.terms and np.allclose(new.idf, old.idf)
    want = {r["id"]: r["tfidf"] for r in old.transform(counts).collect()}
    for found in (new.transform(df), new.written(df, lambda d: d)):
        got = {r["id"]: r["tfidf"] for r in found.collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[i].toArray(), want[i].toArray()) for i in want)


def test_text_models_write_no_counts_of_strings(spark, root, monkeypatch):
    """What they write between steps: texts once, and numbers."""
    from queries import catalogue, flows, models as queries_models
    from weftwork.plans import stacked

    seen = []

    def write(df, by=()):
        seen.append(df.schema.simpleString())
        return write_once(df, by)

    write_once = models.write_once
    for module in (models, queries_models, flows, stacked):
        monkeypatch.setattr(module, "write_once", write)
    queries = catalogue.queries()
    rows = queries["k17_text_oof"](spark, root).count()
    assert rows == queries["k05_sgd_grid"](spark, root).count() > 0
    assert queries["n04_stacked_scores"](spark, root).count() > 0
    assert not [s for s in seen if "term:string" in s or "terms:" in s]
    assert [s for s in seen if "plain:string" in s]


@pytest.mark.parametrize("alphabet", ["narrow", "wide"])
@pytest.mark.parametrize("sizes", [(3, 5), (1, 2)])
def test_grams_across_words_are_those_of_their_counts(spark, alphabet, sizes):
    more = ["".join(chr(0x4E00 + i) for i in range(7000)) + " abc  d"] if alphabet == "wide" else []
    df = spark.createDataFrame(list(enumerate(TEXTS + more)), "id int, text string").coalesce(1)
    counts = terms.gram_counts(df, ["id"], F.coalesce("text", F.lit("")), *sizes, within_words=False)
    df = df.withColumn("plain", terms.gram_text(F.col("text"), within_words=False))
    old = TermVectorizer(minDF=1).fit(counts)
    new = TermVectorizer(inputCol="plain", grams=list(sizes), across=True, minDF=1).fit(df)
    assert new.terms == old.terms and np.allclose(new.idf, old.idf)
    want, got = ({r["id"]: r["tfidf"] for r in found.collect()} for found in (old.transform(counts), new.transform(df)))
    assert got.keys() == want.keys() and all(np.allclose(got[i].toArray(), want[i].toArray()) for i in want)


def test_grams_of_documents_are_cut_from_texts(spark, root, monkeypatch):
    """A table of counts of strings takes more memory to read than an executor has."""
    from queries import catalogue

    seen, write_once = [], terms.write_once
    monkeypatch.setattr(terms, "write_once", lambda df, by=(): seen.append(df.schema.simpleString()) or write_once(df, by))
    for name in ("i17_char_tfidf_documents", "i16_char_wb_tfidf"):
        assert catalogue.queries()[name](spark, root).count() > 0
    assert seen and not [s for s in seen if "term:string" in s]


def test_texts_are_searched_for_rare_characters_by_a_range(spark):
    """A class of some fifty characters took most of the time of the text models' input."""
    df = spark.createDataFrame([("caf\u00e9 \u2013 \u09cb",), ("\U00011938",), ("\u0e01 a\u0301",), (None,)], "c string")
    plan = df.select(T.strip_accents(F.col("c")).alias("p"))
    low, high = min(wl.ACCENTED_LONGER), max(c for c in wl.ACCENTED_LONGER if c <= "\uffff")
    assert f"[{low}-{high}" in plan._jdf.queryExecution().analyzed().toString()
    longer = {chr(0x09CB): wl.ACCENTED_LONGER[chr(0x09CB)], "\U00011938": wl.ACCENTED_LONGER["\U00011938"]}
    assert [r["p"] for r in plan.collect()] == ["cafe \u2013 " + longer[chr(0x09CB)], longer["\U00011938"], "\u0e01 a", None]
