"""Spelling variants against plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from weftwork.llm.spelling import spelling_variants, trie_nodes, word_counts


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, factor=10):
    forms, out = {}, {}
    for w, n in counts.items():
        close = [v for v in counts if near(w, v)]
        best = min(close, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= factor * n:
            forms[w] = best
        out[w] = [n, len(close)]
    for w in counts:
        root = w
        while root in forms:
            root = forms[root]
        form = forms.get(w)
        out[w] = (form, root, *out[w], counts[form] if form else None)
    return out


def variants(spark, counts):
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    return {r[0]: tuple(r[1:]) for r in spelling_variants(df).collect()}


def test_all_edits_runs_chains_and_ties(spark):
    random.seed(5)
    counts = {}
    for _ in range(400):
        counts["".join(random.choice("abé") for _ in range(random.randint(1, 7)))] = random.choice([1, 2, 20, 300, 5000])
    counts |= {"": 7, "a": 1, "aaaa": 3, "aaaaa": 30, "aaaaaa": 300, "x" * 30_000: 2, "x" * 29_999: 40, "\U0001f600a": 2, "\U0001f600b": 50}
    expected = brute({w: n for w, n in counts.items() if w and len(w) < 1000})
    found = variants(spark, counts)
    long_ = {w: found.pop(w) for w in ("x" * 30_000, "x" * 29_999)}
    assert long_["x" * 30_000] == ("x" * 29_999, "x" * 29_999, 2, 1, 40)
    assert found.pop("") == (None, "", 7, 0, None)
    assert found == expected


def test_nodes_are_numbers_of_beginnings(spark):
    words = sorted({"".join(random.choice("abc") for _ in range(random.randint(1, 6))) for _ in range(500)} | {"zz"})
    rows = trie_nodes(spark.createDataFrame([(w,) for w in words], "k string").repartition(7), "k", runs=True).collect()
    names = {}
    for r in rows:
        assert words[r["rank"]] == r["k"]
        assert r["starts"] == [i == 0 or r["k"][i] != r["k"][i - 1] for i in range(len(r["k"]))]
        for i, node in enumerate(r["nodes"]):
            assert names.setdefault(node, r["k"][:i]) == r["k"][:i]
    assert len(set(names.values())) == len(names) and sorted(names) == list(range(len(names)))


def brute_counts(rows):
    counts = Counter()
    for row, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{row}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def test_counts_of_whole_texts(spark, root):
    docs = spark.read.parquet(f"{root}/documents.parquet")
    found = {r["word"]: r["n"] for r in word_counts(docs, slip=31).collect()}
    assert found == brute_counts([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_odd_documents(spark):
    rows = [(1, None), (2, ""), (3, "ÀÉÎÕÜß×÷ÿ ÀÉÎÕÜß×÷ÿ"), (3, "Straßenbahn straßenbahnİ"), (4, "ab " * 100_000 + "Abcdefgh abcdefgh")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(9))
    assert {r["word"]: r["n"] for r in word_counts(docs, slip=31).collect()} == brute_counts(rows)
    assert spelling_variants(word_counts(docs.limit(0))).collect() == []
    unknown = spark.createDataFrame([(None, "letters letters")], "doc_id bigint, text string")
    assert [tuple(r) for r in word_counts(unknown).collect()] == [("letters", 2)]


def test_query_equals_brute_force(spark, root):
    from weftwork.llm.registered import QUERIES

    docs = spark.read.parquet(f"{root}/documents.parquet")
    counts = brute_counts([tuple(r) for r in docs.select("doc_id", "text").collect()])
    by_length = {}
    for w in counts:
        by_length.setdefault(len(w), set()).add(w)
    found = {r["word"]: r for r in QUERIES["op11_spelling"](spark, root).collect()}
    assert {w: r["n"] for w, r in found.items()} == counts
    letters = sorted({c for w in counts for c in w})
    forms = {}
    for w, r in found.items():
        made = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[j:] for i in range(len(w) + 1) for j in (i, i + 1) for c in letters}
        close = [v for v in made if v in counts and v != w]
        best = min(close, key=lambda v: (-counts[v], v), default=None)
        form = best if best and counts[best] >= 10 * counts[w] else None
        assert (r["form"], r["n_near"], r["form_n"]) == (form, len(close), counts[form] if form else None)
        forms[w] = form
    for w, r in found.items():
        while forms[w]:
            w = forms[w]
        assert r["root"] == w
