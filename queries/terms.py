"""I: tokens, dictionaries, n-grams, TF-IDF."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.groups import LINE_WORDS, NOPUNCT, ROLE_TFIDF, dialogue, role_tfidf
from queries.registry import ENGLISH, S, SPANISH, W, in_list, lit_list, query, r, rounded, sr, t, texts
from weftwork.functions import text as T
from weftwork.functions import wordlists as wl
from weftwork.functions.frame import explode_rows
from weftwork.operators import terms
from weftwork.session import write_once

CLEAN = f"lower(regexp_replace(regexp_replace(regexp_replace(text, '[^{T.WORD_CHAR}]', ' ', 'g'), ' +[a-zA-Z] +', ' ', 'g'), ' +', ' ', 'g'))"
TOKENS = f"list_filter(string_split({CLEAN}, ' '), lambda t: t <> '')"
KEPT = f"list_filter({TOKENS}, lambda t: NOT list_contains({lit_list(ENGLISH)}, t) AND NOT regexp_matches(t, '^\\p{{Nd}}+$'))"


def cleaned(spark, root):
    return texts(spark, root).select("doc_id", "lang", T.clean_tokens_text(F.col("text")).alias("clean"))


def kept_tokens(spark, root):
    d = cleaned(spark, root)
    return d.select("doc_id", "lang", T.remove_stop_digits(T.tokenize(F.col("clean")), ENGLISH).alias("tokens"))


@query("i01_strip_punct", f"SELECT conv_id, turn, {NOPUNCT} AS plain FROM conversations")
def i01(spark, root):
    return t(spark, root, "conversations").select("conv_id", "turn", T.strip_punct(F.col("text")).alias("plain"))


@query("i02_word_count_ws", f"SELECT conv_id, turn, len({LINE_WORDS})::BIGINT AS words FROM conversations")
def i02(spark, root):
    return t(spark, root, "conversations").select("conv_id", "turn", T.word_count_ws(T.strip_punct(F.col("text"))).alias("words"))


@query("i03_clean_tokens_text", f"SELECT doc_id, {CLEAN} AS clean FROM documents")
def i03(spark, root):
    return cleaned(spark, root).select("doc_id", "clean")


@query("i04_tokenize", f"SELECT doc_id, {TOKENS} AS tokens FROM documents")
def i04(spark, root):
    return cleaned(spark, root).select("doc_id", T.tokenize(F.col("clean")).alias("tokens"))


@query("i05_remove_stop_digits", f"SELECT doc_id, {KEPT} AS tokens FROM documents")
def i05(spark, root):
    return kept_tokens(spark, root).select("doc_id", "tokens")


LANGUAGES = {"en": "english", "es": "spanish", "fr": "french", "de": "german"}


@query("i06_stopwords", f"""
WITH w AS (SELECT doc_id, lang, unnest({TOKENS}) AS token FROM documents)
SELECT lang, count(*) AS tokens, count(*) FILTER ({' OR '.join(f"(lang = '{k}' AND token IN {in_list(wl.stopwords(v))})" for k, v in LANGUAGES.items())}) AS stop_tokens
FROM w GROUP BY lang""")
def i06(spark, root):
    words = [(k, w) for k, v in LANGUAGES.items() for w in wl.stopwords(v)]
    stop = spark.createDataFrame(words, "lang string, token string").withColumn("stop", F.lit(1))
    ws = explode_rows(cleaned(spark, root), ["lang"], T.tokenize(F.col("clean")), "token")
    counts = ws.groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(stop), ["lang", "token"], "left").groupBy("lang").agg(  # a fixed list
        F.sum("n").alias("tokens"), F.coalesce(F.sum(F.when(F.col("stop") == 1, F.col("n"))), F.lit(0)).alias("stop_tokens")
    )


def _stem_sql(language: str) -> str:
    suffixes = "|".join(sorted(wl.SUFFIXES[language], key=lambda s: (-len(s), s)))
    return f"list_transform({TOKENS}, lambda t: regexp_replace(t, '^(.{{3,}}?)(?:{suffixes})$', '\\1'))"


@query("i07_stem_tokens", f"""
SELECT doc_id, CASE lang WHEN 'en' THEN {_stem_sql('english')} WHEN 'es' THEN {_stem_sql('spanish')} ELSE {TOKENS} END AS stems FROM documents""")
def i07(spark, root):
    d = cleaned(spark, root).withColumn("tokens", T.tokenize(F.col("clean")))
    stems = (
        F.when(F.col("lang") == "en", T.stem_tokens(F.col("tokens"), wl.SUFFIXES["english"]))
        .when(F.col("lang") == "es", T.stem_tokens(F.col("tokens"), wl.SUFFIXES["spanish"]))
        .otherwise(F.col("tokens"))
    )
    return d.select("doc_id", stems.alias("stems"))


DICT_SQL = f"""
tok AS (SELECT doc_id, unnest({KEPT}) AS token FROM documents),
dt AS (SELECT doc_id, token, count(*) AS n FROM tok GROUP BY 1, 2),
st AS (SELECT token, count(*) AS df, sum(n)::BIGINT AS cf FROM dt GROUP BY token)"""
EXTREMES_SQL = f"""{DICT_SQL},
ex AS (SELECT * FROM st WHERE df >= 2 AND df <= 0.8 * (SELECT count(*) FROM documents) ORDER BY df DESC, token LIMIT 100000),
dic AS (SELECT *, row_number() OVER (ORDER BY df DESC, token) - 1 AS token_id FROM ex)"""


def extremes(spark, root):
    """(token counts of each document, written once; their sums; the number of documents)."""
    d = write_once(terms.run_lengths(kept_tokens(spark, root), ["doc_id"], F.col("tokens")))
    return d, terms.token_stats(d, "doc_id", None), d.count()


@query("i08_build_dictionary", f"WITH {DICT_SQL} SELECT token, df, cf, row_number() OVER (ORDER BY df DESC, token) - 1 AS token_id FROM st")
def i08(spark, root):
    return terms.build_dictionary(terms.token_stats(kept_tokens(spark, root), "doc_id", F.col("tokens")))


@query("i09_filter_extremes", f"WITH {EXTREMES_SQL} SELECT token, df, cf FROM ex")
def i09(spark, root):
    _, stats, documents = extremes(spark, root)
    return terms.filter_extremes(stats, documents, 2, 0.8)


@query("i10_doc2bow", f"""WITH {EXTREMES_SQL}
SELECT doc_id, token_id, n FROM dt JOIN dic ON dt.token = dic.token""")
def i10(spark, root):
    d, stats, documents = extremes(spark, root)
    bow = terms.doc2bow(d, "doc_id", None, terms.kept_dictionary(stats, documents, 2, 0.8))
    return bow.select("doc_id", F.inline("bow"))


@query("i11_term_frequencies", f"""
WITH w AS (SELECT unnest({LINE_WORDS}) AS term FROM conversations)
SELECT term, count(*) AS n FROM w WHERE term NOT IN {in_list(ENGLISH)} GROUP BY term ORDER BY n DESC, term LIMIT 3000""")
def i11(spark, root):
    return terms.term_frequencies(dialogue(spark, root), F.col("words"), ENGLISH, top=3000)


GRAM_TOKENS = f"list_filter(regexp_extract_all(lower({NOPUNCT}), '[{T.WORD_CHAR}]{{2,}}'), lambda t: NOT list_contains({lit_list(ENGLISH)}, t))"


def gram_lines(spark, root):
    d = texts(spark, root, "conversations").withColumn("terms", T.terms(T.strip_punct(F.col("text"))))
    return d.withColumn("terms", F.filter("terms", lambda x: ~x.isin(*ENGLISH)))


def _gram_sql(n: int, key: str = "role", order: str = "conv_id, turn") -> str:
    """n-grams of each speaker's concatenated tokens."""
    gram = " || ' ' || ".join([f"toks[i{'' if j == 0 else f' + {j}'}]" for j in range(n)])
    return f"""SELECT {key}, {gram} AS term FROM (
      SELECT {key}, toks, unnest(range(1, greatest(len(toks) - {n - 2}, 1))) AS i FROM (
        SELECT {key}, flatten(list({GRAM_TOKENS} ORDER BY {order})) AS toks FROM conversations GROUP BY {key}))"""


@query("i12_ngram_counts", f"""
SELECT term, count(*) AS n, 1 AS size FROM ({_gram_sql(1)}) GROUP BY term
UNION ALL SELECT term, count(*) AS n, 2 AS size FROM ({_gram_sql(2)}) GROUP BY term""")
def i12(spark, root):
    d = gram_lines(spark, root)
    one = terms.ngram_counts(d, "role", ["conv_id", "turn"], "terms", 1).withColumn("size", F.lit(1))
    return one.unionByName(terms.ngram_counts(d, "role", ["conv_id", "turn"], "terms", 2).withColumn("size", F.lit(2)))


@query("i13_special_bigrams", f"""
WITH g1 AS (SELECT term, count(*) AS n FROM ({_gram_sql(1)}) GROUP BY term),
g2 AS (SELECT term, count(*) AS n FROM ({_gram_sql(2)}) GROUP BY term),
x AS (SELECT g2.term, g2.n AS n12, round(g2.n / ((a.n + 50.0::DOUBLE) * (b.n + 50.0::DOUBLE)), 9) AS ratio
  FROM g2 JOIN g1 a ON a.term = split_part(g2.term, ' ', 1) JOIN g1 b ON b.term = split_part(g2.term, ' ', 2))
SELECT term, n12, ratio FROM x ORDER BY ratio DESC, term LIMIT 20""")
def i13(spark, root):
    d = gram_lines(spark, root)
    c1 = terms.ngram_counts(d, "role", ["conv_id", "turn"], "terms", 1)
    c2 = terms.ngram_counts(d, "role", ["conv_id", "turn"], "terms", 2)
    return rounded(terms.special_bigrams(c1, c2), "ratio", digits=9)


@query("i14_tfidf", f"WITH {ROLE_TFIDF} SELECT role, term, {sr('tfidf')} AS tfidf FROM tf")
def i14(spark, root):
    return rounded(role_tfidf(spark, root), "tfidf")


DOC_TERMS = f"list_filter(regexp_extract_all(lower(text), '[{T.WORD_CHAR}]{{2,}}'), lambda t: NOT list_contains({lit_list(ENGLISH)}, t))"


def _tfidf_sql(n: str, tf: str = "n", key: str = "doc_id") -> str:
    """CTEs from dt(key, term, n) to tf(key, term, tfidf)."""
    return f"""
x AS (SELECT {key}, dt.term, ({tf}) * idf AS w FROM dt JOIN i ON dt.term = i.term),
tf AS (SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS tfidf FROM x)"""


@query("i14_tfidf_documents", f"""
WITH tok AS (SELECT doc_id, unnest({DOC_TERMS}) AS term FROM documents),
dt AS (SELECT doc_id, term, count(*) AS n FROM tok GROUP BY 1, 2),
i AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM dt GROUP BY term),
{_tfidf_sql('')}
SELECT doc_id, term, {sr('tfidf')} AS tfidf FROM tf""")
def i14_documents(spark, root):
    d = texts(spark, root)
    tokens = F.filter(T.terms(F.col("text")), lambda x: ~x.isin(*ENGLISH))
    return rounded(terms.tfidf(d, "doc_id", tokens), "tfidf")


@query("i15_tfidf_ngrams", f"""
WITH g AS ({_gram_sql(2, 'conv_id', 'turn')} UNION ALL {_gram_sql(3, 'conv_id', 'turn')}),
dt AS (SELECT conv_id, term, count(*) AS n FROM g GROUP BY 1, 2),
i AS (SELECT term, ln((1 + (SELECT count(DISTINCT conv_id) FROM conversations)) / (1 + count(*))) + 1 AS idf FROM dt GROUP BY term),
few AS (SELECT conv_id FROM conversations GROUP BY conv_id ORDER BY count(*) DESC, conv_id LIMIT 5),
{_tfidf_sql('', key='conv_id').replace('ON dt.term = i.term', 'ON dt.term = i.term WHERE conv_id IN (SELECT conv_id FROM few)')}
SELECT conv_id, term, {sr('tfidf')} AS tfidf FROM tf""")
def i15(spark, root):
    d = gram_lines(spark, root)
    grams = terms.group_ngrams(d, "conv_id", ["turn"], "terms", 2).unionByName(terms.group_ngrams(d, "conv_id", ["turn"], "terms", 3))
    counts = grams.groupBy("conv_id", "term").agg(F.count(F.lit(1)).alias("n"))
    idf = terms.fit_idf(counts, terms.document_count(d, "conv_id"))
    longest = d.groupBy("conv_id").agg(F.count(F.lit(1)).alias("lines")).orderBy(F.desc("lines"), "conv_id").limit(5)
    wanted = counts.join(F.broadcast(longest.select("conv_id")), "conv_id", "left_semi")  # five rows
    return rounded(terms.transform_tfidf(wanted, idf, "conv_id"), "tfidf")


MAX_FEATURES = 300_000  # fixed value: vocabulary limit of the character vectoriser

PLAIN = f"translate(lower(text), '{wl.ACCENTED}', '{wl.UNACCENTED}')"


def _char_tfidf_sql(grams: str, source: str, key: str, features: int, tf: str) -> str:
    return f"""
dt AS (SELECT {key}, term, count(*) AS n FROM ({grams}) GROUP BY 1, 2),
st AS (SELECT term, count(*) AS df, sum(n) AS cf FROM dt GROUP BY term HAVING count(*) >= 2 ORDER BY cf DESC, term LIMIT {features}),
i AS (SELECT term, ln((1 + (SELECT count(*) FROM {source})) / (1 + df)) + 1 AS idf FROM st),
{_tfidf_sql('', tf, key)}"""


WB_GRAMS = " UNION ALL ".join(
    f"SELECT doc_id, substr(p, unnest(range(1, length(p) - {n - 2}))::INT, {n}) AS term FROM p WHERE length(p) >= {n}" for n in (3, 4, 5)
)


@query("i16_char_wb_tfidf", f"""
WITH p AS (SELECT doc_id, ' ' || unnest(regexp_extract_all({PLAIN}, '{T.NON_SPACE}')) || ' ' AS p FROM documents),
{_char_tfidf_sql(WB_GRAMS, 'documents', 'doc_id', 300000, '1 + ln(n)')}
SELECT doc_id, count(*) AS terms, {sr('sum(tfidf)', 4)} AS total, {sr('max(tfidf)')} AS peak FROM tf GROUP BY doc_id""")
def i16(spark, root):
    weights = terms.char_tfidf(texts(spark, root), "doc_id", "text", max_features=MAX_FEATURES)
    out = weights.groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.sum("tfidf").alias("total"), F.max("tfidf").alias("peak"))
    return rounded(rounded(out, "total", digits=4), "peak")


RAW_GRAMS = " UNION ALL ".join(
    f"SELECT item_id, substr(p, unnest(range(1, length(p) - {n - 2}))::INT, {n}) AS term FROM p WHERE length(p) >= {n}" for n in (3, 4, 5)
)


@query("i17_char_tfidf", f"""
WITH p AS (SELECT item_id, regexp_replace(lower(text), '{S}{S}+', ' ', 'g') AS p FROM benchmark),
{_char_tfidf_sql(RAW_GRAMS, 'benchmark', 'item_id', 300000, '1 + ln(n)')}
SELECT item_id, term, {sr('tfidf')} AS tfidf FROM tf""")
def i17(spark, root):
    d = t(spark, root, "benchmark")
    out = terms.char_tfidf(d, "item_id", "text", within_words=False, max_features=MAX_FEATURES, strip_accents=False)
    return rounded(out, "tfidf")


RAW_DOC_GRAMS = RAW_GRAMS.replace("item_id", "doc_id")


@query("i17_char_tfidf_documents", f"""
WITH p AS (SELECT doc_id, regexp_replace(lower(text), '{S}{S}+', ' ', 'g') AS p FROM documents),
{_char_tfidf_sql(RAW_DOC_GRAMS, 'documents', 'doc_id', 300000, '1 + ln(n)')}
SELECT doc_id, count(*) AS terms, {sr('sum(tfidf)', 4)} AS total, {sr('max(tfidf)')} AS peak FROM tf GROUP BY doc_id""")
def i17_documents(spark, root):
    weights = terms.char_tfidf(texts(spark, root), "doc_id", "text", within_words=False, max_features=MAX_FEATURES, strip_accents=False)
    out = weights.groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.sum("tfidf").alias("total"), F.max("tfidf").alias("peak"))
    return rounded(rounded(out, "total", digits=4), "peak")


@query("i18_strip_accents", f"SELECT doc_id, translate(text, '{wl.ACCENTED}', '{wl.UNACCENTED}') AS plain FROM documents")
def i18(spark, root):
    return t(spark, root, "documents").select("doc_id", T.strip_accents(F.col("text")).alias("plain"))


@query("i19_bow_tfidf", f"""WITH {EXTREMES_SQL},
b AS (SELECT doc_id, token_id, n FROM dt JOIN dic ON dt.token = dic.token),
i AS (SELECT token_id, log2((SELECT count(*) FROM documents) / count(*)) AS idf FROM b GROUP BY token_id),
x AS (SELECT doc_id, b.token_id, n * idf AS w FROM b JOIN i ON b.token_id = i.token_id WHERE n * idf > 0)
SELECT doc_id, token_id, {sr('w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))')} AS tfidf FROM x""")
def i19(spark, root):
    d, stats, documents = extremes(spark, root)
    bow = terms.bag_of_words(d, "doc_id", None, terms.kept_dictionary(stats, documents, 2, 0.8))
    return rounded(terms.bow_tfidf(bow, documents, "doc_id"), "tfidf")
