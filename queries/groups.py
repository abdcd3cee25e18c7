"""E, F: aggregation, per-group ranking and running values."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.combine import ROLE_TURN, role_turn
from queries.registry import ENGLISH, SEED, in_list, query, r, rounded, sr, t, texts
from weftwork.functions import text as T
from weftwork.functions import wordlists as wl
from weftwork.operators import groups
from weftwork.operators.scan import prefix_scan
from weftwork.operators.terms import group_terms, top_terms, transform_tfidf, fit_idf, document_count

PUNCT_SQL = wl.PUNCTUATION.replace("'", "''")
NOPUNCT = f"translate(lower(text), '{PUNCT_SQL}', '')"
LINE_WORDS = rf"regexp_extract_all({NOPUNCT}, '{T.NON_SPACE}')"


def dialogue(spark, root):
    """Dialogue lines with punctuation removed and their words."""
    d = texts(spark, root, "conversations").withColumn("plain", T.strip_punct(F.col("text")))
    return d.withColumn("words", T.split_ws(F.col("plain")))


@query("e01_group_summary", f"""
SELECT turn, count(DISTINCT conv_id) AS conversations, count(DISTINCT role) AS roles, count(text) AS lines,
  sum(len({LINE_WORDS}))::BIGINT AS words FROM conversations GROUP BY turn""")
def e01(spark, root):
    d = t(spark, root, "conversations").withColumn("w", T.word_count_ws(T.strip_punct(F.col("text"))))
    return groups.group_summary(
        d, ["turn"], {"conversations": ("nunique", "conv_id"), "roles": ("nunique", "role"), "lines": ("count", "text"), "words": ("sum", "w")}
    )


@query("e02_top_groups", f"""
SELECT conv_id, count(text) AS lines, sum(len({LINE_WORDS}))::BIGINT AS words FROM conversations GROUP BY conv_id
ORDER BY lines DESC, words DESC, conv_id LIMIT 10""")
def e02(spark, root):
    d = t(spark, root, "conversations").withColumn("w", T.word_count_ws(T.strip_punct(F.col("text"))))
    g = groups.group_summary(d, ["conv_id"], {"lines": ("count", "text"), "words": ("sum", "w")})
    return groups.top_groups(g, [F.desc("lines"), F.desc("words"), F.col("conv_id")], 10)


@query("e03_entity_period", f"""
SELECT event_type, date_trunc('day', ts)::DATE::VARCHAR AS day, count(*) AS n, {sr('sum(value)', 2)} AS total FROM events GROUP BY 1, 2""")
def e03(spark, root):
    d = t(spark, root, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return rounded(groups.group_summary(d, ["event_type", "day"], {"n": ("count", "event_id"), "total": ("sum", "value")}), "total", digits=2)


@query("e04_group_means", f"""
SELECT l_returnflag, l_linestatus, {sr('avg(l_quantity)', 4)} AS l_quantity, {sr('avg(l_extendedprice)', 3)} AS l_extendedprice,
  {sr('avg(l_discount)')} AS l_discount FROM lineitem GROUP BY 1, 2""")
def e04(spark, root):
    out = groups.group_means(t(spark, root, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice", "l_discount"])
    return rounded(rounded(rounded(out, "l_quantity", digits=4), "l_extendedprice", digits=3), "l_discount")


@query("e05_concat_text", """
SELECT conv_id, 0::BIGINT AS chunk, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id""")
def e05(spark, root):
    return groups.concat_text(t(spark, root, "conversations"), "conv_id", "text", ["turn"])


@query("e06_crosstab", """
SELECT lang, count(*) FILTER (quality = 0) AS quality_0, count(*) FILTER (quality = 1) AS quality_1
FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang""")
def e06(spark, root):
    d = t(spark, root, "documents").join(t(spark, root, "labels"), "doc_id")
    return groups.crosstab(d, "lang", "quality", [0, 1])


@query("e07_group_mode", """
WITH c AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, user_id AS mode, n FROM c QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) = 1""")
def e07(spark, root):
    return groups.group_mode(t(spark, root, "events"), "event_type", "user_id")


@query("e08_best_by", f"""
SELECT 'p_size' AS metric, p_partkey, {sr('p_size')} AS value FROM (SELECT * FROM part ORDER BY p_size DESC, p_partkey LIMIT 1)
UNION ALL SELECT 'p_retailprice', p_partkey, {sr('p_retailprice')} FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1)""")
def e08(spark, root):
    return rounded(groups.best_by(t(spark, root, "part"), ["p_size", "p_retailprice"], "p_partkey"), "value")


@query("e09_top_n", f"SELECT o_orderkey, {sr('o_totalprice', 4)} AS o_totalprice FROM orders ORDER BY orders.o_totalprice DESC, o_orderkey LIMIT 20")
def e09(spark, root):
    return rounded(groups.top_n(t(spark, root, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 20, "o_orderkey"), "o_totalprice", digits=4)


@query("e10_fold_summary", f"""
SELECT user_id % 5 AS fold, {sr('avg(value)', 4)} AS mean, {sr('stddev_pop(value)', 4)} AS std_pop, {sr('stddev_samp(value)', 4)} AS std_samp,
  {sr('min(value)', 4)} AS min, {sr('max(value)', 4)} AS max FROM events GROUP BY 1""")
def e10(spark, root):
    out = groups.fold_summary(t(spark, root, "events").withColumn("fold", F.col("user_id") % 5), ["fold"], "value")
    return rounded(out, "mean", "std_pop", "std_samp", "min", "max", digits=4)


@query("e11_vocabulary_size", f"""
WITH w AS (SELECT DISTINCT unnest({LINE_WORDS}) AS w FROM conversations)
SELECT count(*) AS vocabulary, count(*) FILTER (w NOT IN {in_list(ENGLISH)}) AS vocabulary_no_stop FROM w""")
def e11(spark, root):
    d = dialogue(spark, root)
    return groups.vocabulary_size(d, F.col("words"), ENGLISH)


@query("e12_head_per_group", """
SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3""")
def e12(spark, root):
    return groups.head_per_group(t(spark, root, "documents").select("doc_id", "source"), ["source"], ["doc_id"], 3)


@query("f01_top_words", f"""
WITH w AS (SELECT role, unnest({LINE_WORDS}) AS word FROM conversations),
c AS (SELECT role, word, count(*) AS n FROM w WHERE word NOT IN {in_list(ENGLISH)} GROUP BY 1, 2)
SELECT role, word, n, (row_number() OVER (PARTITION BY role ORDER BY n DESC, word))::INTEGER AS rank FROM c QUALIFY rank <= 20""")
def f01(spark, root):
    return groups.top_words(dialogue(spark, root), "role", F.col("words"), 20, ENGLISH)


ROLE_TFIDF = f"""
w AS (SELECT role, unnest(regexp_extract_all(lower({NOPUNCT}), '[{T.WORD_CHAR}]{{2,}}')) AS term FROM conversations),
c AS (SELECT role, term, count(*) AS n FROM w WHERE term NOT IN {in_list(ENGLISH)} GROUP BY 1, 2),
i AS (SELECT term, ln((1 + (SELECT count(DISTINCT role) FROM conversations)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY term),
x AS (SELECT role, c.term, n * idf AS w FROM c JOIN i ON c.term = i.term),
tf AS (SELECT role, term, w / sqrt(sum(w * w) OVER (PARTITION BY role)) AS tfidf FROM x)"""


def role_tfidf(spark, root):
    d = texts(spark, root, "conversations").withColumn("terms", T.terms(T.strip_punct(F.col("text"))))
    counts = group_terms(d, "role", F.filter("terms", lambda x: ~x.isin(*ENGLISH)))
    return transform_tfidf(counts, fit_idf(counts, document_count(d, "role")), "role")


@query("f02_top_terms", f"""WITH {ROLE_TFIDF}
SELECT role, term, {sr('tfidf')} AS tfidf, (row_number() OVER (PARTITION BY role ORDER BY round(tf.tfidf, 9) DESC, term))::INTEGER AS rank FROM tf QUALIFY rank <= 20""")
def f02(spark, root):
    w = role_tfidf(spark, root).withColumn("tfidf", F.round("tfidf", 9))
    return rounded(top_terms(w, "role", 20), "tfidf")


@query("f03_sample_per_group", f"""
SELECT vec_id, label FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('{SEED}|' || vec_id), vec_id) <= 5""")
def f03(spark, root):
    return groups.sample_per_group(t(spark, root, "embeddings").select("vec_id", "label"), "label", 5, "vec_id", SEED)


@query("f04_early_stop", f"""
WITH h AS (SELECT user_id, value, row_number() OVER w AS i, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, CASE WHEN before IS NULL OR value > before THEN i END AS gain FROM h),
l AS (SELECT *, max(gain) OVER (PARTITION BY user_id ORDER BY i) AS last FROM g)
SELECT user_id, {sr('max(value)', 4)} AS best, max(gain)::BIGINT AS best_step, max(i)::BIGINT AS steps,
  min(CASE WHEN i - last >= 5 THEN i END)::BIGINT AS stop_step FROM l GROUP BY user_id""")
def f04(spark, root):
    return rounded(groups.early_stop(t(spark, root, "events"), "user_id", ["ts", "event_id"], "value", 5), "best", digits=4)


@query("f05_rank_in_group", f"""
WITH s AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1),
o AS (SELECT c_mktsegment, coalesce(sum(n) OVER (ORDER BY c_mktsegment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM s)
SELECT c.c_mktsegment, c_custkey, {sr('c_acctbal', 4)} AS c_acctbal,
  row_number() OVER (PARTITION BY c.c_mktsegment ORDER BY c.c_acctbal, c_custkey) AS rank, "offset" FROM customer c JOIN o ON c.c_mktsegment = o.c_mktsegment""")
def f05(spark, root):
    d = t(spark, root, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    return rounded(groups.rank_in_group(d, "c_mktsegment", "c_acctbal", "c_custkey"), "c_acctbal", digits=4)
