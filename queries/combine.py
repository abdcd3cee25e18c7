"""D: combining tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.registry import query, rounded, sql_feature_ctes, sr, t, texts
from weftwork.functions import text as T
from weftwork.operators import combine
from weftwork.operators.encode import one_hot
from weftwork.operators.textfeat import text_features


@query("d01_dedup_keep_first", """
SELECT min(d.doc_id) AS doc_id, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY text, quality""")
def d01(spark, root):
    d = t(spark, root, "documents").join(t(spark, root, "labels").select("doc_id", "quality"), "doc_id")
    return combine.dedup_keep_first(d, ["text", "quality"], "doc_id", digest=["text"]).select("doc_id", "quality")


@query("d01_dedup_text", "SELECT doc_id, text, lang FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text)")
def d01_text(spark, root):
    d = t(spark, root, "documents").select("doc_id", "text", "lang")
    return combine.dedup_keep_first(d, ["text"], "doc_id", digest=["text"])


@query("d02_union_tables", """
SELECT doc_id AS id, text, lang AS language, source, 'first' AS dataset FROM documents
UNION ALL SELECT item_id, text, 'unknown', 'unknown', 'second' FROM benchmark""")
def d02(spark, root):
    a = t(spark, root, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("language"), "source").withColumn("dataset", F.lit("first"))
    b = t(spark, root, "benchmark").select(F.col("item_id").alias("id"), "text").withColumn("dataset", F.lit("second"))
    return combine.union_tables(a, b, {"language": "unknown", "source": "unknown"})


@query("d03_join_blocks", f"""WITH {sql_feature_ctes(keys='doc_id, lang')}
SELECT f.doc_id, word_count, {sr('lexical_diversity')} AS lexical_diversity, lang = 'de' AS lang_de, lang = 'en' AS lang_en,
  lang = 'es' AS lang_es, lang = 'fr' AS lang_fr, quality, toxic
FROM feats f JOIN labels l ON f.doc_id = l.doc_id""")
def d03(spark, root):
    d = t(spark, root, "documents")
    feats = text_features(texts(spark, root)).select("doc_id", "word_count", "lexical_diversity")
    flags = one_hot(d.select("doc_id", "lang"), "lang", "lang").drop("lang")
    return rounded(combine.join_blocks([feats, flags, t(spark, root, "labels")], "doc_id"), "lexical_diversity")


def _scores(spark, root):
    """Three deterministic scores per labelled document, in long form."""
    d = t(spark, root, "documents").join(t(spark, root, "labels"), "doc_id")
    ps = F.array(
        F.struct(F.lit("chars").alias("model"), F.least(F.col("n_chars") / 5000.0, F.lit(1.0)).alias("p")),
        F.struct(F.lit("id").alias("model"), (F.col("doc_id") % 97 / 97.0).alias("p")),
        F.struct(F.lit("clean").alias("model"), (1.0 - F.col("toxic")).alias("p")),
    )
    return d.select("doc_id", F.inline(ps))


@query("d04_stack_predictions", f"""
SELECT l.doc_id, {sr('least(n_chars / 5000.0, 1.0)')} AS chars, {sr('l.doc_id % 97 / 97.0')} AS id, {sr('1.0 - toxic')} AS clean
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def d04(spark, root):
    models = ["chars", "id", "clean"]
    return rounded(combine.stack_predictions(_scores(spark, root), "doc_id", "model", "p", models), *models)


@query("d05_present_in_all", """
SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(DISTINCT role) = (SELECT count(DISTINCT role) FROM conversations)""")
def d05(spark, root):
    return combine.present_in_all(t(spark, root, "conversations"), "conv_id", "role")


@query("d06_semi_split", """
SELECT doc_id, lang, 'listed' AS side FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, lang, 'other' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def d06(spark, root):
    a, b = combine.semi_split(t(spark, root, "documents").select("doc_id", "lang"), t(spark, root, "labels").select("doc_id"), "doc_id")
    return a.withColumn("side", F.lit("listed")).unionByName(b.withColumn("side", F.lit("other")))


@query("d07_cap_categories", """
WITH top AS (SELECT source FROM documents GROUP BY source ORDER BY count(*) DESC, source LIMIT 8)
SELECT doc_id, CASE WHEN source IN (SELECT source FROM top) THEN source ELSE 'other' END AS source FROM documents""")
def d07(spark, root):
    return combine.cap_categories(t(spark, root, "documents").select("doc_id", "source"), "source", 8)


ROLE_TURN = rf"""g AS (SELECT role, turn, count(*)::BIGINT AS lines, sum(len(regexp_extract_all(text, '{T.NON_SPACE}')))::BIGINT AS words
  FROM conversations GROUP BY role, turn)"""


def role_turn(spark, root):
    return t(spark, root, "conversations").groupBy("role", "turn").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(T.word_count_ws(F.col("text"))).alias("words")
    )


@query("d08_fill_missing_groups", f"""WITH {ROLE_TURN}
SELECT r.role, t.turn, coalesce(lines, 0) AS lines, coalesce(words, 0) AS words
FROM (SELECT DISTINCT role FROM g) r CROSS JOIN (SELECT DISTINCT turn FROM g) t LEFT JOIN g ON g.role = r.role AND g.turn = t.turn""")
def d08(spark, root):
    return combine.fill_missing_groups(role_turn(spark, root), "role", "turn", ["lines", "words"])


@query("d09_share_of_total", f"""WITH {ROLE_TURN}
SELECT role, turn, {sr('words / sum(words) OVER (PARTITION BY turn)')} AS share FROM g""")
def d09(spark, root):
    part = role_turn(spark, root)
    total = part.groupBy("turn").agg(F.sum("words").alias("words"))
    return rounded(combine.share_of_total(part, total, ["turn"], "words").select("role", "turn", "share"), "share")


@query("d10_paired_delta", f"""
WITH p AS (SELECT least(n_chars / 5000.0, 1.0) AS a, l.doc_id % 97 / 97.0 AS b FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT count(*) AS pairs, {sr('avg(a)')} AS mean_before, {sr('avg(b)')} AS mean_after, {sr('avg(a) - avg(b)')} AS drop,
  {sr('avg((b < 0.5)::INT)')} AS below FROM p""")
def d10(spark, root):
    s = _scores(spark, root)
    out = combine.paired_delta(s.filter("model = 'chars'"), s.filter("model = 'id'"), "doc_id", "p")
    return rounded(out, "mean_before", "mean_after", "drop", "below")


@query("d11_error_table", f"""
WITH p AS (SELECT l.doc_id, quality AS truth, least(n_chars / 5000.0, 1.0)::DOUBLE AS p FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, truth, (p >= 0.5)::INTEGER AS predicted, {sr('p')} AS probability, CASE truth WHEN 0 THEN 'low' ELSE 'high' END AS truth_name,
  CASE WHEN p >= 0.5 THEN 'high' ELSE 'low' END AS predicted_name, true AS error FROM p WHERE truth <> (p >= 0.5)::INTEGER""")
def d11(spark, root):
    s = _scores(spark, root).filter("model = 'chars'").join(t(spark, root, "labels").select("doc_id", "quality"), "doc_id")
    return rounded(combine.error_table(s, "doc_id", "quality", "p", {0: "low", 1: "high"}), "probability")
