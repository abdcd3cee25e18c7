"""C: filters, projections, repair; and the flagship corpus query."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.registry import SEED, S, query, r, rounded, sql_feature_ctes, sql_strip, sr, t, texts
from weftwork.functions import text as T
from weftwork.operators import clean
from weftwork.operators.combine import dedup_keep_first
from weftwork.operators.textfeat import text_features
from weftwork.plans.corpus import quality_rules

NORM = f"trim(regexp_replace(text, '{S}+', ' ', 'g'))"


QUALITY_SQL = {
    "word_count_gt_0": "word_count > 0",
    "avg_word_length_le_20": "avg_word_length <= 20",
    "avg_sentence_length_le_200": "avg_sentence_length <= 200",
    "gunning_fog_index_le_60": "gunning_fog_index <= 60",
    "flesch_reading_ease_ge_-100": "flesch_reading_ease >= -100",
}
FLAG_COLS = ["word_count", "lexical_diversity", "avg_sentence_length", "avg_word_length", "punctuation_ratio", "burstiness"]


@query("a00_corpus_quality", f"""
WITH s AS (SELECT doc_id, lang, {sql_strip("coalesce(text, '')")} AS text FROM documents),
d AS (SELECT min(doc_id) AS doc_id, text FROM s WHERE length(text) >= 1 GROUP BY text),
k AS (SELECT s.* FROM s JOIN d ON s.doc_id = d.doc_id),
{sql_feature_ctes('k', 'doc_id, lang')}
SELECT lang, count(*) AS n, {', '.join(f"{sr(f'avg({c})', 4)} AS {c}" for c in FLAG_COLS)}
FROM feats WHERE {' AND '.join(QUALITY_SQL.values())} GROUP BY lang""")
def corpus_quality(spark, root):
    d = clean.strip_min_chars(texts(spark, root).select("doc_id", "lang", "text"), "text", 1)
    d = dedup_keep_first(d, ["text"], "doc_id", digest=["text"])
    kept, _ = clean.apply_rules(text_features(d), quality_rules(), derived=True)
    out = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in FLAG_COLS])
    return rounded(out, *FLAG_COLS, digits=4)


@query("c01_strip_min_chars", f"SELECT doc_id, {sql_strip('text')} AS text FROM documents WHERE length({sql_strip('text')}) >= 200")
def c01(spark, root):
    return clean.strip_min_chars(t(spark, root, "documents").select("doc_id", "text"), "text", 200)


@query("c02_normalize_ws", f"SELECT doc_id, {NORM} AS text FROM documents")
def c02(spark, root):
    return t(spark, root, "documents").select("doc_id", T.normalize_ws(F.col("text")).alias("text"))


@query("c03_drop_empty", f"""
WITH n AS (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '{S}+', ' ', 'g')) AS text FROM pages)
SELECT page_id, text, length(text)::BIGINT AS length FROM n WHERE length(text) > 0""")
def c03(spark, root):
    d = t(spark, root, "pages").select("page_id", T.normalize_ws(F.regexp_replace("html", "<[^>]*>", "")).alias("text"))
    return clean.drop_empty(d, "text")


@query("c04_drop_flagged", """
SELECT count(*)::BIGINT AS rows_before, count(*) FILTER (toxic = 0) AS rows_after, count(*) FILTER (toxic <> 0) AS dropped FROM labels""")
def c04(spark, root):
    return clean.flagged_report(t(spark, root, "labels"), "toxic")


@query("c05_drop_header_rows", "SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, role, text FROM conversations")
def c05(spark, root):
    d = t(spark, root, "conversations").select(F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text")
    header = d.select(*[F.lit(c).alias(c) for c in d.columns]).limit(3)
    return clean.drop_header_rows(d.unionByName(header))


@query("c06_cast_columns", "SELECT conv_id::INTEGER AS conv_id, turn::INTEGER AS turn, role FROM conversations")
def c06(spark, root):
    d = t(spark, root, "conversations").select(F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role")
    return clean.cast_columns(d, {"conv_id": "int", "turn": "int"})


@query("c07_coerce_numeric", """
SELECT p_partkey, TRY_CAST(CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_size::VARCHAR END AS DOUBLE) AS size FROM part""")
def c07(spark, root):
    d = t(spark, root, "part").select(
        "p_partkey", F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(F.col("p_size").cast("string")).alias("size")
    )
    return clean.coerce_numeric(d, ["size"])


@query("c08_apply_rules", f"""WITH {sql_feature_ctes(keys='doc_id, lang')}
SELECT doc_id, word_count, {sr('flesch_reading_ease')} AS flesch_reading_ease FROM feats WHERE {' AND '.join(QUALITY_SQL.values())}""")
def c08(spark, root):
    kept, _ = clean.apply_rules(text_features(texts(spark, root)), quality_rules(), derived=True)
    return rounded(kept.select("doc_id", "word_count", "flesch_reading_ease"), "flesch_reading_ease")


@query("c08_apply_rules_report", f"""WITH {sql_feature_ctes(keys='doc_id, lang')}
SELECT 'rows_start' AS rule, count(*) AS n FROM feats
UNION ALL SELECT 'rows_after_filters', count(*) FROM feats WHERE {' AND '.join(QUALITY_SQL.values())}
UNION ALL SELECT 'total_dropped', count(*) FROM feats WHERE NOT ({' AND '.join(QUALITY_SQL.values())})
""" + " ".join(f"UNION ALL SELECT '{k}', count(*) FROM feats WHERE NOT ({v})" for k, v in QUALITY_SQL.items()))
def c08_report(spark, root):
    return clean.apply_rules(text_features(texts(spark, root)), quality_rules())[1]


@query("c09_drop_constant", "SELECT event_id, event_type, value, user_id FROM events")
def c09(spark, root):
    d = t(spark, root, "events").select(
        "event_id", "event_type", "value", "user_id", F.lit("v1").alias("version"), F.year("ts").alias("year"), F.lit(None).cast("int").alias("gap")
    )
    return clean.drop_constant(d, keep=["event_id"])


@query("c10_clip_quantiles", f"""
WITH q AS (SELECT quantile_cont(l_extendedprice, 0.01) AS a, quantile_cont(l_extendedprice, 0.99) AS b,
  quantile_cont(l_quantity, 0.01) AS c, quantile_cont(l_quantity, 0.99) AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, {sr('least(greatest(l_extendedprice, a), b)', 4)} AS l_extendedprice,
  {sr('least(greatest(l_quantity, c), d)', 4)} AS l_quantity FROM lineitem, q""")
def c10(spark, root):
    d = t(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    return rounded(clean.clip_quantiles(d, ["l_extendedprice", "l_quantity"]), "l_extendedprice", "l_quantity", digits=4)


@query("c11_drop_iqr_outliers", """
WITH k AS (SELECT o_custkey, count(*) AS orders, sum(o_totalprice) AS spent FROM orders GROUP BY o_custkey),
q AS (SELECT quantile_cont(orders, 0.25) AS a, quantile_cont(orders, 0.75) AS b, quantile_cont(spent, 0.25) AS c, quantile_cont(spent, 0.75) AS d FROM k)
SELECT o_custkey, orders FROM k, q WHERE NOT (orders < a - 1.5 * (b - a) OR orders > b + 1.5 * (b - a)
  OR spent < c - 1.5 * (d - c) OR spent > d + 1.5 * (d - c))""")
def c11(spark, root):
    k = t(spark, root, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("spent"))
    return clean.drop_iqr_outliers(k, ["orders", "spent"]).select("o_custkey", "orders")


@query("c12_impute_zero_mean", f"""
WITH m AS (SELECT avg(nullif(l_discount, 0)) AS a, avg(nullif(l_tax, 0)) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, {sr('CASE WHEN l_discount = 0 THEN a ELSE l_discount END')} AS l_discount,
  {sr('CASE WHEN l_tax = 0 THEN b ELSE l_tax END')} AS l_tax FROM lineitem, m""")
def c12(spark, root):
    d = t(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_tax")
    return rounded(clean.impute_zero_mean(d, ["l_discount", "l_tax"]), "l_discount", "l_tax")


@query("c13_median_impute", f"""
WITH j AS (SELECT d.doc_id, CASE WHEN l.quality IS NOT NULL THEN n_chars END AS n_chars, l.quality, l.doc_id IS NOT NULL AS is_train
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
m AS (SELECT median(n_chars) AS mc, median(quality) AS mq FROM j WHERE is_train)
SELECT doc_id, {sr('coalesce(n_chars, mc)')} AS n_chars, {sr('coalesce(quality, mq)')} AS quality, 0.0::DOUBLE AS absent FROM j, m""")
def c13(spark, root):
    d, l = t(spark, root, "documents"), t(spark, root, "labels")
    train = d.join(l.select("doc_id", "quality"), "doc_id").withColumn("absent", F.lit(None).cast("double"))
    test = d.join(l, "doc_id", "left_anti").select(
        "doc_id", F.lit(None).cast("bigint").alias("n_chars"), F.lit(None).cast("int").alias("quality")
    )
    medians = clean.fit_medians(train, ["n_chars", "quality", "absent"])
    both = [clean.apply_medians(side, medians).select("doc_id", "n_chars", "quality", "absent") for side in (train, test)]
    return rounded(both[0].unionByName(both[1]), "n_chars", "quality")


@query("c14_log1p_skewed", f"""
SELECT l_orderkey, l_linenumber, l_partkey, {sr('ln(1 + l_extendedprice)')} AS l_extendedprice, l_discount, l_shipdate >= TIMESTAMP '1998-01-01' AS is_test FROM lineitem""")
def c14(spark, root):
    d = t(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_shipdate")
    late = F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")
    train, test = clean.log1p_skewed(d.filter(~late), d.filter(late), ["l_extendedprice", "l_discount"])
    both = train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))
    return rounded(both.drop("l_shipdate"), "l_extendedprice")


@query("c15_ensure_columns", """
SELECT d.doc_id, coalesce(l.quality, 0) AS quality, 'unknown' AS multi_label, 0 AS potential_noise, lang
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def c15(spark, root):
    d = t(spark, root, "documents").join(t(spark, root, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", "quality", "lang")
    return clean.ensure_columns(d, {"quality": 0, "multi_label": "unknown", "potential_noise": 0, "lang": "unknown"})


@query("c16_when_column", "SELECT doc_id, CASE WHEN quality = 1 THEN 'unknown_model' ELSE 'human' END AS multi_label FROM labels")
def c16(spark, root):
    d = t(spark, root, "labels").select("doc_id", "quality")
    return clean.when_column(d, "multi_label", F.col("quality") == 1, "unknown_model", "human").drop("quality")


@query("c17_map_codes", "SELECT doc_id, CASE quality WHEN 0 THEN 'low' WHEN 1 THEN 'high' END AS name FROM labels")
def c17(spark, root):
    return clean.map_codes(t(spark, root, "labels"), "quality", {0: "low", 1: "high"}, "name").select("doc_id", "name")


@query("c18_filter_classes", f"""
SELECT vec_id, label FROM embeddings WHERE label IN (3, 5) ORDER BY md5('{SEED}|' || vec_id), vec_id LIMIT 50""")
def c18(spark, root):
    return clean.filter_classes(t(spark, root, "embeddings").select("vec_id", "label"), "label", [3, 5], "vec_id", 50, SEED)


@query("c19_trim_chars", "SELECT doc_id, substr(text, 1, 1200) AS text FROM documents")
def c19(spark, root):
    return t(spark, root, "documents").select("doc_id", T.trim_chars(F.col("text"), 1200).alias("text"))


@query("c20_scale_array", f"SELECT vec_id, list_transform(embedding, lambda x: {sr('x::DOUBLE / 255.0::DOUBLE', 9)}) AS scaled FROM embeddings")
def c20(spark, root):
    d = t(spark, root, "embeddings").select("vec_id", clean.scale_array("embedding", 255.0).alias("scaled"))
    return d.withColumn("scaled", F.transform("scaled", lambda x: r(x, 9)))


FIXED_COLUMNS = ["word_count", "lexical_diversity", "burstiness", "length", "potential_noise", "lang_en", "lang_unknown", "model_unknown_model"]


@query("c21_inference_frame", f"""WITH {sql_feature_ctes(keys='doc_id, text')}
SELECT doc_id, word_count::DOUBLE AS word_count, {sr('lexical_diversity')} AS lexical_diversity, {sr('burstiness')} AS burstiness,
  length(text)::DOUBLE AS length, 0.0::DOUBLE AS potential_noise, 0.0::DOUBLE AS lang_en, 1.0::DOUBLE AS lang_unknown, 1.0::DOUBLE AS model_unknown_model FROM feats""")
def c21(spark, root):
    out = clean.inference_frame(
        texts(spark, root).select("doc_id", "text"), "doc_id", "text", FIXED_COLUMNS, ["lang_unknown", "model_unknown_model"]
    )
    return rounded(out, "lexical_diversity", "burstiness")


@query("c22_ratio", f"""
SELECT conv_id, {sr(rf"sum(len(regexp_extract_all(text, '{T.NON_SPACE}'))) / count(DISTINCT role)")} AS words_per_role,
  {sr('count(*) / nullif(count(*) FILTER (role = $$system$$), 0)')} AS per_system FROM conversations GROUP BY conv_id""")
def c22(spark, root):
    g = t(spark, root, "conversations").groupBy("conv_id").agg(
        F.sum(T.word_count_ws(F.col("text"))).alias("words"),
        F.count_distinct("role").alias("roles"),
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("role") == "system").alias("system"),
    )
    return g.select(
        "conv_id",
        r(clean.ratio(F.col("words"), F.col("roles"))).alias("words_per_role"),
        r(clean.ratio(F.col("lines"), F.col("system"))).alias("per_system"),
    )


@query("c23_remove_newlines", "SELECT doc_id, replace(text, chr(10), '') AS text FROM documents")
def c23(spark, root):
    return t(spark, root, "documents").select("doc_id", T.remove_newlines(F.col("text")).alias("text"))


@query("c24_filter_equal", "SELECT * FROM conversations WHERE role = 'user' AND turn = 2")
def c24(spark, root):
    return clean.filter_equal(t(spark, root, "conversations"), {"role": "user", "turn": 2})
