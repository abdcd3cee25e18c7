"""B: profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.registry import query, rounded, sql_feature_ctes, sr, t, texts
from weftwork.functions import text as T
from weftwork.operators import profile
from weftwork.operators.encode import one_hot
from weftwork.operators.textfeat import text_features

LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("b01_overview", f"""
SELECT count(*)::BIGINT AS rows, 5::BIGINT AS columns, {sr('avg(length(text))')} AS text_length_mean,
  {sr('median(length(text))')} AS text_length_median FROM documents""")
def b01(spark, root):
    return rounded(profile.overview(t(spark, root, "documents"), "text"), "text_length_mean", "text_length_median")


COLUMN_TYPES = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
}


@query("b02_column_types", " UNION ALL ".join(
    f"SELECT '{name}' AS \"table\", '{c.split()[0]}' AS \"column\", '{c.split()[1]}' AS type, (SELECT count(*) FROM {name}) AS rows"
    for name, cols in COLUMN_TYPES.items() for c in cols.split(", ")))
def b02(spark, root):
    out = None
    for name in COLUMN_TYPES:
        d = t(spark, root, name)
        rows = d.agg(F.count(F.lit(1)).alias("rows")).scalar()
        types = profile.column_types(d).withColumns({"table": F.lit(name), "rows": rows})
        out = types if out is None else out.unionByName(types)
    return out


def _with_nulls(d):
    return d.select(
        F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
        F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("l_tax"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("l_returnflag"),
        "l_quantity",
    )


@query("b03_null_counts", """
SELECT * FROM (
  SELECT 'l_discount' AS "column", count(*) FILTER (l_discount = 0) AS n FROM lineitem
  UNION ALL SELECT 'l_tax', count(*) FILTER (l_tax = 0) FROM lineitem
  UNION ALL SELECT 'l_returnflag', count(*) FILTER (l_returnflag = 'N') FROM lineitem) WHERE n > 0""")
def b03(spark, root):
    return profile.null_counts(_with_nulls(t(spark, root, "lineitem")))


@query("b04_zero_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} = 0) AS n FROM lineitem" for c in LINE_NUM))
def b04(spark, root):
    return profile.zero_counts(t(spark, root, "lineitem"), LINE_NUM)


ORDER_COLS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("b05_distinct_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n FROM orders" for c in ORDER_COLS))
def b05(spark, root):
    return profile.distinct_counts(t(spark, root, "orders"), ORDER_COLS)


def _describe_sql(cols, probs, table="lineitem"):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, {sr(f'avg({c})', 3)} AS mean, {sr(f'stddev_samp({c})', 3)} AS std, "
        f"{sr(f'min({c})', 4)} AS min, {sr(f'max({c})', 4)} AS max, "
        + ", ".join(f"{sr(f'quantile_cont({c}, {p})', 4)} AS p{round(p * 100):02d}" for p in probs)
        + f" FROM {table}"
        for c in cols
    )


def _describe(d, cols, probs):
    out = profile.describe(d, cols, probs)
    return rounded(rounded(out, "mean", "std", digits=3), "min", "max", *[f"p{round(p * 100):02d}" for p in probs], digits=4)


@query("b06_describe", _describe_sql(LINE_NUM, [0.25, 0.5, 0.75]))
def b06(spark, root):
    return _describe(t(spark, root, "lineitem"), LINE_NUM, [0.25, 0.5, 0.75])


@query("b07_describe_percentiles", _describe_sql(LINE_NUM, [0.01, 0.05, 0.5, 0.95, 0.99]))
def b07(spark, root):
    return _describe(t(spark, root, "lineitem"), LINE_NUM, [0.01, 0.05, 0.5, 0.95, 0.99])


@query("b08_value_counts", f"""
SELECT lang, count(*) AS n, {sr('count(*) / (SELECT count(*) FROM documents)')} AS share FROM documents GROUP BY lang""")
def b08(spark, root):
    return rounded(profile.value_counts(t(spark, root, "documents"), "lang"), "share")


@query("b09_unique", "SELECT DISTINCT source FROM documents")
def b09(spark, root):
    return profile.unique(t(spark, root, "documents"), "source")


@query("b10_duplicate_counts", """
SELECT (SELECT count(*) - count(DISTINCT text) FROM documents)::BIGINT AS duplicate_texts,
  (SELECT (SELECT count(*) FROM documents) - count(*) FROM (SELECT DISTINCT text, lang, source FROM documents))::BIGINT AS duplicate_rows""")
def b10(spark, root):
    d = t(spark, root, "documents")
    texts = profile.duplicate_counts(d, ["text"], digest=["text"]).select(F.col("duplicates").alias("duplicate_texts"))
    rows = profile.duplicate_counts(d, ["text", "lang", "source"], digest=["text"])
    return texts.withColumn("duplicate_rows", rows.scalar())


@query("b11_constant_columns", """
SELECT * FROM (
  SELECT 'event_type' AS "column", count(DISTINCT event_type) + max((event_type IS NULL)::INT) AS n FROM events
  UNION ALL SELECT 'value', count(DISTINCT value) + max((value IS NULL)::INT) FROM events
  UNION ALL SELECT 'version', 1
  UNION ALL SELECT 'year', count(DISTINCT year(ts)) FROM events) WHERE n = 1""".replace("SELECT * FROM", 'SELECT "column" FROM'))
def b11(spark, root):
    d = t(spark, root, "events").select("event_type", "value", F.lit("v1").alias("version"), F.year("ts").alias("year"))
    return profile.constant_columns_table(d)


@query("b12_column_kinds", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CASE WHEN count(DISTINCT {c}) + max(({c} IS NULL)::INT) <= 10 THEN 'categorical' ELSE 'continuous' END AS kind FROM orders"
    for c in ORDER_COLS))
def b12(spark, root):
    return profile.column_kinds(t(spark, root, "orders"), ORDER_COLS)


@query("b13_numeric_columns", f"""
SELECT 'l_quantity' AS "column", {sr('avg(l_quantity)', 4)} AS mean FROM lineitem
UNION ALL SELECT 'l_extendedprice', {sr('avg(l_extendedprice)', 4)} FROM lineitem
UNION ALL SELECT 'l_discount', {sr('avg(l_discount)', 4)} FROM lineitem
UNION ALL SELECT 'l_tax', {sr('avg(l_tax)', 4)} FROM lineitem""")
def b13(spark, root):
    d = t(spark, root, "lineitem")
    cols = profile.numeric_columns(d, drop=["l_orderkey", "l_linenumber"], prefixes=["l_part", "l_supp"])
    return rounded(profile.describe(d, cols, [0.5]).select("column", "mean"), "mean", digits=4)


def anomaly_rules():
    # Names and thresholds of the anomaly counts
    return {
        "length_vs_char_mismatch": F.abs(F.col("n_chars") - F.col("character_count")) > 0,
        "word_count_zero": F.col("word_count") <= 0,
        "avg_word_length_gt_20": F.col("avg_word_length") > 20,
        "avg_sentence_length_gt_200": F.col("avg_sentence_length") > 200,
        "gunning_fog_index_gt_60": F.col("gunning_fog_index") > 60,
        "flesch_reading_ease_lt_-100": F.col("flesch_reading_ease") < -100,
    }


ANOMALY_SQL = {
    "length_vs_char_mismatch": "abs(n_chars - character_count) > 0",
    "word_count_zero": "word_count <= 0",
    "avg_word_length_gt_20": "avg_word_length > 20",
    "avg_sentence_length_gt_200": "avg_sentence_length > 200",
    "gunning_fog_index_gt_60": "gunning_fog_index > 60",
    "flesch_reading_ease_lt_-100": "flesch_reading_ease < -100",
}


@query("b14_rule_counts", f"WITH {sql_feature_ctes(keys='doc_id, n_chars')} " + " UNION ALL ".join(
    f"SELECT '{k}' AS rule, count(*) FILTER ({v}) AS n FROM feats" for k, v in ANOMALY_SQL.items()))
def b14(spark, root):
    return profile.rule_counts(text_features(texts(spark, root)), anomaly_rules())


@query("b15_flag_sums", "SELECT 'lang_' || lang AS \"column\", count(*) AS n FROM documents GROUP BY lang")
def b15(spark, root):
    return profile.flag_sums(one_hot(t(spark, root, "documents"), "lang", "lang"), "lang_")


@query("b16_histogram", f"""
WITH lim AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
c AS (SELECT least(floor((l_extendedprice - lo) * 30 / (hi - lo)), 29)::BIGINT AS bin, count(*) AS n FROM lineitem, lim GROUP BY 1)
SELECT g.bin::BIGINT AS bin, {sr('lo + g.bin * (hi - lo) / 30', 4)} AS low, {sr('lo + (g.bin + 1) * (hi - lo) / 30', 4)} AS high,
  coalesce(n, 0)::BIGINT AS n FROM range(30) g(bin) CROSS JOIN lim LEFT JOIN c ON c.bin = g.bin""")
def b16(spark, root):
    return rounded(profile.histogram(t(spark, root, "lineitem"), "l_extendedprice", 30), "low", "high", digits=4)


CORR = ["l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query("b17_label_correlation", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {sr(f'corr({c}, l_quantity)')} AS corr FROM lineitem" for c in CORR))
def b17(spark, root):
    return rounded(profile.label_correlation(t(spark, root, "lineitem"), CORR, "l_quantity"), "corr")


@query("b18_correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {sr(f'corr({a}, {b})')} AS corr FROM lineitem" for a in LINE_NUM for b in LINE_NUM))
def b18(spark, root):
    return rounded(profile.correlation_matrix(t(spark, root, "lineitem"), LINE_NUM), "corr")


@query("b19_iqr_outliers", """
WITH q AS (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.75) AS b FROM customer),
p AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders),
s AS (SELECT count(*)::DOUBLE AS n FROM orders GROUP BY o_custkey),
k AS (SELECT quantile_cont(n, 0.25) AS a, quantile_cont(n, 0.75) AS b FROM s)
SELECT 'o_totalprice' AS "column", count(*) FILTER (o_totalprice < a - 1.5 * (b - a) OR o_totalprice > b + 1.5 * (b - a)) AS n FROM orders, p
UNION ALL SELECT 'orders_per_customer', count(*) FILTER (n < a - 1.5 * (b - a) OR n > b + 1.5 * (b - a)) FROM s, k""".replace(
    "WITH q AS (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.75) AS b FROM customer),\n", "WITH "))
def b19(spark, root):
    o = t(spark, root, "orders")
    per = o.groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("orders_per_customer"))
    return profile.iqr_outliers(o, ["o_totalprice"]).unionByName(profile.iqr_outliers(per, ["orders_per_customer"]))


@query("b20_class_balance", f"SELECT count(*) AS n, {sr('avg(quality)')} AS positive_rate FROM labels")
def b20(spark, root):
    return rounded(profile.class_balance(t(spark, root, "labels"), "quality"), "positive_rate")


@query("b21_detect_group_column", """
WITH c AS (
  SELECT 1 AS i, 'doc_id' AS "column", count(DISTINCT doc_id) AS groups, count(*) AS n FROM documents
  UNION ALL SELECT 2, 'lang', count(DISTINCT lang), count(*) FROM documents
  UNION ALL SELECT 3, 'source', count(DISTINCT source), count(*) FROM documents)
SELECT "column", groups FROM c WHERE groups > 1 AND groups < n ORDER BY i LIMIT 1""")
def b21(spark, root):
    d = t(spark, root, "documents")
    name = profile.detect_group_column(d, ["doc", "source", "lang"])
    return d.agg(F.lit(name).alias("column"), F.count_distinct(name).alias("groups"))


@query("b22_totals", rf"""
SELECT count(*) AS lines, sum(len(regexp_extract_all(text, '{T.NON_SPACE}')))::BIGINT AS words,
  count(DISTINCT conv_id) AS groups FROM conversations""")
def b22(spark, root):
    return profile.totals(t(spark, root, "conversations"), T.word_count_ws(F.col("text")), "conv_id")
