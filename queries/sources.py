"""A: sources and sinks. File formats are checked by a round trip through the shared folder."""

from __future__ import annotations

import uuid

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from queries.registry import query, r, rounded, sr, t
from weftwork.functions import text as T
from weftwork.operators import combine
from weftwork.operators.encode import vector
from weftwork.operators.textfeat import text_features
from weftwork.session import shared_dir
from weftwork.sources import cache, tables


def folder(spark, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex[:12]}"


ORDER_SCHEMA = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
ORDER_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 4) + 0.0 AS o_totalprice, o_orderdate, o_orderpriority FROM orders"


@query("a01_read_csv", ORDER_SQL)
def a01(spark, root):
    path = folder(spark, "orders-csv")
    tables.write_table(t(spark, root, "orders"), path, "csv")
    return rounded(tables.read_table(spark, path, ORDER_SCHEMA), "o_totalprice", digits=4)


@query("a01_read_csv_text", "SELECT doc_id, text FROM documents")
def a01_text(spark, root):
    path = folder(spark, "documents-csv")
    tables.write_table(t(spark, root, "documents").select("doc_id", "text"), path, "csv")
    return tables.read_table(spark, path, "doc_id long, text string", multi_line=True)


@query("a02_read_semicolon", "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 4) + 0.0 AS c_acctbal, c_mktsegment FROM customer")
def a02(spark, root):
    path = folder(spark, "customer-csv")
    t(spark, root, "customer").write.option("header", True).option("sep", ";").csv(path)
    schema = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return rounded(tables.read_table(spark, path, schema, sep=";"), "c_acctbal", digits=4)


@query("a03_read_json_records", "SELECT item_id, text FROM benchmark")
def a03(spark, root):
    path = folder(spark, "benchmark-json")
    # one JSON array a line; the partitions bound the records of a file
    d = t(spark, root, "benchmark").withColumn("note", F.lit("dropped"))
    record = F.to_json(F.struct("item_id", "text", "note"))
    arrays = d.groupBy(F.floor(F.col("item_id") / 25).alias("g")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(record), ","), F.lit("]")).alias("value"))
    arrays.select("value").write.text(path)
    return tables.read_json_records(spark, path, ["item_id", "text"], "item_id long, text string, note string", multi_line=False)


@query("a04_json_fields", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def a04(spark, root):
    return tables.json_fields(t(spark, root, "events").select("event_id", "props"), "props", "k long").drop("props")


@query("a05_parse_annotations", f"""
WITH a AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '{T.NON_SPACE}'), lambda c: c <> 'n/a') AS codes FROM documents)
SELECT doc_id, codes, (len(codes) > 0)::INTEGER AS label FROM a""")
def a05(spark, root):
    d = t(spark, root, "documents").select("doc_id", "text")
    return tables.parse_annotations(d, "text").drop("text")


@query("a06_read_ids", "SELECT doc_id::VARCHAR AS id FROM labels")
def a06(spark, root):
    path = folder(spark, "ids")
    lines = t(spark, root, "labels").select(F.concat(F.lit("  "), F.col("doc_id").cast("string"), F.lit(" ")).alias("value"))
    lines.unionByName(lines.select(F.lit("   ").alias("value"))).write.text(path)
    return tables.read_ids(spark, path)


@query("a07_file_catalog", "SELECT DISTINCT 'lang=' || lang AS label FROM documents")
def a07(spark, root):
    path = folder(spark, "catalog")
    t(spark, root, "documents").select("lang", "doc_id").write.partitionBy("lang").parquet(path)
    return tables.file_catalog(spark, path, "*.parquet").select("label").distinct()


@query("a08_catalog_diff", """
SELECT doc_id, 'new' AS status FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'vanished' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT doc_id, 'missing_output' FROM labels WHERE toxic = 1 AND doc_id IN (SELECT doc_id FROM documents)""")
def a08(spark, root):
    stored = t(spark, root, "labels").select("doc_id", F.when(F.col("toxic") == 0, "done").alias("output"))
    return combine.catalog_diff(stored, t(spark, root, "documents"), "doc_id")


@query("a09_resolve_column", "SELECT doc_id, text FROM documents")
def a09(spark, root):
    d = t(spark, root, "documents").select("doc_id", F.col("text").alias("content"))
    return tables.resolve_column(d, "text", ["text_content", "content"])


@query("a10_write_table", "SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem")
def a10(spark, root):
    path = folder(spark, "lines")
    d = t(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    tables.write_table(d, path, partition_by=["l_returnflag"])
    return tables.read_table(spark, path, fmt="parquet")


@query("a11_cached_features", f"""
SELECT doc_id, length(text)::BIGINT AS n, true AS second_was_cached, false AS first_was_cached FROM documents""")
def a11(spark, root):
    path = folder(spark, "features")
    build = lambda d: d.select("doc_id", F.length("text").cast("bigint").alias("n"))
    d = t(spark, root, "documents").select("doc_id", "text")
    _, first = cache.cached_features(d, build, path)
    feats, second = cache.cached_features(d, build, path)
    return feats.withColumns({"first_was_cached": F.lit(first), "second_was_cached": F.lit(second)})


@query("a12_model_artefacts")
def a12(spark, root):
    d = t(spark, root, "embeddings").select("vec_id", vector("embedding").alias("features"), (F.col("label") < 5).cast("double").alias("label"))
    model = LogisticRegression(maxIter=5).fit(d)
    path = folder(spark, "model")
    tables.save_model(model, path)
    return tables.load_model(path).transform(d).select("vec_id", "prediction")


@query("a13_submission", f"SELECT doc_id AS id, {sr('least(n_chars / 5000.0, 1.0)')} AS prediction FROM documents")
def a13(spark, root):
    d = t(spark, root, "documents").withColumn("p", F.least(F.col("n_chars") / 5000.0, F.lit(1.0)))
    return rounded(tables.submission(d, "doc_id", "p"), "prediction")
