"""J: encoding, scaling, projection."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from queries.registry import query, r, rounded, sr, t
from weftwork.operators import encode

LINE_KEYS = "l_orderkey, l_linenumber, l_partkey"


@query("j01_one_hot", """SELECT doc_id, lang = 'de' AS lang_de, lang = 'en' AS lang_en, lang = 'es' AS lang_es, lang = 'fr' AS lang_fr FROM documents""")
def j01(spark, root):
    return encode.one_hot(t(spark, root, "documents").select("doc_id", "lang"), "lang", "lang").drop("lang")


@query("j01_one_hot_vector", """
SELECT o_orderkey, dense_rank() OVER (ORDER BY o_custkey) - 1 AS place, 1.0::DOUBLE AS value, (SELECT count(DISTINCT o_custkey) FROM orders)::INTEGER AS size FROM orders""")
def j01_vector(spark, root):
    """A column of as many values as there are customers."""
    d = encode.one_hot_vector(t(spark, root, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "customer")
    v = F.unwrap_udt("customer")
    return d.select("o_orderkey", v["indices"][0].cast("bigint").alias("place"), v["values"][0].alias("value"), v["size"].alias("size"))


@query("j02_label_encode", """
SELECT o_orderkey, o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code, o_orderpriority AS back FROM orders""")
def j02(spark, root):
    d = t(spark, root, "orders").select("o_orderkey", "o_orderpriority")
    codes = encode.label_codes(d, "o_orderpriority")
    return encode.label_decode(encode.label_encode(d, "o_orderpriority", "code", codes), "code", codes, "back")


@query("j03_minmax_scale", f"""
WITH m AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS d FROM lineitem)
SELECT {LINE_KEYS}, {sr('(l_quantity - a) / (b - a)')} AS l_quantity, {sr('(l_extendedprice - c) / (d - c)')} AS l_extendedprice, 0.0::DOUBLE AS same FROM lineitem, m""")
def j03(spark, root):
    d = t(spark, root, "lineitem").select(*LINE_KEYS.split(", "), "l_quantity", "l_extendedprice", F.lit(7.0).alias("same"))
    return rounded(encode.minmax_scale(d, ["l_quantity", "l_extendedprice", "same"]), "l_quantity", "l_extendedprice")


@query("j04_standardize", f"""
WITH m AS (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS b, avg(l_extendedprice) AS c, stddev_pop(l_extendedprice) AS d FROM lineitem)
SELECT {LINE_KEYS}, {sr('(l_quantity - a) / b')} AS l_quantity, {sr('(l_extendedprice - c) / d')} AS l_extendedprice FROM lineitem, m""")
def j04(spark, root):
    d = t(spark, root, "lineitem").select(*LINE_KEYS.split(", "), "l_quantity", "l_extendedprice")
    return rounded(encode.standardize(d, ["l_quantity", "l_extendedprice"]), "l_quantity", "l_extendedprice")


def vectors(spark, root):
    return t(spark, root, "embeddings").select("vec_id", "label", "embedding", encode.vector("embedding").alias("features"))


@query("j05_pca")
def j05(spark, root):
    out, _ = encode.pca(vectors(spark, root), 2)
    return out.select("vec_id", "label", F.transform("pcs", lambda x: r(x, 4)).alias("pcs"))


@query("j06_pca_variance")
def j06(spark, root):
    out, ratios = encode.pca_variance(vectors(spark, root), 64, 0.95)
    return out.select("vec_id", F.size("pcs").alias("kept"), F.lit(round(sum(ratios), 6)).alias("explained"))


@query("j07_assemble", f"SELECT {LINE_KEYS}, [l_quantity, l_discount, l_tax] AS features FROM lineitem")
def j07(spark, root):
    d = encode.assemble(t(spark, root, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return d.select(*LINE_KEYS.split(", "), vector_to_array("features").alias("features"))
