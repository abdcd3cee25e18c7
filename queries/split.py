"""G: samples, splits, folds, weights. Resampling (SMOTE, bootstrap, augmentation) at the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.registry import SEED, query, r, rounded, sr, t
from weftwork.functions.hashing import hex_threshold, row_hash
from weftwork.operators import resample, split

H = f"md5('{SEED}|' || {{}})"


@query("g01_sample_n", f"SELECT o_orderkey, o_orderstatus FROM orders ORDER BY {H.format('o_orderkey')}, o_orderkey LIMIT 1000")
def g01(spark, root):
    return split.sample_n(t(spark, root, "orders").select("o_orderkey", "o_orderstatus"), 1000, "o_orderkey", SEED)


@query("g02_random_split", f"""
SELECT o_orderkey, CASE WHEN substr({H.format('o_orderkey')}, 1, 8) < '{hex_threshold(0.2)}' THEN 'test' ELSE 'train' END AS side FROM orders""")
def g02(spark, root):
    train, test = split.random_split(t(spark, root, "orders").select("o_orderkey"), 0.2, "o_orderkey", SEED)
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


@query("g03_stratified_split", f"""
WITH n AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {H.format('o_orderkey')}, o_orderkey) AS i,
  count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderkey, o_orderstatus, CASE WHEN i <= floor(n * 0.2::DOUBLE + 0.5) THEN 'test' ELSE 'train' END AS split FROM n""")
def g03(spark, root):
    return split.stratified_split(t(spark, root, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", 0.2, "o_orderkey", SEED)


@query("g04_split_fallback", f"""
SELECT doc_id, CASE WHEN substr({H.format('doc_id')}, 1, 8) < '{hex_threshold(0.2)}' THEN 'test' ELSE 'train' END AS split, 'no label column' AS reason
FROM documents""")
def g04(spark, root):
    out, reason = split.split_with_fallback(t(spark, root, "documents"), "quality", 0.2, "doc_id", SEED)
    return out.select("doc_id", "split", F.lit(reason).alias("reason"))


@query("g05_flag_split", """
SELECT doc_id, CASE WHEN toxic = 1 THEN 'flagged' ELSE 'plain' END AS side FROM labels""")
def g05(spark, root):
    plain, flagged = split.flag_split(t(spark, root, "labels").select("doc_id", "toxic"), "toxic")
    both = plain.withColumn("side", F.lit("plain")).unionByName(flagged.withColumn("side", F.lit("flagged")))
    return both.select("doc_id", "side")


@query("g06_stratified_folds", f"""
WITH n AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {H.format('doc_id')}, doc_id) AS i,
  count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT doc_id, quality, ((i > floor(n / 5.0)::BIGINT)::INT + (i > floor(n * 2 / 5.0)::BIGINT)::INT + (i > floor(n * 3 / 5.0)::BIGINT)::INT
  + (i > floor(n * 4 / 5.0)::BIGINT)::INT)::INTEGER AS fold FROM n""")
def g06(spark, root):
    return split.stratified_folds(t(spark, root, "labels").select("doc_id", "quality"), "quality", 5, "doc_id", SEED)


@query("g07_group_folds")
def g07(spark, root):
    d = t(spark, root, "documents").select("doc_id", "source")
    return split.group_folds(d, "source", 5, SEED)


@query("g07_group_folds_hash", f"""
SELECT o_orderkey, o_custkey, (('0x' || substr({H.format('o_custkey')}, 1, 8))::BIGINT % 5)::INTEGER AS fold FROM orders""")
def g07_hash(spark, root):
    d = t(spark, root, "orders").select("o_orderkey", "o_custkey")
    return d.withColumn("fold", split.hash_fold(split.row_hash("o_custkey", SEED), 5))


@query("g08_class_weights", f"""
WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality), s AS (SELECT sum(n) AS n, count(*) AS k FROM c)
SELECT quality, c.n, {sr('s.n / (k * c.n)')} AS weight, {sr('(s.n - c.n) / c.n')} AS pos_weight FROM c, s""")
def g08(spark, root):
    return rounded(split.class_weights(t(spark, root, "labels"), "quality"), "weight", "pos_weight")


@query("g08_weighted_rows", f"""
WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality), s AS (SELECT sum(n) AS n, count(*) AS k FROM c)
SELECT doc_id, l.quality, {sr('s.n / (k * c.n)')} AS weight FROM labels l JOIN c ON l.quality = c.quality, s""")
def g08_rows(spark, root):
    return rounded(split.with_class_weight(t(spark, root, "labels").select("doc_id", "quality"), "quality"), "weight")


@query("g09_smote", f"""
WITH x AS (SELECT vec_id, [v::DOUBLE FOR v IN embedding] AS v FROM embeddings WHERE label < 2),
n AS (SELECT (SELECT count(*) FROM x) AS few, (SELECT count(*) FROM embeddings WHERE label >= 2) AS many),
near AS (SELECT a.vec_id, b.vec_id AS neighbour, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS rank
  FROM x a, x b WHERE a.vec_id <> b.vec_id QUALIFY rank <= 5),
dealt AS (SELECT vec_id, v, row_number() OVER (ORDER BY {H.format('vec_id')}, vec_id) - 1 AS i FROM x),
c AS (SELECT vec_id, v, unnest(range(1, ((many - few) // few + (i < (many - few) % few)::INT + 1)::BIGINT))::INTEGER AS copy FROM dealt, n),
u AS (SELECT *, md5('{SEED}|' || vec_id || '|' || copy) AS h FROM c),
p AS (SELECT u.vec_id, copy, u.v, near.neighbour, ('0x' || substr(h, 9, 8))::BIGINT / 4294967296.0::DOUBLE AS gap
  FROM u JOIN near ON near.vec_id = u.vec_id AND near.rank = ('0x' || substr(h, 1, 8))::BIGINT % 5 + 1)
SELECT p.vec_id AS parent, p.neighbour, copy, list_transform(list_zip(p.v, o.v), lambda z: {sr('z[1] + (z[2] - z[1]) * p.gap')}) AS embedding
FROM p JOIN x o ON o.vec_id = p.neighbour""")
def g09(spark, root):
    e = t(spark, root, "embeddings").withColumn("target", (F.col("label") < 2).cast("int"))
    out = resample.smote(e, "vec_id", "embedding", "target", seed=SEED)
    return out.withColumn("embedding", F.transform("embedding", lambda x: r(x)))


@query("g10_bootstrap", f"""
WITH u AS (SELECT vec_id, b.r::INTEGER AS replica, ('0x' || substr(md5('{SEED}|' || b.r || '|' || vec_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM embeddings, range(3) b(r)),
p AS (SELECT *, (u >= 0.36787944117144233)::INT + (u >= 0.7357588823428847)::INT + (u >= 0.9196986029286058)::INT + (u >= 0.9810118431238462)::INT
  + (u >= 0.9963401531726563)::INT + (u >= 0.9994058151824183)::INT + (u >= 0.9999167588507119)::INT + (u >= 0.9999897508033253)::INT
  + (u >= 0.999998874797402)::INT + (u >= 0.9999998885745217)::INT AS copies FROM u)
SELECT vec_id, replica, c.c::INTEGER AS copy FROM p, range(10) c(c) WHERE c.c < copies""")
def g10(spark, root):
    return resample.bootstrap(t(spark, root, "embeddings").select("vec_id"), "vec_id", 3, SEED)


def _grid_sql(kind: str, expr: str) -> str:
    return f"SELECT vec_id, '{kind}' AS kind, [embedding[({expr})::INT + 1] FOR i IN range(64)] AS grid FROM embeddings"


@query("g11_augment_grid", " UNION ALL ".join([
    _grid_sql("original", "i"),
    _grid_sql("flip_h", "(i // 8) * 8 + 7 - i % 8"),
    _grid_sql("flip_v", "(7 - i // 8) * 8 + i % 8"),
    _grid_sql("rot90", "(i % 8) * 8 + 7 - i // 8"),
    _grid_sql("rot180", "63 - i"),
    _grid_sql("rot270", "(7 - i % 8) * 8 + i // 8"),
]))
def g11(spark, root):
    out = resample.augment_grid(t(spark, root, "embeddings").select("vec_id", "embedding"), "embedding", 8, 8)
    return out.select("vec_id", "kind", "grid")
