"""L: evaluation. Scores are simple rules on document length, clusters are assigned by rule, so
that every metric can be checked without a model."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.registry import SEED, query, r, rounded, sr, t
from weftwork.operators import evaluate, split

SCORED_SQL = f"""p AS (SELECT l.doc_id, quality, toxic, round(least(n_chars / 5000.0::DOUBLE, 1.0), 2) AS score,
  (round(least(n_chars / 5000.0::DOUBLE, 1.0), 2) >= 0.3)::INTEGER AS pred, (l.doc_id % 5)::INTEGER AS fold
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def scored(spark, root):
    d = t(spark, root, "documents").join(t(spark, root, "labels"), "doc_id")
    d = d.withColumn("score", F.round(F.least(F.col("n_chars") / 5000.0, F.lit(1.0)), 2))
    return d.select(
        "doc_id", "quality", "toxic", "score", (F.col("score") >= 0.3).cast("int").alias("pred"), (F.col("doc_id") % 5).cast("int").alias("fold")
    )


@query("l01_accuracy", f"WITH {SCORED_SQL} SELECT {sr('avg((quality = pred)::INT)')} AS accuracy FROM p")
def l01(spark, root):
    return rounded(evaluate.accuracy(scored(spark, root), "quality", "pred"), "accuracy")


CLASS_SQL = """k AS (SELECT label AS class FROM q UNION SELECT pred FROM q),
m AS (SELECT class, count(*) FILTER (label = class AND pred = class) AS h, count(*) FILTER (label = class) AS t, count(*) FILTER (pred = class) AS p
  FROM k, q GROUP BY class),
c AS (SELECT class, CASE WHEN p > 0 THEN h / p ELSE 0 END AS precision, CASE WHEN t > 0 THEN h / t ELSE 0 END AS recall,
  CASE WHEN t + p > 0 THEN 2 * h / (t + p) ELSE 0 END AS f1, t AS support FROM m)"""
DIGITS_SQL = "q AS (SELECT label, ((vec_id * 7 + label) % 10)::INTEGER AS guess, CASE WHEN vec_id % 3 = 0 THEN ((vec_id * 7 + label) % 10)::INTEGER ELSE label END AS pred FROM embeddings)"


def digits(spark, root):
    """Ten classes with a third of the predictions scrambled."""
    e = t(spark, root, "embeddings")
    guess = ((F.col("vec_id") * 7 + F.col("label")) % 10).cast("int")
    return e.withColumn("pred", F.when(F.col("vec_id") % 3 == 0, guess).otherwise(F.col("label")))


@query("l02_classification_report", f"""WITH {DIGITS_SQL}, {CLASS_SQL}
SELECT class::VARCHAR AS class, {sr('precision')} AS precision, {sr('recall')} AS recall, {sr('f1')} AS f1, support FROM c
UNION ALL SELECT 'macro avg', {sr('avg(precision)')}, {sr('avg(recall)')}, {sr('avg(f1)')}, sum(support)::BIGINT FROM c
UNION ALL SELECT 'weighted avg', {sr('sum(precision * support) / sum(support)')}, {sr('sum(recall * support) / sum(support)')},
  {sr('sum(f1 * support) / sum(support)')}, sum(support)::BIGINT FROM c""")
def l02(spark, root):
    return rounded(evaluate.classification_report(digits(spark, root), "label", "pred"), "precision", "recall", "f1")


@query("l03_f1", f"""WITH {DIGITS_SQL}, {CLASS_SQL}
SELECT {sr('max(CASE WHEN class = 1 THEN f1 END)')} AS f1_binary, {sr('avg(f1)')} AS f1_macro, {sr('sum(f1 * support) / sum(support)')} AS f1_weighted FROM c""")
def l03(spark, root):
    return rounded(evaluate.f1(digits(spark, root), "label", "pred"), "f1_binary", "f1_macro", "f1_weighted")


@query("l04_confusion", f"""WITH {SCORED_SQL}
SELECT quality AS truth, pred AS predicted, count(*) AS n, {sr('count(*) / sum(count(*)) OVER (PARTITION BY quality)')} AS share FROM p GROUP BY 1, 2""")
def l04(spark, root):
    return rounded(evaluate.confusion(scored(spark, root), "quality", "pred", normalize=True), "share")


def _auc_sql(source: str = "p") -> str:
    return f"""(SELECT sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) FROM (
      SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
        SELECT score, count(*) FILTER (quality = 1) AS pos, count(*) FILTER (quality <> 1) AS neg FROM {source} GROUP BY score)))"""


@query("l05_roc_auc", f"WITH {SCORED_SQL} SELECT {sr(_auc_sql())} AS auc")
def l05(spark, root):
    return rounded(evaluate.roc_auc(scored(spark, root), "score", "quality"), "auc")


@query("l05_roc_auc_lines", f"""
WITH p AS (SELECT l_extendedprice AS score, (l_returnflag = 'R')::INT AS quality FROM lineitem) SELECT {sr(_auc_sql())} AS auc""")
def l05_lines(spark, root):
    d = t(spark, root, "lineitem").select("l_extendedprice", (F.col("l_returnflag") == "R").cast("int").alias("returned"))
    return rounded(evaluate.roc_auc(d, "l_extendedprice", "returned"), "auc")


@query("l06_fold_auc", f"WITH {SCORED_SQL} " + " UNION ALL ".join(
    [f"SELECT '{i}' AS fold, {sr(_auc_sql(f'(SELECT * FROM p WHERE fold = {i})'))} AS auc" for i in range(5)] + [f"SELECT 'all', {sr(_auc_sql())}"]))
def l06(spark, root):
    return rounded(evaluate.fold_auc(scored(spark, root), "score", "quality", "fold"), "auc")


@query("l07_sens_spec", f"""WITH {SCORED_SQL}
SELECT {sr('count(*) FILTER (quality = 1 AND pred = 1) / count(*) FILTER (quality = 1)')} AS sensitivity,
  {sr('count(*) FILTER (quality = 0 AND pred = 0) / count(*) FILTER (quality = 0)')} AS specificity FROM p""")
def l07(spark, root):
    return rounded(evaluate.sens_spec(scored(spark, root), "quality", "pred"), "sensitivity", "specificity")


@query("l08_rates", f"""WITH {SCORED_SQL}
SELECT count(*) AS n, {sr('avg((score > 0.5)::INT)')} AS detection_rate, {sr('avg((score < 0.5)::INT)')} AS flip_rate FROM p""")
def l08(spark, root):
    return rounded(evaluate.rates(scored(spark, root), "score"), "detection_rate", "flip_rate")


SIL_SQL = """
x AS (SELECT vec_id, label, [v::DOUBLE FOR v IN embedding] AS v FROM embeddings),
u AS (SELECT vec_id, label, unnest(v) AS v, unnest(range(1, 65)) AS i FROM x),
s AS (SELECT label, i, sum(v) AS s FROM u GROUP BY 1, 2),
k AS (SELECT label, count(DISTINCT vec_id) AS n, sum(v * v) AS q FROM u GROUP BY 1),
n AS (SELECT vec_id, label, sum(v * v) AS q FROM u GROUP BY 1, 2),
dots AS (SELECT u.vec_id, s.label AS other, sum(u.v * s.s) AS dot FROM u JOIN s ON u.i = s.i GROUP BY 1, 2),
d AS (SELECT n.vec_id, n.label, dots.other, k.n, k.n * n.q + k.q - 2 * dot AS total FROM n JOIN dots ON n.vec_id = dots.vec_id JOIN k ON k.label = dots.other),
ab AS (SELECT vec_id, label, max(CASE WHEN other = label THEN total / (n - 1) END) AS a, min(CASE WHEN other <> label THEN total / n END) AS b FROM d GROUP BY 1, 2)"""


@query("l09_silhouette", f"WITH {SIL_SQL} SELECT {sr('avg((b - a) / greatest(a, b))')} AS silhouette FROM ab")
def l09(spark, root):
    return rounded(evaluate.silhouette(t(spark, root, "embeddings"), "vec_id", "label", "embedding"), "silhouette")


@query("l10_silhouette_rows", f"WITH {SIL_SQL} SELECT vec_id, label AS cluster, {sr('(b - a) / greatest(a, b)')} AS silhouette FROM ab")
def l10(spark, root):
    return rounded(evaluate.silhouette_rows(t(spark, root, "embeddings"), "vec_id", "label", "embedding"), "silhouette")


@query("l11_davies_bouldin", f"""WITH
u AS (SELECT vec_id, label, unnest([v::DOUBLE FOR v IN embedding]) AS v, unnest(range(1, 65)) AS i FROM embeddings),
m AS (SELECT label, i, avg(v) AS m FROM u GROUP BY 1, 2),
g AS (SELECT vec_id, u.label, sqrt(sum((v - m) * (v - m))) AS g FROM u JOIN m ON u.label = m.label AND u.i = m.i GROUP BY 1, 2),
s AS (SELECT label, avg(g) AS s FROM g GROUP BY 1),
c AS (SELECT a.label AS x, b.label AS y, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS gap FROM m a JOIN m b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2),
w AS (SELECT x, max((p.s + q.s) / gap) AS w FROM c JOIN s p ON p.label = x JOIN s q ON q.label = y GROUP BY x)
SELECT {sr('avg(w)')} AS davies_bouldin FROM w""")
def l11(spark, root):
    return rounded(evaluate.davies_bouldin(t(spark, root, "embeddings"), "label", "embedding"), "davies_bouldin")


CELLS_SQL = f"{DIGITS_SQL}, cells AS (SELECT label AS t, pred AS c, count(*) AS n FROM q GROUP BY 1, 2)"


@query("l12_ari", f"""WITH {CELLS_SQL},
v AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM cells) AS same, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM cells GROUP BY t)) AS a,
  (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM cells GROUP BY c)) AS b, (SELECT sum(n) * (sum(n) - 1) / 2 FROM cells) AS every)
SELECT {sr('(same - a * b / every) / ((a + b) / 2 - a * b / every)')} AS ari FROM v""")
def l12(spark, root):
    return rounded(evaluate.ari(digits(spark, root), "label", "pred"), "ari")


@query("l13_nmi", f"""WITH {CELLS_SQL}, s AS (SELECT sum(n)::DOUBLE AS s FROM cells),
ts AS (SELECT t, sum(n) AS tn FROM cells GROUP BY t), cs AS (SELECT c, sum(n) AS cn FROM cells GROUP BY c),
mi AS (SELECT sum(n / s * ln(n * s / (tn * cn))) AS mi FROM cells JOIN ts ON cells.t = ts.t JOIN cs ON cells.c = cs.c, s),
h AS (SELECT (SELECT -sum(tn / s * ln(tn / s)) FROM ts, s) AS ht, (SELECT -sum(cn / s * ln(cn / s)) FROM cs, s) AS hc)
SELECT {sr('mi / ((ht + hc) / 2)')} AS nmi FROM mi, h""")
def l13(spark, root):
    return rounded(evaluate.nmi(digits(spark, root), "label", "pred"), "nmi")


@query("l14_purity", f"""WITH {CELLS_SQL}
SELECT {sr('sum(m) / (SELECT sum(n) FROM cells)')} AS purity FROM (SELECT max(n) AS m FROM cells GROUP BY c)""")
def l14(spark, root):
    return rounded(evaluate.purity(digits(spark, root), "label", "pred"), "purity")


def _compare_sql(side: str, cond: str) -> str:
    return f"SELECT '{side}' AS part, {sr('avg((quality = pred)::INT)')} AS accuracy, count(*) AS n FROM p WHERE {cond}"


@query("l15_compare", f"WITH {SCORED_SQL} " + " UNION ALL ".join(
    [_compare_sql("train", "fold < 3"), _compare_sql("validation", "fold = 3"), _compare_sql("test", "fold = 4")]))
def l15(spark, root):
    d = scored(spark, root)
    parts = {"train": "fold < 3", "validation": "fold = 3", "test": "fold = 4"}
    rows = [
        d.filter(c).agg(F.lit(k).alias("part"), F.avg((F.col("quality") == F.col("pred")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))
        for k, c in parts.items()
    ]
    return rounded(evaluate.compare(rows, "accuracy"), "accuracy")


@query("l16_fold_improvement", f"""
WITH f AS (SELECT (user_id % 5)::INT AS fold, avg(CASE WHEN event_id % 2 = 0 THEN value END) AS a, avg(CASE WHEN event_id % 2 = 1 THEN value END) AS b
  FROM events GROUP BY 1), g AS (SELECT b - a AS gain FROM f)
SELECT count(*) AS folds, {sr('avg(gain)', 4)} AS mean_gain, {sr('stddev_samp(gain)', 4)} AS std_gain, {sr('min(gain)', 4)} AS min_gain, {sr('max(gain)', 4)} AS max_gain FROM g""")
def l16(spark, root):
    d = t(spark, root, "events").select(
        (F.col("user_id") % 5).alias("fold"), F.when(F.col("event_id") % 2 == 0, "plain").otherwise("augmented").alias("variant"), "value"
    )
    out = evaluate.fold_improvement(d, "fold", "variant", "value", "plain", "augmented")
    return rounded(out, "mean_gain", "std_gain", "min_gain", "max_gain", digits=4)


@query("l19_most_confident", f"""WITH {SCORED_SQL}
SELECT doc_id, score, 'low' AS "end" FROM (SELECT * FROM p ORDER BY score, doc_id LIMIT 10)
UNION ALL SELECT doc_id, score, 'high' FROM (SELECT * FROM p ORDER BY score DESC, doc_id LIMIT 10)""")
def l19(spark, root):
    return evaluate.most_confident(scored(spark, root).select("doc_id", "score"), "doc_id", "score", 10)
