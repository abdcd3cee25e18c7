"""K and the model reports of L: fits are iterative, so most have no SQL equivalent."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.sql import functions as F

from queries.registry import SEED, query, r, rounded, sr, t, texts
from queries.terms import PLAIN, WB_GRAMS
from weftwork.functions import text as T
from weftwork.operators import clusters, combine, hierarchy, kernels, models, split, terms, tuning
from weftwork.operators.encode import vector
from weftwork.operators.textfeat import text_features
from weftwork.operators.vectorize import TermVectorizer
from weftwork.session import write_once

DIMS = 64
STACKED = ["logistic", "tree", "text"]


def ten_classes(spark, root):
    return t(spark, root, "embeddings").select("vec_id", "embedding", vector("embedding").alias("features"), F.col("label").cast("double").alias("label"))


def two_classes(spark, root):
    return ten_classes(spark, root).withColumn("label", (F.col("label") < 5).cast("double"))


def scored(model, df):
    return rounded(models.score(model, df, "vec_id"), "p")


@query("k01_logistic")
def k01(spark, root):
    d = two_classes(spark, root)
    return scored(models.fit_logistic(d, C=1.0, l1_ratio=0.0), d)


@query("k01_logistic_multinomial")
def k01_multi(spark, root):
    d = ten_classes(spark, root)
    return models.fit_logistic(d, C=1.0, max_iter=30).transform(d).select("vec_id", F.col("prediction").cast("int").alias("prediction"))


@query("k01_logistic_weighted_l1")
def k01_weighted(spark, root):
    d = split.with_class_weight(two_classes(spark, root).withColumn("label", (F.col("vec_id") % 5 == 0).cast("double")), "label")
    return scored(models.fit_logistic(d, C=1.0, l1_ratio=1.0, weight="weight", max_iter=30), d)


@query("k02_linear_svm")
def k02(spark, root):
    d = two_classes(spark, root)
    return scored(models.fit_linear_svm(d, C=1.0, max_iter=30), d)


@query("k02_linear_svm_classes")
def k02_classes(spark, root):
    d = ten_classes(spark, root)
    out = models.fit_linear_svm(d, C=1.0, classes=10, max_iter=10).transform(d)
    return out.select("vec_id", F.col("prediction").cast("int").alias("prediction"))


@query("k03_poly_svm")
def k03(spark, root):
    d = two_classes(spark, root)
    model, prepare = kernels.fit_kernel_svm(d, "vec_id", "poly", degree=3, coef0=1.0, landmarks=128, seed=SEED, max_iter=20)
    return scored(model, prepare(d))


@query("k04_rbf_svm_landmarks")
def k04_landmarks(spark, root):
    d = two_classes(spark, root)
    model, prepare = kernels.fit_kernel_svm(d, "vec_id", "rbf", landmarks=128, seed=SEED, max_iter=20)
    return scored(model, prepare(d))


@query("k04_rbf_svm")
def k04(spark, root):
    d = two_classes(spark, root)
    model, prepare = models.fit_rbf_svm(d, DIMS, gamma=0.5, n_features=64, seed=SEED, max_iter=20)
    return scored(model, prepare(d))


@query("k05_linear_log_loss")
def k05(spark, root):
    d = two_classes(spark, root)
    return scored(models.fit_linear(d, "log", 1e-3, "l1", max_iter=30), d)


@query("k05_linear_hinge")
def k05_hinge(spark, root):
    d = two_classes(spark, root)
    return scored(models.fit_linear(d, "hinge", 1e-3, max_iter=30), d)


@query("k05_linear_hinge_l1")
def k05_hinge_l1(spark, root):
    d = two_classes(spark, root)
    return scored(models.fit_linear(d, "hinge", 1e-3, "l1", max_iter=15), d)


@query("k05_sgd_grid")
def k05_sgd(spark, root):
    """Settings of a text model by fold AUC: the grid is fitted in the same passes, fold by fold."""
    data = labelled_texts(spark, root)
    chosen = models.fit_folds(data, "fold", {"sgd": models.text_sgd(max_iter=12, vocabulary=20_000, **GRAMS)})
    return rounded(models.held_out_scores(data, "fold", "doc_id", chosen), "p")


def _knn_sql(k: int, gap: str, weight: str) -> str:
    return f"""
WITH x AS (SELECT vec_id, label, [v::DOUBLE FOR v IN embedding] AS v FROM embeddings),
p AS (SELECT q.vec_id, n.label, n.vec_id AS nid, {gap} AS d FROM x q, x n WHERE q.vec_id <> n.vec_id),
k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, nid) <= {k}),
z AS (SELECT *, max((d = 0)::INT) OVER (PARTITION BY vec_id) AS zero FROM k),
v AS (SELECT vec_id, label, round(sum({weight}), 9) AS s FROM z GROUP BY 1, 2)
SELECT vec_id, label AS predicted FROM v QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) = 1"""


@query("k06_knn", _knn_sql(5, "list_distance(q.v, n.v)", "1.0"))
def k06(spark, root):
    d = t(spark, root, "embeddings")
    return models.knn_predict(d, d, "vec_id", "label", "embedding", 5, exclude_self=True)


@query("k06_knn_city_block_weighted", _knn_sql(
    7, "list_sum(list_transform(list_zip(q.v, n.v), lambda z: abs(z[1] - z[2])))", "CASE WHEN zero = 1 THEN (d = 0)::INT ELSE 1 / d END"))
def k06_weighted(spark, root):
    d = t(spark, root, "embeddings")
    return models.knn_predict(d, d, "vec_id", "label", "embedding", 7, "distance", 1, exclude_self=True)


@query("k07_tree")
def k07(spark, root):
    d = two_classes(spark, root)
    return scored(models.fit_tree(d, 5, 2), d)


@query("k08_bagged_trees")
def k08(spark, root):
    d = two_classes(spark, root)
    return scored(models.fit_bagged_trees(d, 10, 4, SEED), d)


@query("k09_forest")
def k09(spark, root):
    d = two_classes(spark, root)
    return scored(models.fit_forest(d, 15, 4, SEED), d)


@query("k10_adaboost")
def k10(spark, root):
    d = two_classes(spark, root)
    return rounded(models.predict_adaboost(models.fit_adaboost(d, 5), d, "vec_id"), "p")


@query("k11_gbt")
def k11(spark, root):
    d = two_classes(spark, root).withColumn("held_out", F.col("vec_id") % 5 == 0)
    return scored(models.fit_gbt(d, 8, 3, 0.1, "held_out", SEED), d)


@query("k12_gaussian_nb")
def k12(spark, root):
    d = two_classes(spark, root)
    return scored(models.fit_gaussian_nb(d), d)


@query("k12_gaussian_nb_moments", """
WITH u AS (SELECT vec_id, label, unnest([v::DOUBLE FOR v IN embedding]) AS v, unnest(range(1, 65)) AS i FROM embeddings),
e AS (SELECT max(s) * 1e-9 AS e FROM (SELECT var_pop(v) AS s FROM u GROUP BY i)),
k AS (SELECT label, i, avg(v) AS m, var_pop(v) + (SELECT e FROM e) AS s FROM u GROUP BY 1, 2),
pr AS (SELECT label, ln(count(*) / (SELECT count(*) FROM embeddings)) AS p FROM embeddings GROUP BY 1),
l AS (SELECT u.vec_id, k.label, sum(-0.5 * (ln(2 * pi() * s) + (v - m) * (v - m) / s)) AS l FROM u JOIN k ON u.i = k.i GROUP BY 1, 2)
SELECT vec_id, l.label AS predicted FROM l JOIN pr ON l.label = pr.label QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY l + p DESC, l.label) = 1""")
def k12_moments(spark, root):
    d = t(spark, root, "embeddings")
    return models.gaussian_nb_predict(d, d, "vec_id", "label", "embedding")


@query("k13_mlp")
def k13(spark, root):
    d = two_classes(spark, root)
    return scored(models.fit_mlp(d, [DIMS, 128, 64, 32, 2], SEED, 15), d)


def rule_scores(spark, root):
    d = t(spark, root, "documents").join(t(spark, root, "labels"), "doc_id")
    return d.select(
        "doc_id", "quality",
        F.least(F.col("n_chars") / 5000.0, F.lit(1.0)).alias("p1"),
        (F.col("doc_id") % 97 / 97.0).alias("p2"),
        (1.0 - F.col("toxic")).alias("p3"),
    )


RULES_SQL = "s AS (SELECT l.doc_id, quality, least(n_chars / 5000.0, 1.0) AS p1, l.doc_id % 97 / 97.0 AS p2, 1.0 - toxic AS p3 FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


@query("k14_vote_hard", f"WITH {RULES_SQL} SELECT doc_id, ((p1 >= 0.5)::INT + (p2 >= 0.5)::INT + (p3 >= 0.5)::INT >= 2)::INTEGER AS predicted FROM s")
def k14(spark, root):
    d = rule_scores(spark, root).select("doc_id", *[(F.col(p) >= 0.5).cast("int").alias(f"c{p}") for p in ("p1", "p2", "p3")])
    return d.select("doc_id", models.vote_hard(d, ["cp1", "cp2", "cp3"]).alias("predicted"))


@query("k15_vote_soft", f"WITH {RULES_SQL} SELECT doc_id, {sr('(p1 + p2 + p3) / 3')} AS p FROM s")
def k15(spark, root):
    return rounded(rule_scores(spark, root).select("doc_id", models.vote_soft(["p1", "p2", "p3"]).alias("p")), "p")


@query("k18_mean_over_models", f"WITH {RULES_SQL} SELECT doc_id, {sr('(p1 + p2 + p3) / 3')} AS p, 3::BIGINT AS models FROM s")
def k18(spark, root):
    long = rule_scores(spark, root).select("doc_id", F.explode(F.array("p1", "p2", "p3")).alias("p"))
    return rounded(models.mean_over_models(long, "doc_id", "p"), "p")


DOC_FEATURES = ["word_count", "lexical_diversity", "avg_sentence_length", "avg_word_length", "punctuation_ratio", "burstiness"]


def labelled_features(spark, root):
    d = texts(spark, root).join(t(spark, root, "labels").select("doc_id", "quality"), "doc_id")
    d = split.stratified_folds(text_features(d), "quality", 3, "doc_id", SEED)
    x = F.array(*[F.col(c).cast("double") for c in DOC_FEATURES])
    return write_once(d.select("doc_id", "fold", F.col("quality").cast("double").alias("label"), x.alias("x"), vector(x).alias("features")))


def _base_models():
    return {
        "logistic": lambda d: models.fit_logistic(d, C=1.0, max_iter=20),
        "tree": lambda d: models.fit_tree(d, 3, 5),
    }


@query("k19_knn_grid")
def k19_knn(spark, root):
    d = t(spark, root, "embeddings").select("vec_id", "embedding", (F.col("label") % 2).alias("y"), F.pmod(F.xxhash64("vec_id"), F.lit(2)).cast("int").alias("fold"))
    return rounded(models.search_knn(d, "vec_id", "y", "embedding", "fold", [3, 7]).drop("p"), "f1", "std")


@query("k19_knn_grid_scaled", """
WITH b AS (SELECT vec_id, label % 2 AS y, (vec_id % 3)::INT AS fold, [v::DOUBLE FOR v IN embedding] AS v FROM embeddings),
u AS (SELECT vec_id, fold, unnest(v) AS v, unnest(range(1, 65)) AS i FROM b),
m AS (SELECT f.fold, i, avg(v) AS m, stddev_pop(v) AS s FROM u, (SELECT DISTINCT fold FROM b) f WHERE u.fold <> f.fold GROUP BY 1, 2),
x AS (SELECT m.fold AS run, u.fold, vec_id, list((v - m) / s ORDER BY m.i) AS v FROM u JOIN m ON m.i = u.i GROUP BY 1, 2, 3),
d AS (SELECT q.run, q.vec_id, n.vec_id AS nid, list_distance(q.v, n.v) AS d2, list_sum(list_transform(list_zip(q.v, n.v), lambda z: abs(z[1] - z[2]))) AS d1
  FROM x q JOIN x n ON q.run = n.run AND q.fold = q.run AND n.fold <> n.run),
e AS (SELECT vec_id, nid, 2 AS p, d2 AS d FROM d UNION ALL SELECT vec_id, nid, 1, d1 FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY p, vec_id ORDER BY d, nid) AS r FROM e QUALIFY r <= 5),
z AS (SELECT *, min(d) OVER (PARTITION BY p, vec_id) = 0 AS zero FROM k),
g AS (SELECT p, z.vec_id, k, weights, n.y, round(sum(CASE WHEN weights = 'uniform' THEN 1.0 WHEN zero THEN (d = 0)::INT ELSE 1 / d END), 9) AS s
  FROM z JOIN b n ON n.vec_id = nid, (VALUES (3), (5)) ks(k), (VALUES ('uniform'), ('distance')) ws(weights) WHERE r <= k GROUP BY 1, 2, 3, 4, 5),
v AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY p, vec_id, k, weights ORDER BY s DESC, y) = 1),
f AS (SELECT v.p, v.k, v.weights, b.fold, 2.0 * count(*) FILTER (b.y = 1 AND v.y = 1) / greatest(count(*) FILTER (b.y = 1) + count(*) FILTER (v.y = 1), 1) AS f1
  FROM v JOIN b ON b.vec_id = v.vec_id GROUP BY 1, 2, 3, 4)
SELECT k::INTEGER AS k, weights, p::INTEGER AS p, round(avg(f1)::DOUBLE, 6) + 0.0 AS f1, round(stddev_pop(f1)::DOUBLE, 6) + 0.0 AS std FROM f GROUP BY 1, 2, 3""")
def k19_knn_scaled(spark, root):
    d = t(spark, root, "embeddings").select("vec_id", "embedding", (F.col("label") % 2).alias("y"), (F.col("vec_id") % 3).cast("int").alias("fold"))
    return rounded(models.search_knn(d, "vec_id", "y", "embedding", "fold", [3, 5], ["uniform", "distance"], [1, 2], scale=True), "f1", "std")


@query("k17_oof_predictions")
def k17(spark, root):
    return rounded(models.oof_predictions(labelled_features(spark, root), "fold", "doc_id", _base_models()), "p")


GRAMS = {"counts": "plain", "grams": [3, 5]}  # what the text models count


def plain_text(df):
    """``df`` with the text whose character n-grams the text models count as ``plain``."""
    return df.withColumn("plain", terms.gram_text(T.strip_accents(F.lower(F.trim(F.coalesce("text", F.lit("")))))))


def labelled_texts(spark, root):
    """The labelled texts that the text models take, with their folds, written once."""
    labels = split.stratified_folds(t(spark, root, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "label", 3, "doc_id", SEED)
    d = texts(spark, root).join(labels, "doc_id")
    return write_once(plain_text(d).select("doc_id", "fold", "label", "plain"), by=["fold"])


@query("k17_text_oof")
def k17_text(spark, root):
    data = labelled_texts(spark, root)
    fitted = models.fit_text_folds(data, "fold", {"text": lambda train: models.fit_text_logistic(train, max_iter=20, **GRAMS)})
    return rounded(models.held_out_scores(data, "fold", "doc_id", fitted), "p")


@query("k17_fold_tfidf", f"""
WITH l AS (SELECT doc_id, row_number() OVER (PARTITION BY quality ORDER BY md5('{SEED}|' || doc_id), doc_id) AS i, count(*) OVER (PARTITION BY quality) AS n FROM labels),
c AS (SELECT d.doc_id, {PLAIN} AS text FROM documents d JOIN l ON l.doc_id = d.doc_id WHERE i > floor(n / 3.0)::BIGINT),
p AS (SELECT doc_id, ' ' || unnest(regexp_extract_all(text, '{T.NON_SPACE}')) || ' ' AS p FROM c),
g AS (SELECT doc_id, term, count(*) AS n FROM ({WB_GRAMS}) GROUP BY 1, 2),
s AS (SELECT term, count(*) AS df, sum(n) AS cf FROM g GROUP BY 1 HAVING count(*) >= 2),
k AS (SELECT term, ln((1 + (SELECT count(*) FROM c)) / (1.0::DOUBLE + df)) + 1 AS idf FROM s ORDER BY cf DESC, term LIMIT 5000),
v AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS place, idf FROM k),
w AS (SELECT doc_id, place, (1 + ln(n)) * idf AS w FROM g JOIN v ON g.term = v.term)
SELECT doc_id, place, {sr('w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))')} AS tfidf FROM w""")
def k17_tfidf(spark, root):
    """The vectors a fold's text model is fitted on, in long form."""
    train = labelled_texts(spark, root).filter("fold <> 0")
    model = TermVectorizer(inputCol="plain", grams=[3, 5], maxFeatures=5000, minDF=2).fit(train)
    entries = F.unwrap_udt("tfidf")
    pairs = F.explode(F.arrays_zip(entries["indices"].alias("place"), entries["values"].alias("tfidf")))
    out = model.transform(train).select("doc_id", pairs.alias("e")).select("doc_id", F.col("e.place").cast("bigint").alias("place"), "e.tfidf")
    return rounded(out, "tfidf")


def _stack(spark, root):
    """Numeric base models and a text model on one set of folds, then the meta-model."""
    d = labelled_features(spark, root)
    oof = models.oof_predictions(d, "fold", "doc_id", _base_models())
    plain = plain_text(texts(spark, root).join(d.select("doc_id", "fold", "label"), "doc_id")).select("doc_id", "fold", "label", "plain")
    plain = write_once(plain, by=["fold"])
    text = models.fit_text_folds(plain, "fold", {"text": lambda train: models.fit_text_logistic(train, vocabulary=20_000, max_iter=10, **GRAMS)})
    oof = oof.unionByName(models.held_out_scores(plain, "fold", "doc_id", text))
    wide = combine.stack_predictions(oof, "doc_id", "model", "p", STACKED).join(d.select("doc_id", "fold", "label"), "doc_id")
    return wide, models.fit_stack(wide, STACKED, "label", [0.1, 1.0], "fold")


@query("k16_stack")
def k16(spark, root):
    wide, cv = _stack(spark, root)
    data = wide.withColumn("features", vector(F.array(*STACKED)))
    return rounded(models.score(cv.bestModel, data, "doc_id"), "p")


@query("l17_coefficients")
def l17(spark, root):
    wide, cv = _stack(spark, root)
    return rounded(models.coefficients(cv.bestModel, STACKED, wide), "coefficient", digits=4)


@query("l18_permutation_importance")
def l18(spark, root):
    d = labelled_features(spark, root)
    return rounded(models.permutation_importance(models.fit_tree(d, 4, 5), d, "doc_id", DOC_FEATURES), "drop")


@query("k19_grid_search")
def k19(spark, root):
    d = two_classes(spark, root).withColumn("fold", (F.col("vec_id") % 3).cast("int"))
    lr = LogisticRegression(maxIter=15)
    cv = models.grid_search(d, lr, [{lr.regParam: v} for v in (0.01, 0.1)], "fold", "f1_macro", parallelism=2)
    return rounded(models.search_table(cv, d), "mean", "std")


@query("k20_random_search")
def k20(spark, root):
    d = two_classes(spark, root).withColumn("fold", (F.col("vec_id") % 2).cast("int"))
    gbt = GBTClassifier(maxIter=3, seed=SEED)
    cv = models.random_search(d, gbt, {gbt.maxDepth: (2, 4, "int"), gbt.stepSize: (0.05, 0.5, "log")}, 2, "fold", "auc", SEED)
    return rounded(models.search_table(cv, d), "mean", "std")


@query("k20_successive_halving")
def k20_halving(spark, root):
    d = two_classes(spark, root).withColumn("fold", (F.col("vec_id") % 2).cast("int"))
    space = {"depth": (1, 4, "int"), "step": (0.05, 0.9, "log")}
    return rounded(tuning.successive_halving(d, space, "fold", draws=6, first=2, most=6, seed=SEED).table(d), "mean", "std")


@query("k21_kmeans")
def k21(spark, root):
    d = ten_classes(spark, root)
    return clusters.fit_kmeans(d, 10, 3, SEED).transform(d).select("vec_id", F.col("prediction").alias("cluster"))


@query("k22_elbow")
def k22(spark, root):
    return rounded(clusters.elbow(ten_classes(spark, root), [2, 4, 6, 8], SEED), "cost", digits=3)


@query("k23_hierarchical")
def k23(spark, root):
    d = ten_classes(spark, root)
    return clusters.fit_hierarchical(d, 10, SEED).transform(d).select("vec_id", F.col("prediction").alias("cluster"))


@query("k23_ward")
def k23_ward(spark, root):
    d = t(spark, root, "embeddings")
    return hierarchy.ward(d, "vec_id", "embedding").cut(10)


@query("k23_dendrogram")
def k23_dendrogram(spark, root):
    d = t(spark, root, "embeddings")
    return rounded(hierarchy.ward(d, "vec_id", "embedding").dendrogram(), "height", digits=4)


@query("k24_dbscan", """
WITH RECURSIVE p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
near AS (SELECT a.id AS a, b.id AS b FROM p a, p b WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.03::DOUBLE * 0.03::DOUBLE),
core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 8),
link AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach AS (SELECT id AS a, id AS b FROM core UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT b AS id, min(a) AS comp FROM reach GROUP BY b),
num AS (SELECT comp, row_number() OVER (ORDER BY comp) - 1 AS cluster FROM (SELECT DISTINCT comp FROM comp)),
lab AS (SELECT near.a AS id, min(comp) AS comp FROM near JOIN comp ON near.b = comp.id GROUP BY near.a)
SELECT p.id AS vec_id, coalesce(cluster, -1)::BIGINT AS cluster FROM p LEFT JOIN lab ON p.id = lab.id LEFT JOIN num ON lab.comp = num.comp""")
def k24(spark, root):
    d = t(spark, root, "embeddings").select("vec_id", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    return clusters.dbscan(d, "vec_id", ["x", "y"], 0.03, 8)


@query("k24_dbscan_all_columns", """
WITH RECURSIVE u AS (SELECT vec_id, unnest([v::DOUBLE FOR v IN embedding]) AS v, unnest(range(1, 65)) AS i FROM embeddings),
m AS (SELECT i, avg(v) AS m, stddev_pop(v) AS s FROM u GROUP BY i),
p AS (SELECT vec_id AS id, list((v - m) / s ORDER BY m.i) AS x FROM u JOIN m ON u.i = m.i GROUP BY 1),
near AS (SELECT a.id AS a, b.id AS b FROM p a, p b WHERE list_distance(a.x, b.x) <= 9.5),
core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 6),
link AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach AS (SELECT id AS a, id AS b FROM core UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT b AS id, min(a) AS comp FROM reach GROUP BY b),
num AS (SELECT comp, row_number() OVER (ORDER BY comp) - 1 AS cluster FROM (SELECT DISTINCT comp FROM comp)),
lab AS (SELECT near.a AS id, min(comp) AS comp FROM near JOIN comp ON near.b = comp.id GROUP BY near.a)
SELECT p.id AS vec_id, coalesce(cluster, -1)::BIGINT AS cluster FROM p LEFT JOIN lab ON p.id = lab.id LEFT JOIN num ON lab.comp = num.comp""")
def k24_all(spark, root):
    """All 64 dimensions, standardised."""
    scaled, = models.standardised(t(spark, root, "embeddings").select("vec_id", "embedding"), [], "embedding")
    return clusters.dbscan(scaled, "vec_id", "embedding", 9.5, 6)


@query("k25_assign_nearest", f"""
WITH u AS (SELECT label, unnest([v::DOUBLE FOR v IN embedding]) AS v, unnest(range(1, 65)) AS i, vec_id FROM embeddings),
m AS (SELECT label, i, avg(v) AS m FROM u GROUP BY 1, 2),
d AS (SELECT vec_id, m.label AS cluster, sqrt(sum((v - m) * (v - m))) AS d FROM u JOIN m ON u.i = m.i GROUP BY 1, 2)
SELECT vec_id, cluster, {sr('d')} AS distance FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d.d, cluster) = 1""")
def k25(spark, root):
    from weftwork.operators.evaluate import cluster_sums

    d = t(spark, root, "embeddings")
    sums = cluster_sums(d, "label", "embedding")
    centres = sums.select("cluster", F.transform("s", lambda v: v / F.col("n")).alias("centre"))
    return rounded(clusters.assign_nearest(d, centres, "vec_id", "embedding"), "distance")
