"""Terms, encoders, metrics, neighbours and clusters against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from weftwork import session
from weftwork.functions import text as T
from weftwork.operators import clusters, encode, evaluate, models, neighbors, resample, terms
from weftwork.operators.sgd import SGDLinear, SGDLinearModel, fit_sgd_grid, loss_and_slope
from weftwork.operators.vectorize import TermVectorizer


def test_group_ngrams_equal_those_of_the_joined_text(spark):
    rng = random.Random(5)
    rows = [(f"s{i % 3}" if i % 4 else "s0", i, [rng.choice("abcd") for _ in range(rng.choice([0, 0, 1, 2, 5]))]) for i in range(120)]
    df = spark.createDataFrame(rows, "who string, i int, toks array<string>").repartition(6)
    for n in (1, 2, 3, 4):
        want = Counter()
        for who in {r[0] for r in rows}:
            joined = [t for r in rows if r[0] == who for t in r[2]]
            want.update((who, " ".join(joined[i : i + n])) for i in range(len(joined) - n + 1))
        got = Counter((r["who"], r["term"]) for r in terms.group_ngrams(df, "who", ["i"], "toks", n).collect())
        assert got == want


def test_tfidf_has_unit_length_and_the_smooth_idf(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, [])], "id int, t array<string>")
    got = {(r["id"], r["term"]): r["tfidf"] for r in terms.tfidf(df, "id", F.col("t")).collect()}
    ia, ib = math.log(4 / 2) + 1, math.log(4 / 3) + 1
    norm = math.hypot(2 * ia, ib)
    assert got == pytest.approx({(1, "a"): 2 * ia / norm, (1, "b"): ib / norm, (2, "b"): 1.0})
    by_group = terms.transform_tfidf(terms.group_terms(df, "id", F.col("t")), terms.fit_idf(terms.group_terms(df, "id", F.col("t")), 3), "id")
    assert {(r["id"], r["term"]): r["tfidf"] for r in by_group.collect()} == pytest.approx(got)


def test_scaling_constants(spark):
    df = spark.createDataFrame([(1.0, 7.0, None), (3.0, 7.0, None)], "a double, same double, gone double")
    mm = encode.minmax_scale(df, ["a", "same", "gone"]).orderBy("a").collect()
    assert [tuple(r) for r in mm] == [(0.0, 0.0, None), (1.0, 0.0, None)]
    st = encode.standardize(df, ["a", "same"]).orderBy("a").collect()
    assert [(r["a"], r["same"]) for r in st] == [(-1.0, 0.0), (1.0, 0.0)]


def test_auc(spark):
    rng = random.Random(2)
    rows = [(round(rng.random(), 1), int(rng.random() < 0.4)) for _ in range(300)]
    df = spark.createDataFrame(rows, "s double, y int")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg)
    auc = lambda d, c: evaluate.roc_auc(d, c, "y").first()["auc"]
    assert auc(df, "s") == pytest.approx(want)
    assert auc(df.withColumn("r", -F.col("s")), "r") == pytest.approx(1 - want)
    assert auc(df.withColumn("y", F.lit(1)), "s") is None
    assert auc(spark.createDataFrame([(0.1, 0), (0.9, 1)], "s double, y int"), "s") == 1.0


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(4)
    pts = [(i, 0, rng.normal(0, 0.1, 3).tolist()) for i in range(20)] + [(20 + i, 1, rng.normal(3, 0.1, 3).tolist()) for i in range(20)]
    pts.append((40, 2, [9.0, 9.0, 9.0]))
    return pts, spark.createDataFrame(pts, "id long, c int, x array<double>")


def test_silhouette_rows_by_brute_force(blobs):
    pts, df = blobs
    got = {r["id"]: r["silhouette"] for r in evaluate.silhouette_rows(df, "id", "c", "x").collect()}
    gap = lambda a, b: sum((u - v) ** 2 for u, v in zip(a, b))
    for i, c, x in pts:
        own = [gap(x, y) for j, k, y in pts if k == c and j != i]
        if not own:
            assert got[i] == 0.0
            continue
        a = sum(own) / len(own)
        b = min(np.mean([gap(x, y) for _, k, y in pts if k == o]) for o in {0, 1, 2} - {c})
        assert got[i] == pytest.approx((b - a) / max(a, b), abs=1e-9)


def test_perfect_clusterings(blobs):
    _, df = blobs
    named = df.withColumn("k", F.lit(7) - F.col("c"))
    assert evaluate.ari(named, "c", "k").first()[0] == pytest.approx(1.0)
    assert evaluate.nmi(named, "c", "k").first()[0] == pytest.approx(1.0)
    assert evaluate.purity(named, "c", "k").first()[0] == 1.0


def test_sens_spec_without_positives(spark):
    df = spark.createDataFrame([(0, 0), (0, 1)], "y int, p int")
    assert tuple(evaluate.sens_spec(df, "y", "p").first()) == (0.0, 0.5)


@pytest.mark.parametrize("p", [1, 2])
@pytest.mark.parametrize("exclude", [False, True])
def test_nearest_rows_with_many_copies(spark, p, exclude):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(0, 1, (300, 3)), 1)
    x[:100] = x[0]  # a third of all rows are copies of one
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(5)
    got = {}
    for r in neighbors.nearest_rows(df, df, "id", "x", 4, p, exclude_self=exclude, block_rows=16).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    for i in range(300):
        d = np.sqrt(((x - x[i]) ** 2).sum(1)) if p == 2 else np.abs(x - x[i]).sum(1)
        want = sorted((j for j in range(300) if not (exclude and j == i)), key=lambda j: (d[j], j))[:4]
        mine = [j for _, j in sorted(got[i])]
        assert [round(d[j], 9) for j in mine] == [round(d[j], 9) for j in want]
        if p == 2 and i < 100:
            assert mine == want


@pytest.mark.parametrize("kind", ["string", "date", "int"])
def test_nearest_rows_with_ids_of_any_type(spark, kind):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (80, 4))
    x[40:60] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, x array<double>").repartition(3)
    name = {"string": F.format_string("row-%04d", 500 - F.col("i")), "date": F.date_add(F.lit("2020-01-01").cast("date"), -F.col("i")), "int": -F.col("i")}[kind]
    df = df.withColumn("id", name)
    names = {r["i"]: r["id"] for r in df.collect()}
    back = {v: k for k, v in names.items()}
    got = {}
    for r in neighbors.nearest_rows(df, df, "id", "x", 3, exclude_self=True, block_rows=8).collect():
        got.setdefault(back[r["id"]], []).append((r["rank"], back[r["neighbour"]]))
    for i in range(80):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        want = sorted((j for j in range(80) if j != i), key=lambda j: (d[j], names[j]))[:3]
        assert [j for _, j in sorted(got[i])] == want


@pytest.mark.parametrize("within_words", [True, False])
def test_grams_are_counted_and_weighed_where_the_text_is(spark, within_words):
    rows = [(0, "Été d'été  été\t a"), (1, None), (2, ""), (3, "a b\u00a0ab " * 40), (4, "x" * 50 + " \n\n x"), (None, "été ab"), (4, "ab ab")]
    df = spark.createDataFrame(rows, "id long, text string")
    low = F.lower(F.coalesce("text", F.lit("")))
    tokens = T.word_char_ngrams(low, 2, 4) if within_words else T.char_ngrams(low, 2, 4)
    listed = lambda d: sorted((repr(r["id"]), sorted((c["term"], c["n"]) for c in r["counts"])) for r in d.collect())
    assert listed(terms.gram_counts(df, ["id"], low, 2, 4, within_words)) == listed(terms.run_lengths(df, ["id"], tokens))
    docs = df.filter("id is not null").dropDuplicates(["id"])
    cut = terms.char_tfidf(docs, "id", "text", 2, 4, within_words, max_features=10_000, strip_accents=False)
    whole = terms.char_tfidf(docs, "id", "text", 2, 4, within_words, strip_accents=False)
    weights = lambda d: {(r["id"], r["term"]): pytest.approx(r["tfidf"]) for r in d.collect()}
    assert weights(cut) == weights(whole)
    assert "Window" not in cut._jdf.queryExecution().executedPlan().toString()  # no document is gathered again
    twice = df.filter("text <> 'ab ab'").unionByName(df)  # rows of one id have one length, also without an id
    sums = terms.char_tfidf(twice, "id", "text", 2, 4, within_words, max_features=10_000, strip_accents=False).groupBy("id").agg(F.sum(F.col("tfidf") ** 2).alias("s"))
    assert {r["id"]: round(r["s"], 9) for r in sums.collect()}.items() >= {0: 1.0, 3: 1.0, 4: 1.0, None: 1.0}.items()


def kept_rows(monkeypatch, *modules):
    """The rows of every table of vectors that these modules write between steps."""
    seen = []

    def count(df):
        out = session.materialise(df)
        if "x" in df.columns:
            seen.append(out.count())
        return out

    for m in modules:
        monkeypatch.setattr(m, "materialise", count)
    return seen


def test_no_table_has_a_row_for_each_query_and_leaf(spark, monkeypatch):
    """In many dimensions a query meets most leaves: that must not be written down."""
    x = np.random.default_rng(4).normal(0, 1, (400, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(4)
    seen = kept_rows(monkeypatch, neighbors)
    near = neighbors.nearest_rows(df, df, "id", "x", 2, block_rows=8).filter("rank = 2").collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) + np.diag([np.inf] * 400)
    assert {r["id"]: r["neighbour"] for r in near} == dict(enumerate(d.argmin(1).tolist()))
    assert seen and max(seen) <= 2 * 400


def test_dbscan_writes_no_row_for_each_point_and_leaf(spark, monkeypatch):
    x = np.random.default_rng(5).normal(0, 1, (400, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(4)
    seen = kept_rows(monkeypatch, neighbors, clusters)
    found = {r["id"]: r["cluster"] for r in clusters._dbscan_cells(df, 2.2, 6, block_rows=8).collect()}
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= 2.2
    core = near.sum(1) >= 6
    comp = np.where(core, np.arange(400), 10**6)
    while (new := np.where(core, np.where(near & core[None, :], comp[None, :], 10**6).min(1), 10**6)).tolist() != comp.tolist():
        comp = new
    least = np.where(near & core[None, :], comp[None, :], 10**6).min(1)
    numbers = {c: i for i, c in enumerate(sorted(set(least) - {10**6}))}
    assert found == {i: numbers.get(c, -1) for i, c in enumerate(least)}
    assert seen and max(seen) <= 2 * 400


def test_a_hot_cell_is_many_keys(spark, monkeypatch):
    """Nine of ten points lie close together: no comparison takes more than two blocks of rows."""
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 1e-3, (900, 3)), rng.normal(0, 5, (100, 3))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(4)
    points = df.select(F.col("id").alias("key"), "x", F.lit(1).cast("bigint").alias("n"))
    placed, leaves = neighbors.index_points(points, block_rows=32)
    sizes = [r["count"] for r in placed.groupBy("leaf", "block").count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 64 and len(leaves.pivots) > 20
    got = {}
    for r in neighbors.nearest_rows(df, df, "id", "x", 4, block_rows=32).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    for i in range(0, 1000, 37):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        assert [j for _, j in sorted(got[i])] == sorted(range(1000), key=lambda j: (d[j], j))[:4]


def brute_dbscan(x, eps, m):
    n = len(x)
    near = [[j for j in range(n) if ((x[i] - x[j]) ** 2).sum() <= eps * eps] for i in range(n)]
    core = [len(v) >= m for v in near]
    label, k = [-1] * n, 0
    for i in range(n):
        if not core[i] or label[i] >= 0:
            continue
        stack = [i]
        label[i] = k
        while stack:
            j = stack.pop()
            if core[j]:
                for q in near[j]:
                    if label[q] < 0:
                        label[q] = k
                        stack.append(q)
        k += 1
    return label


@pytest.mark.parametrize("dims,eps,m", [(1, 0.05, 4), (2, 0.25, 5), (3, 0.5, 4)])
def test_dbscan_equals_brute_force(spark, dims, eps, m):
    rng = np.random.default_rng(dims)
    x = np.vstack([rng.normal(0, 0.3, (120, dims)), rng.normal(2, 0.3, (80, dims)), rng.uniform(-3, 5, (40, dims))])
    x = np.vstack([x, np.repeat(x[:1], 60, axis=0)])
    cols = [f"c{i}" for i in range(dims)]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, " + ", ".join(f"{c} double" for c in cols))
    got = {r["id"]: r["cluster"] for r in clusters.dbscan(df, "id", cols, eps, m).collect()}
    assert [got[i] for i in range(len(x))] == brute_dbscan(x, eps, m)


@pytest.mark.parametrize("dims,eps,m,seed", [(5, 0.9, 4, 1), (64, 6.0, 5, 2), (6, 3.0, 6, 3)])
def test_dbscan_in_many_dimensions_equals_brute_force(spark, dims, eps, m, seed):
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(0, 0.5, (90, dims)), rng.normal(1.5, 0.5, (70, dims)), rng.uniform(-3, 5, (40, dims)), rng.normal(4, 1e-4, (60, dims))])
    x = np.vstack([x, np.repeat(x[:1], 60, axis=0)])
    line = np.zeros((30, dims))
    line[:, 0] = -8 - 0.9 * eps * np.arange(30)  # a chain of points
    x = np.vstack([x, line, line + 0.1 * eps / dims, line - 0.1 * eps / dims])
    order = rng.permutation(len(x))
    df = spark.createDataFrame([(f"{i:05d}", x[j].tolist()) for i, j in enumerate(order)], "id string, v array<double>").repartition(4)
    want = brute_dbscan(x[order], eps, m)
    rows, _ = neighbors.numbered(df.select("id", F.col("v").alias("x")), "id")
    rows = rows.select(F.col("key").alias("id"), "x")
    found = {r["id"]: r["cluster"] for r in clusters._dbscan_cells(rows, eps, m, block_rows=16).collect()}
    assert [found[i] for i in range(len(x))] == want and len(set(want)) > 3
    named = {r["id"]: r["cluster"] for r in clusters.dbscan(df, "id", "v", eps, m).collect()}
    assert [named[f"{i:05d}"] for i in range(len(x))] == want


def test_components_of_a_long_path(spark):
    n = 60
    nodes = spark.createDataFrame([(i,) for i in range(n + 2)], "node long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)] + [(n, n + 1)], "a long, b long")
    got = {r["node"]: r["comp"] for r in clusters.connected_components(nodes, edges).collect()}
    assert all(got[i] == 0 for i in range(n)) and got[n] == got[n + 1] == n


def test_smote_rows_lie_between_their_parents(spark, root):
    d = spark.read.parquet(f"{root}/embeddings.parquet").withColumn("y", (F.col("label") == 3).cast("int"))
    out = resample.smote(d, "vec_id", "embedding", "y")
    n = d.filter("y = 1").count()
    assert out.count() == d.count() - 2 * n
    points = {r["vec_id"]: r["embedding"] for r in d.filter("y = 1").collect()}
    for r in out.collect():
        a, b = points[r["parent"]], points[r["neighbour"]]
        assert r["parent"] != r["neighbour"]
        assert all(min(u, v) - 1e-6 <= x <= max(u, v) + 1e-6 for u, v, x in zip(a, b, r["embedding"]))


def test_grid_turns(spark):
    df = spark.createDataFrame([(1, [1, 2, 3, 4, 5, 6])], "id int, g array<int>")  # two rows of three
    got = {r["kind"]: r["grid"] for r in resample.augment_grid(df, "g", 3, 2).collect()}
    grid = np.array([[1, 2, 3], [4, 5, 6]])
    assert got["flip_h"] == grid[:, ::-1].ravel().tolist() and got["flip_v"] == grid[::-1].ravel().tolist()
    for i, k in enumerate(("original", "rot90", "rot180", "rot270")):
        assert got[k] == np.rot90(grid, i).ravel().tolist()


def test_bootstrap_mean_is_one(spark):
    df = spark.range(4000).withColumnRenamed("id", "k")
    assert 3700 < resample.bootstrap(df, "k", 1, 3).count() < 4300


def test_votes(spark):
    df = spark.createDataFrame([(0, 1, 1), (2, 1, 0)], "a int, b int, c int")
    assert [r[0] for r in df.select(models.vote_hard(df, ["a", "b", "c"])).collect()] == [1, 0]


def test_models_separate_what_is_separable(blobs):
    _, df = blobs
    d = df.filter("c < 2").select("id", "x", encode.vector("x").alias("features"), F.col("c").cast("double").alias("label"))
    fits = [
        models.fit_logistic(d), models.fit_linear_svm(d), models.fit_tree(d), models.fit_forest(d, 5), models.fit_gbt(d, 3),
        models.fit_gaussian_nb(d), models.fit_linear(d, "log"), models.fit_bagged_trees(d, 3),
    ]
    for m in fits:
        s = models.score(m, d, "id").join(d.select("id", "label"), "id")
        assert evaluate.roc_auc(s, "p", "label").first()["auc"] == 1.0
    ada = models.predict_adaboost(models.fit_adaboost(d, 3, "id"), d, "id").join(d.select("id", "label"), "id")
    assert ada.filter("prediction <> label").count() == 0


def test_elbow_falls(blobs):
    _, df = blobs
    d = df.select(encode.vector("x").alias("features"))
    costs = [r["cost"] for r in clusters.elbow(d, [1, 2, 3]).orderBy("k").collect()]
    assert costs[0] > costs[1] > costs[2]


def test_pca_components_are_uncorrelated(blobs):
    _, df = blobs
    out, ratios = encode.pca(df.select("id", encode.vector("x").alias("features")), 2)
    r = out.select(F.corr(F.col("pcs")[0], F.col("pcs")[1])).first()[0]
    assert abs(r) < 1e-6 and ratios[0] > 0.9


@pytest.mark.parametrize("limit", [4, 50])
def test_dbscan_splits_undecided_boxes(spark, monkeypatch, limit):
    monkeypatch.setattr(clusters, "PAIR_LIMIT", limit)
    monkeypatch.setattr(clusters, "FIRST_SPLIT", 1)
    rng = np.random.default_rng(11)
    x = np.vstack([rng.uniform(0, 1, (250, 2)), rng.uniform(0, 1, (100, 2)) + [1.12, 0]])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double")
    got = {r["id"]: r["cluster"] for r in clusters.dbscan(df, "id", ["a", "b"], 0.11, 4).collect()}
    assert [got[i] for i in range(len(x))] == brute_dbscan(x, 0.11, 4)


def test_many_clusters_give_the_same_silhouettes_and_centres(blobs, monkeypatch):
    _, df = blobs
    few = {r["id"]: r["silhouette"] for r in evaluate.silhouette_rows(df, "id", "c", "x").collect()}
    centres = evaluate.cluster_sums(df, "c", "x").select("cluster", F.transform("s", lambda v: v / F.col("n")).alias("centre"))
    near = {r["id"]: (r["cluster"], round(r["distance"], 9)) for r in clusters.assign_nearest(df, centres, "id", "x").collect()}
    worst = evaluate.davies_bouldin(df, "c", "x").first()[0]
    monkeypatch.setattr(evaluate, "MAX_CLUSTERS", 1)
    monkeypatch.setattr(clusters, "MAX_CENTRES", 1)
    assert evaluate.davies_bouldin(df, "c", "x").first()[0] == pytest.approx(worst)
    many = {r["id"]: r["silhouette"] for r in evaluate.silhouette_rows(df, "id", "c", "x").collect()}
    assert many == pytest.approx(few, abs=1e-9) and len(many) == 41
    assert {r["id"]: (r["cluster"], round(r["distance"], 9)) for r in clusters.assign_nearest(df, centres, "id", "x").collect()} == near


def test_no_plan_holds_two_blocks(spark):
    """300 centres of 20 numbers in blocks bounded by rows and by bytes, against numpy."""
    from weftwork.functions import frame

    rng = np.random.default_rng(4)
    x, m = rng.normal(0, 1, (50, 20)), rng.normal(0, 1, (300, 20))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, x array<double>")
    centres = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "cluster int, centre array<double>")
    plans = []

    def step(block, first):
        plans.append(first)
        gaps = F.transform(block, lambda c: F.aggregate(F.zip_with("x", c["centre"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
        return {"d": F.array_min(gaps) if first else F.least("d", F.array_min(gaps)), "met": (F.lit(0) if first else F.col("met")) + F.size(block)}

    out = frame.over_blocks(rows, centres, "cluster", step, 120)
    assert plans == [True, False, False]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("collect_list") <= 2  # the last block alone
    found = {r["id"]: (r["d"], r["met"]) for r in out.collect()}
    want = ((x[:, None] - m[None]) ** 2).sum(2).min(1)
    assert all(abs(found[i][0] - want[i]) < 1e-9 and found[i][1] == 300 for i in range(50))


def fold_counts(spark):
    rows = [(i, i // 2 % 2, float(i % 2), [("a", 2), ("b" if i % 2 else "c", 2), (f"fold{i // 2 % 2}", 1)]) for i in range(40)]
    return spark.createDataFrame(rows, "id long, fold int, label double, counts array<struct<term:string,n:bigint>>")


@pytest.mark.parametrize("kind", ["logistic", "sgd"])
def test_text_models_know_their_own_folds_only(spark, kind):
    data = fold_counts(spark)
    fits = {"text": models.fit_text_logistic if kind == "logistic" else models.text_sgd(max_iter=10)}
    fitted = models.fit_folds(data, "fold", fits)
    for (_, fold), model in fitted.items():
        assert f"fold{1 - fold}" in model.stages[0].terms and f"fold{fold}" not in model.stages[0].terms
    scores = models.held_out_scores(data, "fold", "id", fitted).collect()
    assert len(scores) == 40 and all((r["p"] > 0.5) == (r["label"] == 1) for r in scores)


def test_unknown_metrics_and_penalties_are_refused(spark):
    with pytest.raises(ValueError):
        models._evaluator("f2")
    with pytest.raises(ValueError):
        models.fit_linear(None, "hinge", penalty="l3")
    with pytest.raises(ValueError):
        fit_sgd_grid(None, [{"loss": "squared"}])


def test_vectorizer_equals_the_long_table(spark, root, tmp_path):
    docs = spark.read.parquet(f"{root}/documents.parquet").limit(60)
    long = {(r["doc_id"], r["term"]): r["tfidf"] for r in terms.char_tfidf(docs, "doc_id", "text", max_features=700).collect()}
    from weftwork.functions import text as T

    grams = T.word_char_ngrams(T.strip_accents(F.lower(F.coalesce("text", F.lit("")))), 3, 5)
    counts = terms.run_lengths(docs, ["doc_id"], grams)
    model = TermVectorizer(maxFeatures=700).fit(counts)
    PipelineModel([model]).write().overwrite().save(f"file://{tmp_path}/model")
    again = PipelineModel.load(f"file://{tmp_path}/model")
    assert again.stages[0].terms == model.terms and again.stages[0].extractParamMap().values()
    found = {}
    for r in again.transform(counts.unionByName(spark.createDataFrame([(-1, None), (-2, [("zzzzz", 3)])], counts.schema))).collect():
        assert len(r["tfidf"]) == 700
        found |= {(r["doc_id"], model.terms[i]): v for i, v in zip(r["tfidf"].indices, r["tfidf"].values)}
    assert found.keys() == long.keys() and all(abs(found[k] - v) < 1e-9 for k, v in long.items())


def objective(x, y, w, b, loss, alpha, ratio):
    z = y * (x @ w + b)
    cost = np.maximum(0, 1 - z) if loss == "hinge" else np.logaddexp(0, -z)
    return cost.mean() + alpha * (ratio * np.abs(w).sum() + (1 - ratio) / 2 * (w**2).sum())


def test_sgd_agrees_with_the_convex_optimum(spark):
    """No point near the result is better by more than the tolerance, and subgradient descent with
    many more steps on one machine does no better either."""
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (1200, 5))
    y = np.where(x @ np.array([2.0, -1.0, 0.5, 0.0, 0.0]) + 0.3 + rng.normal(0, 1, 1200) > 0, 1.0, -1.0)
    vectors = [Vectors.dense(v) if i % 2 else Vectors.sparse(5, range(5), v) for i, v in enumerate(x)]
    df = spark.createDataFrame([(v, float(t > 0)) for v, t in zip(vectors, y)], ["features", "label"]).repartition(3)
    grid = [{"loss": loss, "penalty": p, "alpha": 0.02, "eta0": 0.5} for loss in ("log", "hinge") for p in ("l2", "l1", "elasticnet")]
    for setting, model in zip(grid, fit_sgd_grid(df, grid, max_iter=60, tol=1e-5)):
        ratio = {"l2": 0.0, "l1": 1.0, "elasticnet": 0.15}[setting["penalty"]]
        args = (setting["loss"], 0.02, ratio)
        best = np.inf
        w, b = np.zeros(5), 0.0
        for step in range(4000):  # plain full-batch subgradient descent
            _, slope = loss_and_slope(setting["loss"], x @ w + b, y)
            rate = 1.0 / (1 + step) ** 0.6
            w -= rate * (x.T @ slope / len(y) + 0.02 * (ratio * np.sign(w) + (1 - ratio) * w))
            b -= rate * slope.mean()
            best = min(best, objective(x, y, w, b, *args))
        mine = objective(x, y, model.coefficients, model.intercept, *args)
        assert mine < best + 2e-3, (setting, mine, best)
        if setting["penalty"] == "l1":
            assert np.abs(model.coefficients[3:]).max() < 0.05


def test_sgd_weights_and_saved_model(spark, tmp_path):
    df = spark.createDataFrame([(Vectors.dense(float(v)), float(v > 0), 1.0) for v in (-2, -1, 1, 2)] + [(Vectors.dense(5.0), 0.0, 0.0)], ["features", "label", "weight"])
    model = SGDLinear(weightCol="weight", alpha=1e-3, eta0=0.5, maxIter=20).fit(df)
    model.write().overwrite().save(f"file://{tmp_path}/sgd")
    scored = SGDLinearModel.load(f"file://{tmp_path}/sgd").transform(df).collect()
    assert [r["prediction"] for r in scored] == [0.0, 0.0, 1.0, 1.0, 1.0]  # the row of weight 0 taught nothing
    assert all(abs(r["probability"][0] + r["probability"][1] - 1) < 1e-12 for r in scored)


def test_nan_breaks_a_rule(spark):
    from weftwork.operators import clean

    df = spark.createDataFrame([(1, 1.0, 5.0), (2, float("nan"), 1.0), (3, None, 2.0), (4, 2.0, float("nan"))], "id int, v double, w double")
    kept, report = clean.apply_rules(df, {"v": F.col("v") >= -100})
    assert [r["id"] for r in kept.orderBy("id").collect()] == [1, 4] and kept.columns == df.columns
    assert str(kept.filter("id = 4").first()["w"]) == "nan"
    assert {r["rule"]: r["n"] for r in report.collect()}["v"] == 2


def test_group_column_in_table_order(spark):
    from weftwork.operators import profile

    df = spark.createDataFrame([(i, i % 2, i % 3) for i in range(9)], "doc_id int, lang int, source int")
    assert profile.detect_group_column(df, ["doc", "source", "lang"]) == "lang"
