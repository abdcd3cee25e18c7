"""Kernel machines, Ward's hierarchy and sparse indicators against definitions."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from weftwork.operators import encode, hierarchy, kernels, models


@pytest.mark.parametrize("kernel,shape", [("rbf", {"gamma": 0.1}), ("poly", {"gamma": 0.2, "degree": 3, "coef0": 1.0})])
def test_nystroem_approximates_the_kernel(spark, kernel, shape):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (200, 6))
    df = spark.createDataFrame([(i, Vectors.dense(v) if i % 2 else Vectors.sparse(6, range(6), v)) for i, v in enumerate(x)], ["id", "features"]).repartition(3)
    whole = kernels.kernel_matrix(x, x, kernel, **shape)
    errors = []
    for n in (20, 80, 200):
        marks = kernels.pick_landmarks(df, "id", n=n)
        rows = kernels.nystroem_features(df, marks, kernel, **shape).orderBy("id").select(vector_to_array("kernel")).collect()
        z = np.array([r[0] for r in rows])
        errors.append(np.abs(z @ z.T - whole).mean() / np.abs(whole).mean())
    assert errors[0] > errors[1] > errors[2] and errors[1] < 0.1 and errors[2] < 1e-6  # all rows as landmarks: exact
    with pytest.raises(ValueError):
        kernels.kernel_matrix(x, x, "cosine", 1.0)


@pytest.mark.parametrize("kernel", ["rbf", "poly"])
def test_kernel_svm_separates_rings(spark, kernel):
    rng = np.random.default_rng(1)
    angle, radius = rng.uniform(0, 6.3, 240), np.where(np.arange(240) % 2, 1.0, 3.0)
    x = np.c_[radius * np.cos(angle), radius * np.sin(angle), rng.normal(0, 0.1, (240, 3))]
    df = spark.createDataFrame([(i, Vectors.dense(v), float(i % 2)) for i, v in enumerate(x)], ["id", "features", "label"])
    model, prepare = kernels.fit_kernel_svm(df, "id", kernel, degree=2, coef0=1.0, landmarks=60)
    scored = models.score(model, prepare(df), "id", keep=["label"]).collect()
    assert np.mean([r["prediction"] == r["label"] for r in scored]) > 0.97
    assert prepare(df.limit(0)).count() == 0


def brute_ward(x):
    """Merges by looking at all pairs each time."""
    groups, out = {i: [i] for i in range(len(x))}, []
    for step in range(len(x) - 1):
        best = None
        names = sorted(groups)
        for p, a in enumerate(names):
            for b in names[p + 1 :]:
                u, v = x[groups[a]], x[groups[b]]
                gap = 2.0 * len(u) * len(v) / (len(u) + len(v)) * ((u.mean(0) - v.mean(0)) ** 2).sum()
                if best is None or gap < best[0]:
                    best = (gap, a, b)
        gap, a, b = best
        groups[len(x) + step] = groups.pop(a) + groups.pop(b)
        out.append((a, b, np.sqrt(gap), len(groups[len(x) + step])))
    return out, groups


def test_ward_equals_brute_force_with_ids_of_text(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(c, 0.4, (14, 3)) for c in (0, 2, 5)])
    df = spark.createDataFrame([(f"r{i:03d}", v.tolist()) for i, v in enumerate(x)], "id string, x array<double>").repartition(4)
    tree = hierarchy.ward(df, "id", "x")
    want, _ = brute_ward(x)
    got = [tuple(r)[1:] for r in tree.dendrogram().orderBy("step").collect()]
    assert [(a, b, n) for a, b, _, n in got] == [(a, b, n) for a, b, _, n in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want])
    for k in (1, 3, 42):
        label = [r["cluster"] for r in tree.cut(k).orderBy("id").collect()]
        assert len(set(label)) == k and [label.index(c) for c in range(k)] == sorted(label.index(c) for c in range(k))
    assert [r["cluster"] for r in tree.cut(3).orderBy("id").collect()] == [0] * 14 + [1] * 14 + [2] * 14


def test_ward_with_copies_and_over_micro_clusters(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.3, (100, 2)) for c in (0, 4, 9)])
    x = np.vstack([x, np.repeat(x[:1], 50, axis=0)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    exact, coarse = hierarchy.ward(df, "id", "x"), hierarchy.ward(df, "id", "x", micro=30)
    assert exact.micro == 300 and coarse.micro < 200 and coarse.merges[-1][3] == exact.merges[-1][3] == 350
    want = [0] * 100 + [1] * 100 + [2] * 100 + [0] * 50
    for tree in (exact, coarse):
        assert [r["cluster"] for r in tree.cut(3).orderBy("id").collect()] == want
    assert hierarchy.ward(df.limit(0), "id", "x").cut(3).count() == 0
    assert hierarchy.ward(df.limit(1), "id", "x").cut(3).count() == 1


def test_indicators_of_a_hundred_thousand_values(spark):
    df = spark.range(100_000).select("id", F.format_string("v%06d", F.col("id")).alias("v")).repartition(4)
    df = df.unionByName(spark.createDataFrame([(-1, None)], "id long, v string"))
    v = F.unwrap_udt("hot")
    out = encode.one_hot_vector(df, "v", "hot").select("id", v["size"].alias("size"), v["indices"].alias("i"), v["values"].alias("x"))
    bad = out.filter("id >= 0 and (size <> 100000 or i[0] <> id or size(i) <> 1 or x[0] <> 1.0)")
    assert out.count() == 100_001 and bad.count() == 0
    assert out.filter("id = -1").first()["i"] == []
