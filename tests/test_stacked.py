"""The stacked flow with a text model, and its report, against plain formulas."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from weftwork.operators import models
from weftwork.plans import stacked


def plain_auc(p, y):
    pos, neg = [a for a, t in zip(p, y) if t == 1], [a for a, t in zip(p, y) if t != 1]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def test_stack_of_numeric_and_text_models_and_its_report(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(120):
        y = i % 2
        words = [("good" if rng.random() < 0.5 + 0.4 * y else "bad", 2), (f"w{rng.integers(6)}", 1)]
        rows.append((i, float(y), Vectors.dense([y + rng.normal(0, 1), rng.normal()]), words))
    train = spark.createDataFrame([r[:3] for r in rows], ["id", "label", "features"]).join(
        spark.createDataFrame([(r[0], r[3]) for r in rows], "id long, counts array<struct<term:string,n:bigint>>"), "id")
    test = train.drop("label")
    fits = {"numeric": lambda d: models.fit_logistic(d, max_iter=10), "text": models.text_sgd(vocabulary=50, max_iter=8)}
    run = stacked.fit_and_score(train, test, fits, k=3, Cs=(0.1, 1.0))
    wide = run.wide.toPandas()
    assert sorted(wide["id"]) == list(range(120)) and run.scores.count() == 120
    report = {(r["section"], r["name"], r["other"]): r["value"] for r in stacked.diagnostics(run, list(fits), (0.1, 1.0)).collect()}
    for name in ("numeric", "text", "stack"):
        each = [plain_auc(g[name], g["label"]) for _, g in wide.groupby("fold")]
        assert report["auc", name, "overall_auc"] == pytest.approx(plain_auc(wide[name], wide["label"]))
        for figure, value in (("fold_mean", np.mean(each)), ("fold_std", np.std(each)), ("min_fold", min(each)), ("max_fold", max(each))):
            assert report["auc", name, figure] == pytest.approx(value)
    assert report["correlation", "numeric", "text"] == pytest.approx(np.corrcoef(wide["numeric"], wide["text"])[0, 1])
    weights = run.meta.bestModel.coefficients.toArray()
    assert [report["coefficient", n, ""] for n in fits] == pytest.approx(list(weights))
    assert report["label", "positive_rate", ""] == 0.5 and report["label", "rows", ""] == 120 and report["meta", "C", ""] in (0.1, 1.0)
    assert report["auc", "text", "overall_auc"] > 0.6
    logit = weights @ wide[list(fits)].to_numpy().T + run.meta.bestModel.intercept
    assert np.allclose(wide["stack"], 1 / (1 + np.exp(-logit)))
    assert run.oof.select(F.countDistinct("model", "id")).first()[0] == 240


def test_margins_of_several_models_take_one_pass(spark):
    """A pass for each model kept a Python worker more with every task."""
    from weftwork.operators.sgd import SGDLinearModel, margins

    rng = np.random.default_rng(3)
    made = [SGDLinearModel(rng.normal(size=4), float(i)) for i in range(3)]
    rows = [(0, Vectors.dense(rng.normal(size=4))), (1, Vectors.sparse(4, [1, 3], [2.0, -1.0])), (2, Vectors.sparse(4, [], []))]
    df = spark.createDataFrame(rows, ["id", "features"])
    out = margins(made, df, "m")
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {r["id"]: r["m"] for r in out.collect()}
    for i, x in rows:
        assert got[i] == pytest.approx([m.coefficients @ x.toArray() + m.intercept for m in made])


def test_scores_of_unseen_rows_are_computed_once(spark, monkeypatch):
    """They are checked and then spread out, which cut every text twice."""
    rows = [(i, float(i % 2), Vectors.dense([i % 2 + 0.1 * (i % 5), 1.0])) for i in range(30)]
    train = spark.createDataFrame(rows, ["id", "label", "features"])
    plans, inner = [], stacked.combine.stack_predictions
    monkeypatch.setattr(stacked.combine, "stack_predictions", lambda preds, *a: plans.append(preds._jdf.queryExecution().optimizedPlan().toString()) or inner(preds, *a))
    stacked.fit_and_score(train, train.drop("label"), {"numeric": lambda d: models.fit_logistic(d, max_iter=5)}, k=3, Cs=(1.0,))
    assert len(plans) == 2 and not [p for p in plans if "UDF" in p or "Aggregate" in p]


def test_text_models_are_fitted_one_after_the_other(spark, root, monkeypatch):
    """Side by side, each keeps its training rows in memory and as many sums in the driver."""
    import threading
    import time

    from queries import catalogue

    lock, active, most = threading.Lock(), [], []

    def fit(train, **_):
        with lock:
            active.append(1)
            most.append(len(active))
        time.sleep(0.5)
        with lock:
            active.pop()

    monkeypatch.setattr(models, "fit_text_logistic", fit)
    monkeypatch.setattr(models, "held_out_scores", lambda data, *_: data.select("doc_id", F.lit(0.5).alias("p")))
    assert catalogue.queries()["k17_text_oof"](spark, root).count() > 0
    assert len(most) == 3 and max(most) == 1
