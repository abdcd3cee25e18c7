"""Successive halving with early stopping."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from weftwork.operators import tuning


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (300, 3))
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(0, 1, 300) > 0).astype(float)  # needs some depth
    return spark.createDataFrame([(i % 2, Vectors.dense(v), float(t)) for i, (v, t) in enumerate(zip(x, y))], ["fold", "features", "label"]).cache()


def test_rounds_resume_and_stop(rows):
    data = rows.withColumn("_held", F.col("fold") == 0)
    once, twice = (tuning.Boosted(data, {"depth": 3, "step": 0.5}, patience=3) for _ in range(2))
    once.grow(4)
    twice.grow(2)
    assert twice.grow(4) == 2  # two more, the first two are kept
    assert once.losses == pytest.approx(twice.losses)
    eager = tuning.Boosted(data, {"depth": 5, "step": 1.0}, patience=2)
    assert eager.grow(30) < 30 and eager.stopped and len(eager.trees) - eager.best_round == 2
    margin = [r["p"] for r in once.score(data, 4).filter("_held").select("p", "label").collect()]
    label = [r["label"] for r in data.filter("_held").collect()]
    loss = -np.mean([np.log(p if t else 1 - p) for p, t in zip(margin, label)])
    assert loss == pytest.approx(once.losses[3])


def test_halving_spends_less_than_the_grid_and_keeps_the_best(rows):
    space = {"depth": (1, 4, "int"), "step": (0.05, 0.8, "log")}
    found = tuning.successive_halving(rows, space, "fold", draws=6, waves=2, first=2, factor=3, most=6, seed=1)
    assert found.rounds < 6 * 6 * 2  # every setting grown to the end on both folds
    assert len(found.trials) == 6 and found.trials[0].mean == max(t.mean for t in found.trials)
    assert {k: found.best[k] for k in space} == found.trials[0].setting and found.best["rounds"] >= 1
    assert found.trials[0].mean > 0.8 and max(t.rung for t in found.trials) == 1
    assert sorted(r["rounds"] for r in found.table(rows).collect()) == sorted(t.rounds for t in found.trials)


def test_later_draws_lie_near_the_best():
    rng = np.random.default_rng(0)
    space = {"step": (0.01, 1.0, "log"), "depth": (1, 9, "int"), "rest": (0.0, 1.0, "lin")}
    best = {"step": 0.1, "depth": 5, "rest": 0.5}
    near = [tuning.draw(space, rng, [best], 0.05) for _ in range(200)]
    wide = [tuning.draw(space, rng) for _ in range(200)]
    spread = lambda d: np.std([np.log(v["step"]) for v in d])
    assert spread(near) < spread(wide) / 3
    assert all(space[k][0] <= v <= space[k][1] for d in near + wide for k, v in d.items())
