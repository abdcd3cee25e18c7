"""Search for boosted trees with early stopping: successive halving over settings that resume.

A setting is tried for a few rounds on every fold; the better part of the settings goes on from there
with more rounds, the trees grown so far being kept. Settings are drawn in waves, the first at random
and the later ones near the best of those before. In each fit the log loss of the held-out fold is
looked at after every round, and a fit that has not improved for ``patience`` rounds grows no more.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

import numpy as np
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, functions as F

from weftwork.functions.frame import concurrently
from weftwork.operators import evaluate
from weftwork.session import write_once

#: Trees after which the margins they give are written with the rows.
WRITE_TREES = 16


def _loss(margin: Column, label: Column) -> Column:
    """Log loss of a margin, in a form that does not overflow."""
    return F.greatest(margin, F.lit(0.0)) - margin * label + F.log1p(F.exp(-F.abs(margin)))


class Boosted:
    """Boosted regression trees on the gradient of the log loss, grown round by round. ``rows`` has
    features and a 0/1 label; rows with ``_held`` set are not learnt from and judge every round."""

    def __init__(self, rows: DataFrame, setting: Mapping, patience: int = 3, seed: int = 42):
        self.rows, self.setting, self.patience, self.seed = rows, dict(setting), patience, seed
        train = rows.filter("not _held").agg(F.avg("label").alias("p"), F.count(F.lit(1)).alias("n")).first()
        share = min(max(train["p"], 1e-6), 1 - 1e-6)
        self.start = float(np.log(share / (1 - share)))
        self.trees, self.losses, self.stopped = [], [], False
        self._base, self._written = rows.withColumn("margin", F.lit(self.start)), 0

    def _grown(self, rows: DataFrame, trees: Sequence) -> DataFrame:
        """``rows`` with the trees' steps added to ``margin``."""
        for tree in trees:
            rows = tree.transform(rows).withColumn("margin", F.col("margin") + F.lit(self.setting["step"]) * F.col("_tree")).drop("_tree")
        return rows

    @property
    def best_round(self) -> int:
        return int(np.argmin(self.losses)) + 1 if self.losses else 0

    def grow(self, rounds: int) -> int:
        """Grow until there are ``rounds`` trees or the held-out loss says stop; the trees grown now."""
        before = len(self.trees)
        while len(self.trees) < rounds and not self.stopped:
            if len(self.trees) - self._written >= WRITE_TREES:
                self._base = write_once(self._grown(self._base, self.trees[self._written :]))
                self._written = len(self.trees)
            now = self._grown(self._base, self.trees[self._written :])
            slope = F.col("label") - F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin")))
            grower = DecisionTreeRegressor(maxDepth=int(self.setting["depth"]), minInstancesPerNode=int(self.setting.get("min_leaf", 1)), labelCol="_slope", predictionCol="_tree", seed=self.seed)
            self.trees.append(grower.fit(now.filter("not _held").withColumn("_slope", slope)))
            judged = self._grown(now, self.trees[-1:]).filter("_held").agg(F.avg(_loss(F.col("margin"), F.col("label"))).alias("l")).first()["l"]
            self.losses.append(float(judged) if judged is not None else float("nan"))
            self.stopped = len(self.losses) - self.best_round >= self.patience
        return len(self.trees) - before

    def score(self, rows: DataFrame, rounds: int | None = None) -> DataFrame:
        """``rows`` with ``p`` by the trees up to the best round."""
        out = self._grown(rows.withColumn("margin", F.lit(self.start)), self.trees[: rounds or self.best_round])
        return out.withColumn("p", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin")))).drop("margin")


class Trial(NamedTuple):
    """A setting with what it reached: rung, rounds grown on all folds, mean and deviation of the AUC over the folds."""

    setting: dict
    rung: int
    rounds: int
    mean: float
    std: float
    best_rounds: int  # the mean over the folds of the round with the least held-out loss


class Halving(NamedTuple):
    best: dict
    trials: list[Trial]  # the last state of every setting
    rounds: int  # trees grown in all

    def table(self, like: DataFrame) -> DataFrame:
        """(parameters, rung, rounds, mean, std, best_rounds), best first."""
        rows = [(", ".join(f"{k}={v:.6g}" for k, v in sorted(t.setting.items())), t.rung, t.rounds, t.mean, t.std, t.best_rounds) for t in self.trials]
        return like.sparkSession.createDataFrame(rows, "parameters string, rung int, rounds int, mean double, std double, best_rounds int")


def draw(space: Mapping, rng: np.random.Generator, near: Sequence[Mapping] = (), width: float = 0.25) -> dict:
    """A setting from ``space``: name -> (low, high, 'int'|'log'|'lin'). With ``near``, each value is
    drawn around that of one of those settings, ``width`` being the deviation as a share of the range."""
    out, model = {}, near[int(rng.integers(len(near)))] if near else None
    for name, (low, high, kind) in space.items():
        into, back = (np.log, np.exp) if kind == "log" else (float, float)
        a, b = into(low), into(high)
        x = rng.uniform(a, b) if model is None else float(np.clip(rng.normal(into(model[name]), width * (b - a)), a, b))
        out[name] = int(round(back(x))) if kind == "int" else float(back(x))
    return out


def successive_halving(
    df: DataFrame, space: Mapping, fold: str, draws: int = 9, waves: int = 2, first: int = 2, factor: int = 3, most: int = 18,
    patience: int = 3, features: str = "features", label: str = "label", seed: int = 42, parallelism: int = 4,
) -> Halving:
    """Search ``space`` (depth, step, optionally min_leaf) with ``draws`` settings in ``waves``: all of them
    grow ``first`` rounds, the best ``1/factor`` of them ``factor`` times as many, and so on up to
    ``most``. The best setting ever seen is kept, by mean AUC over the folds (ties: the earlier one)."""
    rng = np.random.default_rng(seed)
    data = write_once(df.select(F.col(features).alias("features"), F.col(label).cast("double").alias("label"), fold))
    folds = [r[0] for r in data.select(fold).distinct().orderBy(fold).collect()]
    fits: dict[int, list[Boosted]] = {}
    settings: list[dict] = []
    last: dict[int, Trial] = {}

    def run(number: int, rung: int, rounds: int) -> None:
        if number not in fits:
            made = [Boosted(data.withColumn("_held", F.col(fold) == f), settings[number], patience, seed) for f in folds]
            fits[number] = made
        for fit in fits[number]:
            fit.grow(rounds)
        parts = [fit.score(data.filter(F.col(fold) == f)).select(F.lit(i).alias("f"), "p", "label") for i, (f, fit) in enumerate(zip(folds, fits[number]))]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        auc = [r["auc"] for r in evaluate.roc_auc(out, "p", "label", ["f"]).collect() if r["auc"] is not None]
        last[number] = Trial(settings[number], rung, sum(len(f.trees) for f in fits[number]), float(np.mean(auc)) if auc else 0.0, float(np.std(auc)) if auc else 0.0,
                             round(float(np.mean([f.best_round for f in fits[number]]))))

    def ranked(numbers: Sequence[int]) -> list[int]:
        return sorted(numbers, key=lambda n: (-last[n].mean, n))

    for wave in range(waves):
        size = draws * (wave + 1) // waves - draws * wave // waves
        near = [settings[n] for n in ranked(range(len(settings)))[: max(1, len(settings) // factor)]]
        new = range(len(settings), len(settings) + size)
        settings.extend(draw(space, rng, near, 0.25 / max(wave, 1)) for _ in new)
        concurrently(data.sparkSession, lambda n: run(n, 0, first), list(new), parallelism)
    rung, rounds, alive = 0, first, list(range(draws))
    while rounds < most and len(alive) > 1:
        rung, rounds = rung + 1, min(rounds * factor, most)
        alive = ranked(alive)[: max(1, len(alive) // factor)]
        concurrently(data.sparkSession, lambda n: run(n, rung, rounds), alive, parallelism)
    order = ranked(range(draws))
    return Halving(settings[order[0]] | {"rounds": max(last[order[0]].best_rounds, 1)}, [last[n] for n in order], sum(t.rounds for t in last.values()))
