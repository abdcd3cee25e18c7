"""Models as Spark ML jobs. Fitting functions take a frame with ``features`` (vector) and
``label`` and return a fitted model; scoring keeps the row id."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, Evaluator, MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import Column, DataFrame, Window, functions as F

from weftwork.functions.frame import concurrently, one_row, over_blocks
from weftwork.operators import evaluate
from weftwork.operators.neighbors import nearest_rows
from weftwork.operators.sgd import fit_sgd_grid, margins
from weftwork.operators.vectorize import TermVectorizer, TermVectorizerModel
from weftwork.session import materialise, write_once

MAX_CLASSES = 10_000  # in one block


def _weight(df: DataFrame, weight: str | None) -> dict:
    return {"weightCol": weight} if weight else {}


# ---- single models -----------------------------------------------------------------------


def fit_logistic(df: DataFrame, C: float = 1.0, l1_ratio: float = 0.0, weight: str | None = None, max_iter: int = 100):
    """Binary or multinomial; penalty strength 1 / (C n) as the loss is a mean here."""
    est = LogisticRegression(regParam=1.0 / (C * max(df.count(), 1)), elasticNetParam=l1_ratio, maxIter=max_iter, **_weight(df, weight))
    return est.fit(df)


def fit_linear_svm(df: DataFrame, C: float = 1.0, classes: int = 2, weight: str | None = None, max_iter: int = 100):
    svm = LinearSVC(regParam=1.0 / (C * max(df.count(), 1)), maxIter=max_iter, **_weight(df, weight))
    return (svm if classes <= 2 else OneVsRest(classifier=svm)).fit(df)


def fourier_features(df: DataFrame, dims: int, gamma: float, n_features: int, seed: int, features: str = "features", name: str = "fourier") -> DataFrame:
    """Random Fourier features: inner products approximate exp(-gamma |x - y|^2)."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, np.sqrt(2.0 * gamma), (dims, n_features))
    b = rng.uniform(0.0, 2 * np.pi, n_features)
    scale = np.sqrt(2.0 / n_features)

    @F.pandas_udf("array<double>")
    def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            x = np.stack(s.to_numpy()) if len(s) else np.empty((0, dims))
            yield pd.Series(list(scale * np.cos(x @ w + b)))

    return df.withColumn(name, array_to_vector(project(vector_to_array(features))))


def fit_rbf_svm(df: DataFrame, dims: int, gamma: float, n_features: int = 128, C: float = 1.0, seed: int = 42, max_iter: int = 100):
    """(model, function adding the model's input column to a frame)."""
    prepare = lambda d: fourier_features(d, dims, gamma, n_features, seed)
    svm = LinearSVC(featuresCol="fourier", regParam=1.0 / (C * max(df.count(), 1)), maxIter=max_iter)
    return svm.fit(prepare(df)), prepare


def fit_linear(df: DataFrame, loss: str = "hinge", alpha: float = 1e-4, penalty: str = "l2", max_iter: int = 100):
    """Linear model with hinge or log loss and l2, l1 or elasticnet penalty (half of each); ``alpha``
    is the penalty per mean loss. Hinge loss with a share of l1 is fitted by gradient descent."""
    mixes = {"l2": 0.0, "l1": 1.0, "elasticnet": 0.5}
    if loss not in ("hinge", "log") or penalty not in mixes:
        raise ValueError(f"no {loss} loss with {penalty} penalty")
    if loss == "log":
        return LogisticRegression(regParam=alpha, elasticNetParam=mixes[penalty], maxIter=max_iter).fit(df)
    if penalty == "l2":
        return LinearSVC(regParam=alpha, maxIter=max_iter).fit(df)
    setting = {"loss": loss, "penalty": penalty, "alpha": alpha, "l1_ratio": mixes[penalty]}
    return fit_sgd_grid(write_once(df.select("features", "label")), [setting], max_iter=max_iter)[0]


def fit_tree(df: DataFrame, max_depth: int = 5, min_leaf: int = 1, seed: int = 42):
    return DecisionTreeClassifier(maxDepth=max_depth, minInstancesPerNode=min_leaf, seed=seed).fit(df)


def fit_bagged_trees(df: DataFrame, n: int = 10, max_depth: int = 5, seed: int = 42):
    return RandomForestClassifier(numTrees=n, maxDepth=max_depth, featureSubsetStrategy="all", seed=seed).fit(df)


def fit_forest(df: DataFrame, n: int = 20, max_depth: int = 5, seed: int = 42):
    return RandomForestClassifier(numTrees=n, maxDepth=max_depth, seed=seed).fit(df)


def fit_gbt(df: DataFrame, n: int = 10, max_depth: int = 3, step: float = 0.1, valid_col: str | None = None, seed: int = 42):
    """Boosted trees; rows with ``valid_col`` true decide when to stop."""
    est = GBTClassifier(maxIter=n, maxDepth=max_depth, stepSize=step, seed=seed)
    return (est.setValidationIndicatorCol(valid_col) if valid_col else est).fit(df)


def fit_gaussian_nb(df: DataFrame):
    return NaiveBayes(modelType="gaussian").fit(df)


def fit_mlp(df: DataFrame, layers: Sequence[int], seed: int = 42, max_iter: int = 50):
    """``layers``: sizes from the input to the number of classes."""
    return MultilayerPerceptronClassifier(layers=list(layers), seed=seed, maxIter=max_iter).fit(df)


def balanced(df: DataFrame, label: str = "label", name: str = "weight") -> DataFrame:
    """Adds weights by which both classes of a 0/1 label count alike."""
    share = one_row(df.agg(F.avg(F.col(label).cast("double")).alias("p")))["p"]
    return df.withColumn(name, F.lit(0.5) / F.greatest(F.when(F.col(label) == 1, share).otherwise(1 - share), F.lit(1e-12)))


# ---- models of texts ---------------------------------------------------------------------


def _fitted_vectors(train: DataFrame, counts: str, vocabulary: int, min_df: int, grams: Sequence[int]) -> tuple[TermVectorizerModel, DataFrame]:
    """(fitted vectoriser, label, weight and ``_tfidf`` of the training rows, with balanced classes)."""
    train = balanced(train)
    vectors = TermVectorizer(inputCol=counts, outputCol="_tfidf", maxFeatures=vocabulary, minDF=min_df, grams=list(grams)).fit(train)
    return vectors, vectors.written(train.select(counts, "label", "weight"), write_once)


def fit_text_logistic(train: DataFrame, counts: str = "counts", vocabulary: int = 50_000, min_df: int = 2, C: float = 1.0, max_iter: int = 50, grams: Sequence[int] = ()) -> PipelineModel:
    """TF-IDF vectors of the term counts of each row, or of the character n-grams of a text column (sizes
    from and to ``grams``), then a logistic model with balanced classes. Terms and idf are fitted with the
    rest, so a fold's model knows its training rows only."""
    vectors, data = _fitted_vectors(train, counts, vocabulary, min_df, grams)
    logistic = LogisticRegression(featuresCol="_tfidf", weightCol="weight", regParam=1.0 / (C * max(data.count(), 1)), maxIter=max_iter)
    return PipelineModel([vectors, logistic.fit(data)])


#: The settings the text model is chosen from.
SGD_GRID = [{"alpha": 1e-4, "eta0": 0.1}, {"alpha": 3e-4, "eta0": 0.05}, {"alpha": 1e-5, "eta0": 0.2}]


def by_held_out(fit: Callable[[DataFrame, DataFrame], object]) -> Callable:
    """Marks a fit that chooses among settings by the rows it does not train on."""
    fit.by_held_out = True
    return fit


def text_sgd(counts: str = "counts", grid: Sequence[Mapping] = SGD_GRID, vocabulary: int = 50_000, min_df: int = 2, max_iter: int = 60, loss: str = "log", seed: int = 42, grams: Sequence[int] = ()) -> Callable:
    """fit(train, held): TF-IDF vectors fitted on the training rows (see ``fit_text_logistic``), a linear
    model for every setting by the same passes of gradient descent, and of these the one with the highest
    AUC on ``held`` (ties: the first). Classes are balanced."""

    def fit(train: DataFrame, held: DataFrame) -> PipelineModel:
        vectors, data = _fitted_vectors(train, counts, vocabulary, min_df, grams)
        found = fit_sgd_grid(data, [{"loss": loss} | dict(g) for g in grid], "_tfidf", weight="weight", max_iter=max_iter, seed=seed)
        unseen = margins(found, vectors.transform(held.select(counts, "label")).drop(counts), "_m")
        scored = write_once(unseen.select("label", F.posexplode("_m").alias("i", "m")))
        auc = {r["i"]: r["auc"] for r in evaluate.roc_auc(scored, "m", "label", ["i"]).collect()}
        best = max(range(len(found)), key=lambda i: (auc.get(i) or 0.0, -i))
        return PipelineModel([vectors, found[best]])

    return by_held_out(fit)


def score(model, df: DataFrame, id_col: str, name: str = "p", keep: Sequence[str] = ()) -> DataFrame:
    """(id, kept columns, p, prediction); p is the second class's probability, or the logistic of the margin."""
    out = model.transform(df)
    if "probability" in out.columns:
        p = vector_to_array("probability")[1]
    else:
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-vector_to_array("rawPrediction")[1]))
    return out.select(id_col, *keep, p.alias(name), F.col("prediction").cast("int").alias("prediction"))


# ---- naive Bayes from group moments ------------------------------------------------------


def gaussian_nb_predict(train: DataFrame, queries: DataFrame, id_col: str, label: str, features: str, smoothing: float = 1e-9) -> DataFrame:
    """(id, predicted): class moments by one aggregation, scored by an expression.

    Variances get ``smoothing`` times the largest variance of any dimension added.
    """
    v = array_to_vector(F.col(features).cast("array<double>"))
    every = train.agg(vector_to_array(Summarizer.variance(v)).alias("v"), F.count(F.lit(1)).alias("n"))
    whole = one_row(every)
    stats = train.groupBy(F.col(label).alias("c")).agg(
        F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.mean(v)).alias("m"), vector_to_array(Summarizer.variance(v)).alias("s")
    )
    eps = F.array_max("_all.v") * ((F.col("_all.n") - 1) / F.col("_all.n")) * smoothing
    stats = stats.withColumn("_all", whole).select(
        "c",
        F.log(F.col("n") / F.col("_all.n")).alias("prior"),
        "m",
        F.transform("s", lambda x: x * (F.col("n") - 1) / F.col("n") + eps).alias("s"),
    )
    rows = queries.select(id_col, F.col(features).cast("array<double>").alias("_x"))

    def log_density(k: Column) -> Column:
        parts = F.zip_with(
            F.zip_with(F.col("_x"), k["m"], lambda x, m: (x - m) * (x - m)), k["s"], lambda d, s: F.log(s * (2 * np.pi)) + d / s
        )
        return k["prior"] - 0.5 * F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)

    def step(block: Column, first: bool) -> dict[str, Column]:
        top = F.array_max(F.transform(block, lambda k: F.struct(log_density(k).alias("l"), (-k["c"]).alias("c"))))
        return {"_best": top if first else F.greatest("_best", top)}

    scored = over_blocks(rows, write_once(stats), "c", step, MAX_CLASSES)
    return scored.select(id_col, (-F.col("_best.c")).cast("int").alias("predicted"))


# ---- k nearest neighbours ----------------------------------------------------------------


def knn_votes(near: DataFrame, train: DataFrame, id_col: str, label: str, settings: Sequence[tuple[int, str]]) -> DataFrame:
    """(id, k, weights, predicted) for every (k, kind of vote) from one search (ties: smallest class).

    With ``distance`` votes count 1/d; rows at distance 0 then decide alone.
    """
    labels = train.select(F.col(id_col).alias("neighbour"), F.col(label).alias("_y"))
    zero = F.min("distance").over(Window.partitionBy(id_col)) == 0  # the rows of one query
    votes = near.withColumn("_z", zero).join(labels, "neighbour")
    close = F.when(F.col("_z"), (F.col("distance") == 0).cast("double")).otherwise(1.0 / F.col("distance"))
    cast = F.array(*[
        F.when(F.col("rank") <= k, F.struct(F.lit(int(k)).alias("k"), F.lit(w).alias("weights"), (close if w == "distance" else F.lit(1.0)).alias("w"))) for k, w in settings
    ])
    votes = votes.select(id_col, "_y", F.explode(cast).alias("_v")).filter("_v is not null")
    tally = votes.groupBy(id_col, "_v.k", "_v.weights", "_y").agg(F.round(F.sum("_v.w"), 9).alias("_s"))
    best = tally.groupBy(id_col, "k", "weights").agg(F.max(F.struct("_s", (-F.col("_y")).alias("y"))).alias("b"))
    return best.select(id_col, "k", "weights", (-F.col("b.y")).cast("int").alias("predicted"))


def knn_predict(train: DataFrame, queries: DataFrame, id_col: str, label: str, features: str, k: int = 5, weights: str = "uniform", p: int = 2,
                exclude_self: bool = False) -> DataFrame:
    """(id, predicted) by vote of the k nearest training rows, see ``knn_votes``.

    ``exclude_self`` leaves a query's own row out, for scoring the training rows themselves.
    """
    near = nearest_rows(queries, train, id_col, features, k, p, exclude_self)
    return knn_votes(near, train, id_col, label, [(k, weights)]).select(id_col, "predicted")


def standardised(train: DataFrame, others: Sequence[DataFrame], features: str) -> list[DataFrame]:
    """``train`` and the others with an array column scaled by the means and population deviations
    of ``train``; constant places become 0."""
    v = array_to_vector(F.col(features).cast("array<double>"))
    row = train.agg(vector_to_array(Summarizer.mean(v)).alias("m"), vector_to_array(Summarizer.variance(v)).alias("s"), F.count(F.lit(1)).alias("n")).first()
    shrink = max(row["n"] - 1, 0) / max(row["n"], 1)
    scale = [(float(m), float(np.sqrt(s * shrink)) or 1.0) for m, s in zip(row["m"], row["s"])]
    place = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(s).alias("s")) for m, s in scale])
    scaled = F.zip_with(F.col(features).cast("array<double>"), place, lambda x, c: (x - c["m"]) / c["s"])
    return [d.withColumn(features, scaled) for d in (train, *others)]


def search_knn(df: DataFrame, id_col: str, label: str, features: str, fold: str, ks: Sequence[int], weights: Sequence[str] = ("uniform",), p: Sequence[int] = (2,), scale: bool = False) -> DataFrame:
    """(k, weights, p, f1, std): F1 of class 1 over the folds for each number of neighbours, kind of vote
    and distance; every fold is predicted from the others, by one search for the largest number.
    ``scale``: features are standardised by the training rows of each fold."""
    data = write_once(df.select(id_col, fold, label, features), by=[fold])
    folds = [r[0] for r in data.select(fold).distinct().orderBy(fold).collect()]
    settings = [(k, w) for k in ks for w in weights]

    def one(task):
        f, dist = task
        train, held = data.filter(F.col(fold) != f), data.filter(F.col(fold) == f)
        if scale:
            train, held = (write_once(d) for d in standardised(train, [held], features))
        near = write_once(nearest_rows(held, train, id_col, features, max(ks), dist))
        found = knn_votes(near, train, id_col, label, settings).join(held.select(id_col, F.col(label).alias("_y")), id_col)
        hit = F.sum(((F.col("_y") == 1) & (F.col("predicted") == 1)).cast("int"))
        named = F.sum((F.col("_y") == 1).cast("int")) + F.sum((F.col("predicted") == 1).cast("int"))
        each = found.groupBy("k", "weights").agg((2.0 * hit / F.greatest(named, F.lit(1))).alias("s"))
        return [(r["k"], r["weights"], dist, r["s"]) for r in each.collect()]  # a row for each setting

    scores = concurrently(df.sparkSession, one, [(f, d) for d in p for f in folds], 2)
    out = df.sparkSession.createDataFrame([r for part in scores for r in part], "k int, weights string, p int, s double")
    return out.groupBy("k", "weights", "p").agg(F.avg("s").alias("f1"), F.stddev_pop("s").alias("std"))


# ---- AdaBoost ----------------------------------------------------------------------------


def fit_adaboost(df: DataFrame, n: int = 10, id_col: str = "vec_id", seed: int = 42, checkpoint_every: int = 3) -> list[tuple[float, object]]:
    """(weight, stump) pairs: stumps fitted on rows reweighted towards earlier errors."""
    rows = materialise(df.select(id_col, "features", "label"))
    total = rows.count()
    data = rows.withColumn("_w", F.lit(1.0 / total))
    ensemble: list[tuple[float, object]] = []
    for i in range(n):
        stump = DecisionTreeClassifier(maxDepth=1, weightCol="_w", seed=seed, predictionCol="_pred", probabilityCol="_p", rawPredictionCol="_r").fit(data)
        scored = stump.transform(data).drop("_p", "_r")
        wrong = (F.col("_pred") != F.col("label")).cast("double")
        sums = scored.agg(F.sum(F.col("_w") * wrong).alias("e"), F.sum("_w").alias("t")).first()
        err = sums["e"] / sums["t"]
        if err >= 0.5:
            break
        alpha = float(np.log((1 - err) / max(err, 1e-10)))
        ensemble.append((alpha, stump))
        if err <= 0:
            break
        data = scored.withColumn("_w", F.col("_w") * F.exp(F.lit(alpha) * wrong)).drop("_pred")
        scale = sums["t"] - sums["e"] + sums["e"] * float(np.exp(alpha))
        data = data.withColumn("_w", F.col("_w") / F.lit(scale))
        if (i + 1) % checkpoint_every == 0:
            data = materialise(data)
    return ensemble


def predict_adaboost(ensemble: Sequence[tuple[float, object]], df: DataFrame, id_col: str) -> DataFrame:
    """(id, p, prediction): weighted share of the stumps voting 1."""
    out, votes = df, F.lit(0.0)
    for i, (alpha, stump) in enumerate(ensemble):
        out = stump.copy().setPredictionCol(f"_s{i}").setProbabilityCol("").setRawPredictionCol("").transform(out)
        votes = votes + F.lit(alpha) * F.col(f"_s{i}")
    p = votes / F.lit(sum(a for a, _ in ensemble) or 1.0)
    return out.select(id_col, p.alias("p"), (p > 0.5).cast("int").alias("prediction"))


# ---- combining models --------------------------------------------------------------------


def vote_hard(df: DataFrame, pred_cols: Sequence[str]) -> Column:
    """Most frequent prediction, the smallest on ties."""
    preds = F.array(*pred_cols)
    count = lambda v: F.size(F.filter(preds, lambda x: x == v))
    best = F.array_max(F.transform(F.array_distinct(preds), lambda v: F.struct(count(v).alias("n"), (-v).alias("v"))))
    return (-best["v"]).cast("int")


def vote_soft(prob_cols: Sequence[str]) -> Column:
    total = F.lit(0.0)
    for c in prob_cols:
        total = total + F.col(c)
    return total / len(prob_cols)


def mean_over_models(preds: DataFrame, id_col: str, p: str) -> DataFrame:
    return preds.groupBy(id_col).agg(F.avg(p).alias(p), F.count(F.lit(1)).alias("models"))


def fit_folds(data: DataFrame, fold: str, fits: Mapping[str, Callable[[DataFrame], object]], parallelism: int = 4) -> dict:
    """{(name, fold): model fitted on the other folds}; several fits run as concurrent Spark jobs. A
    fit marked ``by_held_out`` gets the fold's own rows too."""
    folds = [r[0] for r in data.select(fold).distinct().orderBy(fold).collect()]
    tasks = [(name, f) for name in fits for f in folds]

    def one(task):
        name, f = task
        train, held = data.filter(F.col(fold) != f), data.filter(F.col(fold) == f)
        return fits[name](train, held) if getattr(fits[name], "by_held_out", False) else fits[name](train)

    return dict(zip(tasks, concurrently(data.sparkSession, one, tasks, parallelism)))


def fit_text_folds(data: DataFrame, fold: str, fits: Mapping[str, Callable[[DataFrame], object]]) -> dict:
    """As ``fit_folds``, one fit after the other: a logistic model keeps the vectors of its training rows in the
    executors' memory, and sums as long as its vocabulary in the driver's, so that fits side by side take
    several times as much. One fit of many rows keeps all cores busy."""
    return fit_folds(data, fold, fits, parallelism=1)


def held_out_scores(data: DataFrame, fold: str, id_col: str, fitted: Mapping) -> DataFrame:
    """(id, model, fold, label, p): each fold scored by the models that did not see it. If ``data`` is
    written by fold (``write_once(..., by=[fold])``), a model reads its fold alone."""
    out = None
    for (name, f), model in fitted.items():
        held = data.filter(F.col(fold) == f)
        part = score(model, held, id_col, keep=[fold, "label"])
        part = part.select(id_col, F.lit(name).alias("model"), fold, F.col("label").cast("int").alias("label"), "p")
        out = part if out is None else out.unionByName(part)
    return write_once(out)


def oof_predictions(df: DataFrame, fold: str, id_col: str, fits: Mapping[str, Callable[[DataFrame], object]]) -> DataFrame:
    """Long table (id, model, fold, label, p) of out-of-fold scores.

    The features are computed once and written, since every fold reads them again.
    """
    data = write_once(df.select(id_col, fold, "features", "label"), by=[fold])
    return held_out_scores(data, fold, id_col, fit_folds(data, fold, fits))


class MacroF1(Evaluator):
    """F1 averaged over classes without weights."""

    def _evaluate(self, dataset: DataFrame) -> float:
        return float(evaluate.f1(dataset, "label", "prediction").first()["f1_macro"])

    def isLargerBetter(self) -> bool:
        return True


def _evaluator(metric: str) -> Evaluator:
    """auc, accuracy, f1 of the class 1, or f1_macro."""
    known = {
        "auc": lambda: BinaryClassificationEvaluator(metricName="areaUnderROC"),
        "accuracy": lambda: MulticlassClassificationEvaluator(metricName="accuracy"),
        "f1": lambda: MulticlassClassificationEvaluator(metricName="fMeasureByLabel", metricLabel=1.0, beta=1.0),
        "f1_macro": MacroF1,
    }
    if metric not in known:
        raise ValueError(f"unknown metric {metric}; one of {', '.join(known)}")
    return known[metric]()


def grid_search(df: DataFrame, estimator, grid: Sequence[dict], fold: str, metric: str = "auc", parallelism: int = 4) -> CrossValidatorModel:
    """Cross-validation over the given parameter maps with the folds of column ``fold``."""
    k = df.agg(F.max(fold).alias("m")).first()["m"] + 1
    cv = CrossValidator(
        estimator=estimator, estimatorParamMaps=list(grid), evaluator=_evaluator(metric), numFolds=k, foldCol=fold, parallelism=parallelism
    )
    return cv.fit(df)


def random_search(df: DataFrame, estimator, space: Mapping, n: int, fold: str, metric: str = "auc", seed: int = 42) -> CrossValidatorModel:
    """As grid_search with ``n`` seeded draws; ``space``: param -> (low, high, 'int'|'log'|'lin')."""
    rng = np.random.default_rng(seed)
    grid = []
    for _ in range(n):
        draw = {}
        for param, (lo, hi, kind) in space.items():
            if kind == "int":
                draw[param] = int(rng.integers(lo, hi + 1))
            elif kind == "log":
                draw[param] = float(np.exp(rng.uniform(np.log(lo), np.log(hi))))
            else:
                draw[param] = float(rng.uniform(lo, hi))
        grid.append(draw)
    return grid_search(df, estimator, grid, fold, metric)


def search_table(model: CrossValidatorModel, df: DataFrame) -> DataFrame:
    """(parameters, mean, std) of every tried setting."""
    rows = [
        (", ".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda kv: kv[0].name)), float(a), float(s))
        for m, a, s in zip(model.getEstimatorParamMaps(), model.avgMetrics, model.stdMetrics)
    ]
    return df.sparkSession.createDataFrame(rows, "parameters string, mean double, std double")


def fit_stack(wide: DataFrame, models: Sequence[str], label: str, Cs: Sequence[float], fold: str) -> CrossValidatorModel:
    """Logistic meta-model on the base models' out-of-fold probabilities, C chosen by AUC; rows are
    weighted so that both classes count alike."""
    data = balanced(wide.select(fold, F.col(label).cast("double").alias("label"), array_to_vector(F.array(*models)).alias("features")))
    data = write_once(data)  # every fold and setting reads it again
    n = data.count()
    lr = LogisticRegression(weightCol="weight")
    return grid_search(data, lr, [{lr.regParam: 1.0 / (c * n)} for c in Cs], fold, "auc")


def coefficients(model, names: Sequence[str], df: DataFrame) -> DataFrame:
    """(feature, coefficient), largest first."""
    rows = sorted(zip(names, (float(x) for x in model.coefficients.toArray())), key=lambda r: -abs(r[1]))
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double")


def permutation_importance(model, df: DataFrame, id_col: str, names: Sequence[str], seed: int = 42) -> DataFrame:
    """(feature, drop): loss of AUC when one feature's values are dealt to other rows.

    ``df`` has an array column ``x`` and ``label``. Values are dealt by sorting the rows by two
    different hashes and pairing equal positions, so every value is used exactly once.
    """
    from weftwork.functions.hashing import row_hash
    from weftwork.operators.scan import number_rows

    base = materialise(df.select(id_col, "x", "label"))
    there = number_rows(base.withColumn("_h", row_hash(id_col, seed)), ["_h", id_col], "_i").select(id_col, "x", "label", "_i")
    here = number_rows(base.select(id_col, "x").withColumn("_h", row_hash(id_col, seed + 1)), ["_h", id_col], "_i")
    pairs = materialise(there.join(here.select("_i", F.col("x").alias("_other")), "_i"))
    auc_of = lambda d: evaluate.roc_auc(
        score(model, d.withColumn("features", array_to_vector("x")), id_col, keep=["label"]), "p", "label"
    ).first()["auc"]
    whole = auc_of(base)
    rows = []
    for j, name in enumerate(names):
        mixed = pairs.withColumn("x", F.transform("x", lambda v, i: F.when(i == j, F.col("_other")[j]).otherwise(v)))
        rows.append((name, float(whole - auc_of(mixed))))
    return df.sparkSession.createDataFrame(sorted(rows, key=lambda r: -r[1]), "feature string, drop double")
