"""Classifier and clustering metrics, exact, from small contingency tables or running sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.stat import Summarizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from weftwork.functions.frame import one_row, over_blocks
from weftwork.operators.encode import vector
from weftwork.operators.groups import group_mode
from weftwork.operators.scan import prefix_scan
from weftwork.session import write_once


def _div(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a.cast("double") / b).otherwise(F.lit(0.0))


# ---- classifiers -------------------------------------------------------------------------


def accuracy(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))


def confusion(df: DataFrame, label: str, pred: str, normalize: bool = False) -> DataFrame:
    """Long form (truth, predicted, n), with the share of the truth's rows when normalised."""
    counts = df.groupBy(F.col(label).alias("truth"), F.col(pred).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    if normalize:
        counts = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("truth")))
    return counts


def per_class(df: DataFrame, label: str, pred: str) -> DataFrame:
    """(class, precision, recall, f1, support) for classes seen as truth or prediction."""
    cells = confusion(df, label, pred)
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("truth").alias("class"), F.col("n").alias("truth_n"), F.lit(0).cast("bigint").alias("pred_n"),
                         F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")),
                F.struct(F.col("predicted").alias("class"), F.lit(0).cast("bigint").alias("truth_n"), F.col("n").alias("pred_n"),
                         F.lit(0).cast("bigint").alias("hit")),
            )
        ).alias("s")
    ).select("s.*")
    sums = sides.groupBy("class").agg(F.sum("truth_n").alias("t"), F.sum("pred_n").alias("p"), F.sum("hit").alias("h"))
    return sums.select(
        "class",
        _div(F.col("h"), F.col("p")).alias("precision"),
        _div(F.col("h"), F.col("t")).alias("recall"),
        _div(2 * F.col("h"), F.col("t") + F.col("p")).alias("f1"),
        F.col("t").alias("support"),
    )


def classification_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Per-class rows plus 'macro avg' and 'weighted avg'."""
    classes = per_class(df, label, pred)
    metrics = ["precision", "recall", "f1"]
    macro = classes.agg(*[F.avg(m).alias(m) for m in metrics], F.sum("support").alias("support"))
    weighted = classes.agg(
        *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in metrics], F.sum("support").alias("support")
    )
    cols = ["class", *metrics, "support"]
    return (
        classes.withColumn("class", F.col("class").cast("string"))
        .unionByName(macro.withColumn("class", F.lit("macro avg")).select(*cols))
        .unionByName(weighted.withColumn("class", F.lit("weighted avg")).select(*cols))
    )


def f1(df: DataFrame, label: str, pred: str, positive=1) -> DataFrame:
    """binary, macro and weighted F1 in one row."""
    return per_class(df, label, pred).agg(
        F.coalesce(F.max(F.when(F.col("class") == positive, F.col("f1"))), F.lit(0.0)).alias("f1_binary"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
    )


def roc_auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, ties averaged; null where one class is missing.

    Rows are first reduced to counts per distinct score; the number of negatives below each
    score is a running sum over score ranges.
    """
    by = list(by)
    counts = df.groupBy(*by, F.col(score).alias("_p")).agg(
        F.sum((F.col(label) == 1).cast("bigint")).alias("_pos"), F.sum((F.col(label) != 1).cast("bigint")).alias("_neg")
    )
    run = prefix_scan(counts, ["_p"], {"_below": ("sum", "_neg", False)}, by=by)
    won = F.sum(F.col("_pos").cast("double") * (F.col("_below").cast("double") + F.col("_neg") / 2))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg").cast("double")
    return run.groupBy(*by).agg(F.when(pairs > 0, won / pairs).alias("auc"))


def fold_auc(df: DataFrame, score: str, label: str, fold: str) -> DataFrame:
    """AUC per fold and over all rows ('all')."""
    each = roc_auc(df, score, label, [fold]).select(F.col(fold).cast("string").alias("fold"), "auc")
    return each.unionByName(roc_auc(df, score, label).select(F.lit("all").alias("fold"), "auc"))


def sens_spec(df: DataFrame, label: str, pred: str) -> DataFrame:
    hit = lambda t, p: F.count_if((F.col(label) == t) & (F.col(pred) == p))
    row = df.agg(hit(1, 1).alias("tp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"), hit(0, 1).alias("fp"))
    return row.select(
        _div(F.col("tp"), F.col("tp") + F.col("fn")).alias("sensitivity"),
        _div(F.col("tn"), F.col("tn") + F.col("fp")).alias("specificity"),
    )


def rates(df: DataFrame, score: str, t: float = 0.5) -> DataFrame:
    """Share of rows scored above (detection) and below (flip) the threshold."""
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col(score) > t).cast("double")).alias("detection_rate"),
        F.avg((F.col(score) < t).cast("double")).alias("flip_rate"),
    )


def compare(rows: Sequence[DataFrame], sort_by: str) -> DataFrame:
    """Metric rows of several models in one table, best first."""
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out.orderBy(F.desc(sort_by))


def fold_improvement(df: DataFrame, fold: str, variant: str, metric: str, base: str, other: str) -> DataFrame:
    """Per-fold gain of ``other`` over ``base``, summarised."""
    wide = df.groupBy(fold).pivot(variant, [base, other]).agg(F.avg(metric))
    return wide.select((F.col(f"`{other}`") - F.col(f"`{base}`")).alias("gain")).agg(
        F.count("gain").alias("folds"),
        F.avg("gain").alias("mean_gain"),
        F.stddev_samp("gain").alias("std_gain"),
        F.min("gain").alias("min_gain"),
        F.max("gain").alias("max_gain"),
    )


def most_confident(df: DataFrame, id_col: str, score: str, k: int) -> DataFrame:
    """The ``k`` lowest and ``k`` highest scores."""
    low = df.orderBy(score, id_col).limit(k).withColumn("end", F.lit("low"))
    high = df.orderBy(F.desc(score), id_col).limit(k).withColumn("end", F.lit("high"))
    return low.unionByName(high)


# ---- clusterings -------------------------------------------------------------------------

MAX_CLUSTERS = 10_000  # in one block


def cluster_sums(df: DataFrame, cluster: str, features: str) -> DataFrame:
    """(cluster, n, sums per dimension, sum of squared norms); partial sums are made map side."""
    v = vector(features)
    sq = F.aggregate(F.col(features).cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)
    return df.groupBy(F.col(cluster).alias("cluster")).agg(
        F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.sum(v)).alias("s"), F.sum(sq).alias("q")
    )


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def silhouette_rows(df: DataFrame, id_col: str, cluster: str, features: str) -> DataFrame:
    """Silhouette per row with squared Euclidean distances, linear in the number of rows.

    Mean squared distance to a cluster follows from its size, sum vector and sum of squared
    norms, so no pair of rows is ever formed. Clusters travel as arrays, in blocks
    of bounded size, a pass over the rows for each.
    """
    rows = df.select(id_col, F.col(cluster).alias("cluster"), F.col(features).cast("array<double>").alias("_x"))
    rows = rows.withColumn("_q", F.aggregate("_x", F.lit(0.0), lambda a, x: a + x * x))
    distance = lambda c: c["n"] * F.col("_q") + c["q"] - 2.0 * _dot(F.col("_x"), c["s"])

    def step(block, first):
        own = F.get(F.transform(F.filter(block, lambda c: c["cluster"] == F.col("cluster")), lambda c: F.struct(c["n"].alias("n"), distance(c).alias("d"))), F.lit(0))
        other = F.array_min(F.transform(F.filter(block, lambda c: c["cluster"] != F.col("cluster")), lambda c: distance(c) / c["n"]))
        return {"_own": own if first else F.coalesce("_own", own), "_b": other if first else F.least("_b", other)}

    rows = over_blocks(rows, write_once(cluster_sums(df, cluster, features)), "cluster", step, MAX_CLUSTERS)
    rows = rows.withColumns({"_n": F.col("_own.n"), "_a": F.col("_own.d") / F.greatest(F.col("_own.n") - 1, F.lit(1))})
    s = (F.col("_b") - F.col("_a")) / F.greatest("_a", "_b")
    return rows.select(id_col, "cluster", F.when((F.col("_n") > 1) & (F.greatest("_a", "_b") > 0), s).otherwise(F.lit(0.0)).alias("silhouette"))


def silhouette(df: DataFrame, id_col: str, cluster: str, features: str) -> DataFrame:
    return silhouette_rows(df, id_col, cluster, features).agg(F.avg("silhouette").alias("silhouette"))


def davies_bouldin(df: DataFrame, cluster: str, features: str) -> DataFrame:
    """Mean over clusters of the worst (scatter_i + scatter_j) / distance of centroids."""
    centres = write_once(cluster_sums(df, cluster, features).select("cluster", F.transform("s", lambda v: v / F.col("n")).alias("m")))
    rows = df.select(F.col(cluster).alias("cluster"), F.col(features).cast("array<double>").alias("_x")).join(centres, "cluster")
    gap = lambda a, b: F.sqrt(
        F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)
    )
    scatter = write_once(rows.groupBy("cluster").agg(F.avg(gap(F.col("_x"), F.col("m"))).alias("scatter")).join(centres, "cluster"))

    def step(block, first):
        others = F.filter(block, lambda o: o["cluster"] != F.col("cluster"))
        worst = F.array_max(F.transform(others, lambda o: (F.col("scatter") + o["scatter"]) / gap(F.col("m"), o["m"])))
        return {"w": worst if first else F.greatest("w", worst)}

    return over_blocks(scatter, scatter, "cluster", step, MAX_CLUSTERS).agg(F.avg("w").alias("davies_bouldin"))


def contingency(df: DataFrame, truth: str, cluster: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("t"), F.col(cluster).alias("c")).agg(F.count(F.lit(1)).alias("n"))


def ari(df: DataFrame, truth: str, cluster: str) -> DataFrame:
    """Adjusted Rand index from the contingency counts."""
    cells = contingency(df, truth, cluster)
    two = lambda c: c * (c - 1) / 2.0
    both = cells.agg(F.sum(two(F.col("n"))).alias("both"), F.sum("n").alias("rows"))
    side = lambda k: one_row(cells.groupBy(k).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("v")))["v"]
    row = both.select("both", "rows", side("t").alias("a"), side("c").alias("b"))
    expected = F.col("a") * F.col("b") / two(F.col("rows"))
    top = F.col("both") - expected
    bottom = (F.col("a") + F.col("b")) / 2.0 - expected
    return row.select(F.when(bottom == 0, F.lit(1.0)).otherwise(F.try_divide(top, bottom)).alias("ari"))


def nmi(df: DataFrame, truth: str, cluster: str) -> DataFrame:
    """Mutual information over the arithmetic mean of the entropies."""
    cells = contingency(df, truth, cluster)
    rows = one_row(cells.agg(F.sum("n").alias("v")))["v"]
    t = cells.groupBy("t").agg(F.sum("n").alias("tn"))
    c = cells.groupBy("c").agg(F.sum("n").alias("cn"))
    p = F.col("n") / rows
    mi = cells.join(t, "t").join(c, "c").agg(F.sum(p * F.log(p * rows * rows / (F.col("tn") * F.col("cn")))).alias("mi"))
    entropy = lambda d, col: one_row(d.agg((-F.sum(F.col(col) / rows * F.log(F.col(col) / rows))).alias("v")))["v"]
    h = (entropy(t, "tn") + entropy(c, "cn")) / 2.0
    return mi.withColumn("h", h).select(F.when(F.col("h") == 0, F.lit(1.0)).otherwise(F.try_divide(F.col("mi"), F.col("h"))).alias("nmi"))


def purity(df: DataFrame, truth: str, cluster: str) -> DataFrame:
    """Share of rows whose class is the majority class of their cluster."""
    best = group_mode(df, cluster, truth)
    rows = one_row(df.agg(F.count(F.lit(1)).alias("v")))["v"]
    return best.agg((F.sum("n") / F.max(rows)).alias("purity"))
