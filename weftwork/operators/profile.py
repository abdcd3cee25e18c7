"""Table profiling. Each report is one aggregation job over all columns, never one per column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, FloatType

from weftwork.functions.frame import melt, numeric_names, one_row
from weftwork.functions.hashing import text_digest
from weftwork.operators.quantiles import exact_quantiles, number


def _missing(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    if isinstance(df.schema[name].dataType, (DoubleType, FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def rows_of(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def overview(df: DataFrame, text: str) -> DataFrame:
    """Rows, columns, mean and median text length."""
    lengths = df.select(F.length(text).alias("n"))
    median = exact_quantiles(lengths, ["n"], [0.5])["n"][0]
    return lengths.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.avg("n").alias("text_length_mean"),
        F.lit(median).cast("double").alias("text_length_median"),
    )


def column_types(df: DataFrame) -> DataFrame:
    return rows_of(df.sparkSession, [(f.name, f.dataType.simpleString()) for f in df.schema.fields], "column string, type string")


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing values per column (null or NaN), columns without any left out, most first."""
    cols = list(cols or df.columns)
    row = df.agg(*[F.count_if(_missing(df, c)).alias(f"v{i}") for i, c in enumerate(cols)])
    return melt(row, [(c, {"n": F.col(f"v{i}")}) for i, c in enumerate(cols)]).filter("n > 0").orderBy(F.desc("n"), "column")


def zero_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    row = df.agg(*[F.count_if(F.col(c) == 0).alias(f"v{i}") for i, c in enumerate(cols)])
    return melt(row, [(c, {"n": F.col(f"v{i}")}) for i, c in enumerate(cols)])


def distinct_counts(df: DataFrame, cols: Sequence[str] | None = None, dropna: bool = True, approx: bool = False) -> DataFrame:
    """Distinct values per column; with ``dropna=False`` missing counts as one more value."""
    cols = list(cols or df.columns)
    value = lambda c: F.when(~_missing(df, c), F.col(c))
    count = (lambda c: F.approx_count_distinct(value(c))) if approx else (lambda c: F.count_distinct(value(c)))
    aggs = [count(c).alias(f"v{i}") for i, c in enumerate(cols)]
    if not dropna:
        aggs += [F.max(_missing(df, c).cast("int")).alias(f"m{i}") for i, c in enumerate(cols)]
    row = df.agg(*aggs)
    n = lambda i: F.col(f"v{i}") if dropna else F.col(f"v{i}") + F.coalesce(F.col(f"m{i}"), F.lit(0))
    return melt(row, [(c, {"n": n(i).cast("bigint")}) for i, c in enumerate(cols)])


def describe(df: DataFrame, cols: Sequence[str] | None = None, probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """count, mean, sample std, min, max and exact percentiles (``p25`` ...) per column."""
    cols = list(cols or numeric_names(df))
    q = exact_quantiles(df, cols, probs)
    aggs = []
    for i, c in enumerate(cols):
        v = number(df, c)
        aggs += [f(v).alias(f"{k}{i}") for k, f in (("n", F.count), ("a", F.avg), ("s", F.stddev_samp), ("lo", F.min), ("hi", F.max))]
    entries = []
    for i, c in enumerate(cols):
        vals = {"count": F.col(f"n{i}"), "mean": F.col(f"a{i}"), "std": F.col(f"s{i}"), "min": F.col(f"lo{i}"), "max": F.col(f"hi{i}")}
        vals |= {f"p{round(p * 100):02d}": F.lit(q[c][j]).cast("double") for j, p in enumerate(probs)}
        entries.append((c, vals))
    return melt(df.agg(*aggs), entries)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts per value with the share of all rows."""
    total = one_row(df.agg(F.count(F.lit(1)).alias("n")))
    return (
        df.groupBy(col)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("share", F.col("n") / total["n"])
        .orderBy(F.desc("n"), col)
    )


def unique(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def duplicate_counts(df: DataFrame, cols: Sequence[str], digest: Sequence[str] = ()) -> DataFrame:
    """Rows beyond the first of each key. Columns in ``digest`` (long text) are grouped by sha-256."""
    keys = [text_digest(F.col(c)).alias(c) if c in digest else F.col(c) for c in cols]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def constant_columns(df: DataFrame, cols: Sequence[str] | None = None, dropna: bool = False) -> list[str]:
    """Columns holding one value; min = max decides it in one pass with no distinct shuffle.

    By default missing counts as a value; with ``dropna=True`` it is ignored.
    """
    cols = list(cols or df.columns)
    aggs = []
    for i, c in enumerate(cols):
        value = F.when(~_missing(df, c), F.col(c))
        aggs += [F.min(value).alias(f"lo{i}"), F.max(value).alias(f"hi{i}"), F.count_if(_missing(df, c)).alias(f"m{i}")]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *aggs)
    flags = row.select(
        *[
            (
                (F.col(f"lo{i}").isNotNull() & (F.col(f"lo{i}") == F.col(f"hi{i}")) & ((F.col(f"m{i}") == 0) | F.lit(dropna)))
                | (F.lit(not dropna) & (F.col("rows") > 0) & (F.col(f"m{i}") == F.col("rows")))
            ).alias(f"f{i}")
            for i in range(len(cols))
        ]
    ).first()
    return [c for i, c in enumerate(cols) if flags[i]]


def constant_columns_table(df: DataFrame, cols: Sequence[str] | None = None, dropna: bool = False) -> DataFrame:
    return rows_of(df.sparkSession, [(c,) for c in constant_columns(df, cols, dropna)], "column string")


def column_kinds(df: DataFrame, cols: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """categorical with at most ``k`` distinct values (missing is one), else continuous."""
    kinds = distinct_counts(df, cols, dropna=False)
    return kinds.select("column", F.when(F.col("n") <= k, "categorical").otherwise("continuous").alias("kind"))


def numeric_columns(df: DataFrame, drop: Sequence[str] = (), prefixes: Sequence[str] = ()) -> list[str]:
    return [c for c in numeric_names(df) if c not in drop and not c.startswith(tuple(prefixes) or ("\0",))]


def rule_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows matching each rule; an unknown (null) comparison does not match."""
    names = list(rules)
    row = df.agg(*[F.count_if(F.coalesce(rules[r], F.lit(False))).alias(f"v{i}") for i, r in enumerate(names)])
    return melt(row, [(r, {"n": F.col(f"v{i}")}) for i, r in enumerate(names)], key="rule")


def flag_sums(df: DataFrame, prefix: str) -> DataFrame:
    cols = [c for c in df.columns if c.startswith(prefix)]
    row = df.agg(*[F.sum(F.col(c).cast("bigint")).alias(f"v{i}") for i, c in enumerate(cols)])
    return melt(row, [(c, {"n": F.col(f"v{i}")}) for i, c in enumerate(cols)]).orderBy(F.desc("n"), "column")


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width bins over [min, max], last bin closed, empty bins kept.

    A constant column is spread over half a unit on both sides of its value.
    """
    v = number(df, col)
    data = df.select(v.alias("v")).filter("v is not null")
    lim = one_row(data.agg(F.min("v").alias("lo"), F.max("v").alias("hi")))
    lo = F.when(lim["lo"] == lim["hi"], lim["lo"] - 0.5).otherwise(lim["lo"])
    hi = F.when(lim["lo"] == lim["hi"], lim["hi"] + 0.5).otherwise(lim["hi"])
    counts = (
        data.select(F.least(F.floor((F.col("v") - lo) * bins / (hi - lo)), F.lit(bins - 1)).cast("bigint").alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    spine = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return spine.join(counts, "bin", "left").select(
        "bin",
        (lo + F.col("bin") * (hi - lo) / bins).alias("low"),
        (lo + (F.col("bin") + 1) * (hi - lo) / bins).alias("high"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def label_correlation(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Pearson correlation of each column with the label, strongest first."""
    row = df.agg(*[F.corr(number(df, c), F.col(label).cast("double")).alias(f"v{i}") for i, c in enumerate(cols)])
    return melt(row, [(c, {"corr": F.col(f"v{i}")}) for i, c in enumerate(cols)]).orderBy(F.desc(F.abs("corr")), "column")


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long form (a, b, corr); each pair computed once in a single aggregation."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = df.agg(*[F.corr(number(df, cols[i]), number(df, cols[j])).alias(f"v{i}_{j}") for i, j in pairs])
    structs = []
    for i in range(len(cols)):
        for j in range(len(cols)):
            v = F.col(f"v{min(i, j)}_{max(i, j)}")
            structs.append(F.struct(F.lit(cols[i]).alias("a"), F.lit(cols[j]).alias("b"), v.alias("corr")))
    return row.select(F.inline(F.array(*structs)))


def iqr_bounds(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> dict[str, tuple[float, float]]:
    q = exact_quantiles(df, cols, [0.25, 0.75])
    return {c: (a - k * (b - a), b + k * (b - a)) for c, (a, b) in q.items() if a is not None}


def iqr_outliers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    bounds = iqr_bounds(df, cols)
    rules = {c: (F.col(c) < F.lit(bounds[c][0])) | (F.col(c) > F.lit(bounds[c][1])) for c in cols if c in bounds}
    return rule_counts(df, rules).withColumnRenamed("rule", "column")


def class_balance(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("positive_rate"))


def detect_group_column(df: DataFrame, prefixes: Sequence[str]) -> str | None:
    """The first column, in the order of the table, that has one of the prefixes and more than one
    value but not one per row."""
    cols = [c for c in df.columns if c.startswith(tuple(prefixes))]
    if not cols:
        return None
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_distinct(c).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    return next((c for i, c in enumerate(cols) if 1 < row[i + 1] < row["rows"]), None)


def totals(df: DataFrame, words: Column, groups: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(words).cast("bigint").alias("words"),
        F.count_distinct(groups).alias("groups"),
    )
