"""Filters, projections and repairs. Thresholds are a few numbers found by one job and then
used as literals, so the repair itself is a narrow pass over the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from weftwork.functions import text as T
from weftwork.functions.frame import melt
from weftwork.operators import profile
from weftwork.operators.quantiles import exact_quantiles, number
from weftwork.operators.split import sample_n


def strip_min_chars(df: DataFrame, text: str, n: int = 1) -> DataFrame:
    """Strip the text and keep rows of at least ``n`` characters; null text counts as empty."""
    return df.withColumn(text, T.strip(F.coalesce(F.col(text), F.lit("")))).filter(F.length(text) >= n)


def drop_empty(df: DataFrame, text: str, length: str = "length") -> DataFrame:
    """Drop rows without text and recompute the length column."""
    return df.filter(F.length(text) > 0).withColumn(length, F.length(text).cast("bigint"))


def drop_flagged(df: DataFrame, flag: str) -> DataFrame:
    return df.filter(F.col(flag) == 0)


def flagged_report(df: DataFrame, flag: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(F.col(flag) == 0).alias("rows_after"),
        F.count_if(~F.coalesce(F.col(flag) == 0, F.lit(False))).alias("dropped"),
    )


def drop_header_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows in which every listed field repeats its own column name."""
    same = F.lit(True)
    for c in cols or df.columns:
        same = same & F.coalesce(F.col(c).cast("string") == c, F.lit(False))
    return df.filter(~same)


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast("double") for c in cols})


def apply_rules(df: DataFrame, rules: Mapping[str, Column], derived: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows meeting every rule, and a report of how many rows break each one. A comparison with a
    missing value, null or NaN, breaks its rule.

    ``derived``: the rules are on columns that are costly to compute. They are then tested on
    the output of a generator, below which Spark does not push the filter; pushed down, it
    would compute those columns once more for the test.
    """
    ok = {name: F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}
    every = F.lit(True)
    for c in ok.values():
        every = every & c
    names = list(ok)
    # rules see null for NaN, which Spark would order above every number; the rows keep theirs
    floating = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    columns = df.columns
    seen = df.withColumns({f"_own_{c}": F.col(c) for c in floating} | {c: F.when(~F.isnan(c), F.col(c)) for c in floating}) if floating else df
    own = [F.col(f"_own_{c}").alias(c) if c in floating else F.col(c) for c in columns]
    row = seen.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(every).alias("kept"),
        *[F.count_if(~ok[r]).alias(f"v{i}") for i, r in enumerate(names)],
    )
    entries = [("rows_start", {"n": F.col("rows")}), ("rows_after_filters", {"n": F.col("kept")})]
    entries += [("total_dropped", {"n": F.col("rows") - F.col("kept")})]
    entries += [(r, {"n": F.col(f"v{i}")}) for i, r in enumerate(names)]
    report = melt(row, entries, key="rule")
    if derived:
        return seen.select("*", F.explode_outer(F.array(every)).alias("_ok")).filter("_ok").select(*own), report
    return seen.filter(every).select(*own), report


def drop_constant(df: DataFrame, keep: Sequence[str] = ("label",), dropna: bool = False) -> DataFrame:
    candidates = [c for c in df.columns if c not in keep]
    return df.drop(*profile.constant_columns(df, candidates, dropna)) if candidates else df


def clip_quantiles(df: DataFrame, cols: Sequence[str], lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    return clip_to(df, exact_quantiles(df, cols, [lo, hi]))


def clip_to(df: DataFrame, bounds: Mapping[str, Sequence[float | None]]) -> DataFrame:
    """Columns cut to (low, high); a column without bounds stays."""
    return df.withColumns(
        {c: F.when(F.col(c).isNotNull(), F.least(F.greatest(number(df, c), F.lit(a)), F.lit(b))) for c, (a, b) in bounds.items() if a is not None}
    )


def drop_iqr_outliers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    keep = F.lit(True)
    for c, (lo, hi) in profile.iqr_bounds(df, cols).items():
        keep = keep & ~F.coalesce((F.col(c) < F.lit(lo)) | (F.col(c) > F.lit(hi)), F.lit(False))
    return df.filter(keep)


def impute_zero_mean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Zero means missing: replace it by the mean of the non-zero values."""
    means = df.agg(*[F.avg(F.nullif(number(df, c), F.lit(0.0))).alias(c) for c in cols]).first()
    return df.withColumns({c: F.when(number(df, c) == 0, F.lit(means[c])).otherwise(number(df, c)) for c in cols})


def fit_medians(train: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Medians of the training rows; a column without any value gets 0."""
    return {c: (q[0] if q[0] is not None else 0.0) for c, q in exact_quantiles(train, cols, [0.5]).items()}


def apply_medians(df: DataFrame, medians: Mapping[str, float]) -> DataFrame:
    """Fill missing values with the given medians; absent columns are created."""
    return df.withColumns(
        {c: F.coalesce(number(df, c), F.lit(m)) if c in df.columns else F.lit(m) for c, m in medians.items()}
    )


def log1p_columns(train: DataFrame, cols: Sequence[str], threshold: float = 1000.0) -> list[str]:
    """Columns that are all positive and exceed the threshold in the training rows."""
    aggs = [f(number(train, c)).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("lo", F.min), ("hi", F.max))]
    row = train.agg(*aggs).first()
    return [c for i, c in enumerate(cols) if row[f"lo{i}"] is not None and row[f"lo{i}"] > 0 and row[f"hi{i}"] > threshold]


def log1p_skewed(train: DataFrame, test: DataFrame | None, cols: Sequence[str], threshold: float = 1000.0):
    """log1p on the columns chosen from train, in both frames."""
    chosen = log1p_columns(train, cols, threshold)
    apply = lambda d: d.withColumns({c: F.log1p(F.col(c).cast("double")) for c in chosen if c in d.columns})
    return apply(train), (apply(test) if test is not None else None)


def ensure_columns(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Create missing columns with their default and fill nulls of existing ones."""
    out = {}
    for c, v in defaults.items():
        if c not in df.columns:
            out[c] = F.lit(v)
        elif v is not None:
            out[c] = F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType))
    return df.withColumns(out)


def when_column(df: DataFrame, name: str, cond: Column, then, other) -> DataFrame:
    return df.withColumn(name, F.when(cond, F.lit(then)).otherwise(F.lit(other)))


def map_codes(df: DataFrame, col: str, mapping: Mapping, name: str) -> DataFrame:
    """Code to name through a literal map; unknown codes give null."""
    entries = [F.lit(x) for kv in mapping.items() for x in kv]
    return df.withColumn(name, F.try_element_at(F.create_map(*entries), F.col(col)))


def filter_classes(df: DataFrame, label: str, classes: Sequence, id_col: str, max_rows: int | None = None, seed: int = 42) -> DataFrame:
    """Rows of the listed classes, optionally a seeded choice of ``max_rows`` of them."""
    kept = df.filter(F.col(label).isin(*classes))
    return kept if max_rows is None else sample_n(kept, max_rows, id_col, seed)


def scale_array(col: str | Column, k: float) -> Column:
    return F.transform(col, lambda x: x.cast("double") / F.lit(float(k)))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def filter_equal(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    for c, v in values.items():
        df = df.filter(F.col(c) == F.lit(v))
    return df


def inference_frame(df: DataFrame, id_col: str, text: str, columns: Sequence[str], flags_on: Sequence[str] = ()) -> DataFrame:
    """Features of unseen text in a fixed column order; flags not computable are 0 but for ``flags_on``."""
    from weftwork.operators.textfeat import text_features

    feats = text_features(df, text)
    known = {**{c: F.col(c) for c in T.FEATURES}, "length": F.length(F.coalesce(F.col(text), F.lit("")))}
    cols = [known.get(c, F.lit(1.0 if c in flags_on else 0.0)).cast("double").alias(c) for c in columns]
    return feats.select(id_col, *cols)
