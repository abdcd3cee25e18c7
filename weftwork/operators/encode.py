"""Encoding, scaling and projection of feature columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from weftwork.operators.quantiles import number
from weftwork.operators.scan import number_rows
from weftwork.session import write_once

MAX_COLUMNS = 10_000


def one_hot_vector(df: DataFrame, col: str, name: str, codes: DataFrame | None = None) -> DataFrame:
    """A vector column with a 1 at the place of the row's value, for any number of values: values are
    numbered over ranges and joined, and no list of them is ever built. Null, and a value that is not in
    ``codes``, gives a vector of zeros. The size is the number of codes."""
    import numpy as np

    from weftwork.operators.vectorize import sparse_column, with_column

    codes = write_once(label_codes(df, col) if codes is None else codes)
    size = codes.count()
    placed = label_encode(df, col, "_code", codes)

    def add(batch):
        code = batch.column(batch.schema.get_field_index("_code")).fill_null(-1).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(code >= 0)])
        return sparse_column(size, starts, code[code >= 0], np.ones(int(starts[-1])))

    return with_column(placed, name, add).select(*df.columns, name)


def one_hot(df: DataFrame, col: str, prefix: str, values: Sequence | None = None) -> DataFrame:
    """One boolean column ``prefix_value`` per value, in value order. A plan has room for MAX_COLUMNS of
    them; ``one_hot_vector`` takes any number of values."""
    if values is None:
        rows = df.select(col).distinct().filter(F.col(col).isNotNull()).limit(MAX_COLUMNS + 1).collect()
        if len(rows) > MAX_COLUMNS:
            raise ValueError(f"{col} has more than {MAX_COLUMNS} values; use one_hot_vector")
        values = sorted(r[0] for r in rows)
    return df.withColumns({f"{prefix}_{v}": F.coalesce(F.col(col) == F.lit(v), F.lit(False)) for v in values})


def label_codes(df: DataFrame, col: str) -> DataFrame:
    """(value, code) with codes 0.. in value order."""
    values = df.select(col).filter(F.col(col).isNotNull()).distinct()
    return number_rows(values, [col], "code")


def label_encode(df: DataFrame, col: str, name: str, codes: DataFrame | None = None) -> DataFrame:
    codes = label_codes(df, col) if codes is None else codes
    return df.join(codes.withColumnRenamed("code", name), col, "left")


def label_decode(df: DataFrame, code: str, codes: DataFrame, name: str) -> DataFrame:
    value = next(c for c in codes.columns if c != "code")
    back = codes.select(F.col("code").alias(code), F.col(value).alias(name))
    return df.join(back, code, "left")


def _stats(df: DataFrame, cols: Sequence[str], **funcs) -> dict:
    aggs = [f(number(df, c)).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in funcs.items()]
    return df.agg(*aggs).first().asDict()


def minmax_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """To [0, 1]; a constant column becomes 0."""
    s = _stats(df, cols, lo=F.min, hi=F.max)
    out = {}
    for i, c in enumerate(cols):
        lo, hi = s[f"lo{i}"], s[f"hi{i}"]
        if lo is None:
            continue
        out[c] = (number(df, c) - F.lit(lo)) / F.lit((hi - lo) or 1.0)
    return df.withColumns(out)


def standardize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Zero mean, unit population std; a constant column becomes 0."""
    s = _stats(df, cols, a=F.avg, s=F.stddev_pop)
    return df.withColumns(
        {c: (number(df, c) - F.lit(s[f"a{i}"])) / F.lit(s[f"s{i}"] or 1.0) for i, c in enumerate(cols) if s[f"a{i}"] is not None}
    )


def assemble(df: DataFrame, cols: Sequence[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=name, handleInvalid="keep").transform(df)


def vector(col: str | Column) -> Column:
    """Array column to an ML vector."""
    c = F.col(col) if isinstance(col, str) else col
    return array_to_vector(c.cast("array<double>"))


def standardize_vector(df: DataFrame, features: str = "features", name: str = "scaled", with_std: bool = True):
    """(frame, model): centred and divided by the sample std of each dimension."""
    model = StandardScaler(inputCol=features, outputCol=name, withMean=True, withStd=with_std).fit(df)
    return model.transform(df), model


def pca(df: DataFrame, k: int, features: str = "features", scale: bool = True):
    """(frame with ``pcs`` array<double>, explained ratios). The input is centred first and, with
    ``scale``, divided by the population std; each component's sign makes its largest loading positive."""
    import numpy as np

    scaled, _ = standardize_vector(df, features, "_scaled", with_std=scale)
    model = PCA(k=k, inputCol="_scaled", outputCol="_pcs").fit(scaled)
    loadings = model.pc.toArray()
    n = df.count() if scale else 0
    unit = (n / (n - 1)) ** 0.5 if n > 1 else 1.0  # from the sample std, which the scaler uses
    signs = [unit * float(s) for s in np.sign(loadings[np.abs(loadings).argmax(axis=0), range(k)])]
    out = model.transform(scaled)
    flipped = F.zip_with(vector_to_array("_pcs"), F.array(*[F.lit(s) for s in signs]), lambda x, s: x * s)
    return out.withColumn("pcs", flipped).drop("_scaled", "_pcs"), [float(x) for x in model.explainedVariance]


def pca_variance(df: DataFrame, dims: int, share: float = 0.95, features: str = "features"):
    """The fewest components that explain at least ``share`` of the variance."""
    out, ratios = pca(df, dims, features)
    total, k = 0.0, 0
    while k < len(ratios) and total < share:
        total += ratios[k]
        k += 1
    return out.withColumn("pcs", F.slice("pcs", 1, k)), ratios[:k]
