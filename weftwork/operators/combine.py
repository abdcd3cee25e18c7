"""Deduplication, unions, joins and set logic on explicit keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from weftwork.functions.frame import one_row
from weftwork.functions.hashing import text_digest
from weftwork.operators.clean import ensure_columns
from weftwork.operators.scan import number_rows
from weftwork.session import write_once


def dedup_keep_first(df: DataFrame, keys: Sequence[str], id_col: str, digest: Sequence[str] = ()) -> DataFrame:
    """One row per key: the one with the smallest (unique) id.

    Only (digest, id) pairs are aggregated, map side first, so a third of all rows being copies
    of one text costs one partial row per task; texts themselves are not sorted or grouped.
    """
    group = [text_digest(F.col(c)) if c in digest else F.col(c) for c in keys]
    first = df.groupBy(*[g.alias(f"_g{i}") for i, g in enumerate(group)]).agg(F.min(id_col).alias(id_col))
    return df.join(first.select(id_col), id_col, "left_semi")


def union_tables(a: DataFrame, b: DataFrame, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Union by name; columns absent on one side are null there, then filled with defaults."""
    out = a.unionByName(b, allowMissingColumns=True)
    return ensure_columns(out, defaults) if defaults else out


def join_blocks(blocks: Sequence[DataFrame], id_col: str) -> DataFrame:
    """Feature blocks side by side, aligned on the id."""
    out = blocks[0]
    for b in blocks[1:]:
        out = out.join(b, id_col)
    return out


def stack_checks(preds: DataFrame, id_col: str, model: str, models: Sequence[str]) -> DataFrame:
    """Per model: rows, distinct ids and ids also present in the first model."""
    firsts = preds.filter(F.col(model) == models[0]).select(id_col).distinct().withColumn("_in", F.lit(1))
    return (
        preds.join(firsts, id_col, "left")
        .groupBy(model)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_distinct(id_col).alias("ids"),
            F.count_distinct(F.when(F.col("_in").isNotNull(), F.col(id_col))).alias("shared"),
        )
    )


def stack_predictions(preds: DataFrame, id_col: str, model: str, p: str, models: Sequence[str]) -> DataFrame:
    """Long predictions (id, model, p) to one column per model.

    Fails when a model is missing, repeats an id or covers other ids than the first model.
    """
    stats = {r[model]: r for r in stack_checks(preds.filter(F.col(model).isin(*models)), id_col, model, models).collect()}
    for m in models:
        r = stats.get(m)
        if r is None:
            raise ValueError(f"no predictions of model {m}")
        if r["rows"] != r["ids"] or r["shared"] != r["ids"] or r["ids"] != stats[models[0]]["ids"]:
            raise ValueError(f"rows of model {m} do not match those of {models[0]}")
    return preds.groupBy(id_col).pivot(model, list(models)).agg(F.max(p))


def present_in_all(df: DataFrame, key: str, group: str) -> DataFrame:
    """Keys found in every group."""
    groups = one_row(df.agg(F.count_distinct(group).alias("n")))
    return df.groupBy(key).agg(F.count_distinct(group).alias("groups")).filter(F.col("groups") == groups["n"]).select(key)


def semi_split(df: DataFrame, ids: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose id is listed, and the others."""
    return df.join(ids, id_col, "left_semi"), df.join(ids, id_col, "left_anti")


def catalog_diff(stored: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Keys that are new, vanished, or present but without output (``output`` is null in stored)."""
    new = current.select(key).join(stored.select(key), key, "left_anti").withColumn("status", F.lit("new"))
    gone = stored.select(key).join(current.select(key), key, "left_anti").withColumn("status", F.lit("vanished"))
    out = new.unionByName(gone)
    if "output" in stored.columns:
        missing = stored.filter(F.col("output").isNull()).select(key).join(current.select(key), key, "left_semi")
        out = out.unionByName(missing.withColumn("status", F.lit("missing_output")))
    return out


def cap_categories(df: DataFrame, col: str, k: int, name: str | None = None, other: str = "other") -> DataFrame:
    """Keep the ``k`` most frequent values (ties by value), the rest become ``other``."""
    top = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    top = top.orderBy(F.desc("_n"), col).limit(k).select(F.col(col).alias("_top"))
    joined = df.join(F.broadcast(top), F.col(col) == F.col("_top"), "left")  # at most k rows
    return joined.withColumn(name or col, F.coalesce("_top", F.lit(other))).drop("_top")


def fill_missing_groups(df: DataFrame, entity: str, period: str, values: Sequence[str], max_periods: int = 100_000) -> DataFrame:
    """Every (entity, period) pair, with 0 where a pair is absent.

    The periods travel in arrays of ``max_periods``, each joined to the entities by its number and
    exploded there.
    """
    periods = number_rows(df.select(period).distinct(), [period], "_i")
    part = F.floor(F.col("_i") / max_periods).cast("bigint")
    arrays = write_once(periods.groupBy(part.alias("_c")).agg(F.collect_list(period).alias("_p")))
    numbers = F.sequence(F.lit(0).cast("bigint"), F.lit(max(arrays.count() - 1, 0)).cast("bigint"))
    entities = df.select(entity).distinct()
    spine = entities.withColumn("_c", F.explode(numbers)).join(arrays, "_c").select(entity, F.explode("_p").alias(period))
    joined = spine.join(df, [entity, period], "left")
    return joined.withColumns({v: F.coalesce(F.col(v), F.lit(0).cast(df.schema[v].dataType)) for v in values})


def share_of_total(part: DataFrame, total: DataFrame, keys: Sequence[str], value: str, name: str = "share") -> DataFrame:
    """``value`` of part over ``value`` of total with the same keys."""
    t = total.select(*keys, F.col(value).alias("_total"))
    return part.join(t, list(keys)).withColumn(name, F.try_divide(F.col(value).cast("double"), F.col("_total"))).drop("_total")


def paired_delta(a: DataFrame, b: DataFrame, id_col: str, p: str, t: float = 0.5) -> DataFrame:
    """Scores before and after: pairs, means, mean drop, share that fell below the threshold."""
    pairs = a.select(id_col, F.col(p).alias("before")).join(b.select(id_col, F.col(p).alias("after")), id_col)
    return pairs.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.avg("before").alias("mean_before"),
        F.avg("after").alias("mean_after"),
        (F.avg("before") - F.avg("after")).alias("drop"),
        F.avg((F.col("after") < t).cast("double")).alias("below"),
    )


def error_table(df: DataFrame, id_col: str, label: str, p: str, names: Mapping[int, str], t: float = 0.5) -> DataFrame:
    """Truth, prediction, confidence and class names of wrongly predicted rows."""
    name_of = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    pred = (F.col(p) >= t).cast("int")
    return (
        df.select(id_col, F.col(label).alias("truth"), pred.alias("predicted"), F.col(p).alias("probability"))
        .withColumns(
            {
                "truth_name": F.try_element_at(name_of, F.col("truth")),
                "predicted_name": F.try_element_at(name_of, F.col("predicted")),
                "error": F.col("truth") != F.col("predicted"),
            }
        )
        .filter("error")
    )
