"""The labelled-corpus flow: two raw tables to one cleaned, split feature table.

Everything is one lazy plan but for the few numbers that decide columns and limits (one-hot
values, constant columns, quantiles), which are found by small aggregations on the way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftwork.functions import text as T
from weftwork.operators import clean, combine, encode, profile, split
from weftwork.operators.quantiles import exact_quantiles
from weftwork.operators.textfeat import text_features
from weftwork.session import write_once

# What missing columns of a raw corpus are filled with.
DEFAULTS = {"language": "unknown", "source": "unknown", "multi_label": "unknown_model", "potential_noise": 0}


def harmonise(df: DataFrame, dataset: str, drop_noise: bool = True) -> DataFrame:
    """A raw corpus (id, text, label, ...) in the common schema."""
    out = clean.ensure_columns(df, {"text": "", "label": 0, **DEFAULTS}).withColumn("dataset", F.lit(dataset))
    out = clean.cast_columns(out, {"label": "int", "potential_noise": "int"})
    out = clean.drop_flagged(out, "potential_noise") if drop_noise else out
    return out.select("id", "text", "label", *DEFAULTS, "dataset")


def combine_corpora(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union, white space normalised, empty texts dropped, one row per (text, label)."""
    both = combine.union_tables(a, b).withColumn("text", T.normalize_ws(F.col("text")))
    both = clean.drop_empty(both, "text")
    return combine.dedup_keep_first(both, ["text", "label"], "id", digest=["text"])


def feature_table(corpus: DataFrame, top_languages: int = 12, top_sources: int = 20, top_models: int = 20) -> DataFrame:
    """Text features, length, noise flag and one-hot flags of the capped categories."""
    corpus = write_once(corpus)  # each of the small aggregations below would clean and deduplicate it again
    out = text_features(corpus)
    for col, prefix, k in (("language", "lang", top_languages), ("source", "src", top_sources), ("multi_label", "model", top_models)):
        # the kept values come from the narrow corpus, not from the features
        top = corpus.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col).limit(k)
        kept = [r[0] for r in top.collect() if r[0] is not None]
        out = out.withColumn(col, F.when(F.col(col).isin(*kept), F.col(col)).otherwise("other"))
        rest = corpus.filter(~F.col(col).isin(*kept) | F.col(col).isNull()).limit(1).count()
        out = encode.one_hot(out, col, prefix, sorted(set(kept) | ({"other"} if rest else set())))
    names = [r[0] for r in corpus.select("dataset").distinct().collect()]
    return encode.one_hot(out, "dataset", "ds", sorted(names)).drop("language", "source", "multi_label", "dataset")


def quality_rules() -> dict:
    """Structural sanity rules a row must meet."""
    # Names and thresholds of the rules
    return {
        "word_count_gt_0": F.col("word_count") > 0,
        "avg_word_length_le_20": F.col("avg_word_length") <= 20,
        "avg_sentence_length_le_200": F.col("avg_sentence_length") <= 200,
        "gunning_fog_index_le_60": F.col("gunning_fog_index") <= 60,
        "flesch_reading_ease_ge_-100": F.col("flesch_reading_ease") >= -100,
    }


def clean_features(features: DataFrame, id_col: str = "id", label: str = "label") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cleaned table, rule report, summary): anomaly rules, then strip, dedup by text, constant
    columns out, numeric columns clipped to their 1st and 99th percentile. The summary has (item,
    column, value): rows after each step, duplicates removed, constants dropped, bounds of clipping."""
    kept, report = clean.apply_rules(features, quality_rules(), derived=True)
    # written once: dedup, constants and quantiles would each compute the features again
    stripped = write_once(clean.strip_min_chars(kept, "text", 1))
    unique = write_once(combine.dedup_keep_first(stripped, ["text"], id_col, digest=["text"]))
    constants = profile.constant_columns(unique, [c for c in unique.columns if c not in (label, id_col, "text")])
    varied = unique.drop(*constants)
    bounds = exact_quantiles(varied, profile.numeric_columns(varied, drop=[label, id_col]), [0.01, 0.99])
    before, after = stripped.count(), unique.count()
    items = [("rows_after_strip", None, float(before)), ("rows_after_dedup", None, float(after)), ("duplicates_removed", None, float(before - after))]
    items += [("constant_dropped", c, None) for c in constants]
    items += [(name, c, b[i]) for c, b in bounds.items() for i, name in enumerate(("clip_low", "clip_high"))]
    summary = features.sparkSession.createDataFrame(items, "item string, column string, value double")
    return clean.clip_to(varied, bounds), report, summary


def split_corpus(cleaned: DataFrame, label: str = "label", test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    return split.split_with_fallback(cleaned, label, test_fraction, "id", seed)[0]
