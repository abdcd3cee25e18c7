"""Registration helpers shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weftwork.functions import text as T
from weftwork.functions import wordlists as wl
from weftwork.session import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SEED = 42


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def t(spark: SparkSession, root: str, name: str) -> DataFrame:
    return table(spark, root, name)


def texts(spark: SparkSession, root: str, name: str = "documents") -> DataFrame:
    """A text table ahead of costly per-row work."""
    return spread(table(spark, root, name))


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Both engines round, since sums of doubles depend on the order of addition."""
    return df.withColumns({c: r(F.col(c), digits) for c in cols})


def r(c: Column, digits: int = 6) -> Column:
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def sr(expr: str, digits: int = 6) -> str:
    return f"(round(({expr})::DOUBLE, {digits}) + 0.0)"


def in_list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def lit_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


ENGLISH = wl.stopwords("english")
SPANISH = wl.stopwords("spanish")

# ---- SQL for the text features -----------------------------------------------------------
W = rf"[{T.WORD_CHAR}]"
S = T.SPACE
V = f"[{T.VOWELS}]"


def sql_strip(e: str) -> str:
    return f"regexp_replace({e}, '^{S}+|{S}+$', '', 'g')"


def sql_feature_ctes(source: str = "documents", keys: str = "doc_id, lang, text") -> str:
    clean = sql_strip("replace(coalesce(text, ''), chr(10), ' ')")
    # separators doubled, so that a match may consume the boundary character on both sides
    doubled = rf"regexp_replace(clean, '([^{T.WORD_CHAR}])', '\1\1', 'g')"
    forms = "|".join(wl.BE_FORMS)
    phrases = "|".join(p.replace("'", "''''").replace(" ", "  ") for p in wl.GRAMMAR_ERRORS)
    return f"""
    _clean AS (SELECT {keys}, {clean} AS clean FROM {source}),
    _parts AS (
      SELECT *, regexp_extract_all(lower(clean), '{W}+') AS words,
        list_filter(regexp_split_to_array(clean, '[.!?]+'), lambda s: regexp_matches(s, '[^{T.SPACE_CHAR}]')) AS sents,
        {doubled} AS dbl
      FROM _clean),
    _counts AS (
      SELECT *, len(words)::BIGINT AS wc, greatest(len(sents), 1)::BIGINT AS sc, length(clean)::BIGINT AS cc,
        len(list_distinct(words)) AS uw, length(list_aggregate(list_concat(words, ['']), 'string_agg', '')) AS wl,
        len(regexp_extract_all(clean, '{T.PUNCT}')) AS pc,
        coalesce(list_sum(list_transform(words, lambda w: greatest(len(regexp_extract_all(w, '{V}+')), 1))), 0) AS syl,
        len(list_filter(words, lambda w: len(regexp_extract_all(w, '{V}+')) >= 3)) AS cplx,
        len(regexp_extract_all(dbl, '(?i)(^|[^{T.WORD_CHAR}])({forms}){S}+{W}+ed($|[^{T.WORD_CHAR}])')) AS pas,
        len(regexp_extract_all(lower(dbl), '(^|[^{T.WORD_CHAR}])({phrases})($|[^{T.WORD_CHAR}])')) AS ge,
        list_transform(sents, lambda s: len(regexp_extract_all(s, '{T.NON_SPACE}'))::BIGINT) AS sl
      FROM _parts),
    feats AS (
      SELECT {keys}, wc AS word_count, cc AS character_count, sc AS sentence_count,
        CASE WHEN wc > 0 THEN uw::DOUBLE / wc ELSE 0 END AS lexical_diversity,
        wc::DOUBLE / sc AS avg_sentence_length,
        CASE WHEN wc > 0 THEN wl::DOUBLE / wc ELSE 0 END AS avg_word_length,
        CASE WHEN cc > 0 THEN pc::DOUBLE / cc ELSE 0 END AS punctuation_ratio,
        CASE WHEN wc > 0 THEN 206.835::DOUBLE - 1.015::DOUBLE * (wc::DOUBLE / sc) - 84.6::DOUBLE * (syl::DOUBLE / wc) ELSE 0 END AS flesch_reading_ease,
        CASE WHEN wc > 0 THEN 0.4::DOUBLE * (wc::DOUBLE / sc + 100.0::DOUBLE * cplx / wc) ELSE 0 END AS gunning_fog_index,
        ge::BIGINT AS grammar_errors,
        pas::DOUBLE / sc AS passive_voice_ratio,
        CASE WHEN wc > 0 THEN 1 - uw::DOUBLE / wc ELSE 0 END AS predictability_score,
        CASE WHEN len(sents) > 0 THEN
          (sqrt((len(sents) * list_sum(list_transform(sl, lambda x: x * x)) - list_sum(sl) * list_sum(sl))::DOUBLE) / len(sents))
          / (list_sum(sl)::DOUBLE / len(sents) + 1e-6) ELSE 0 END AS burstiness
      FROM _counts)"""


FEATURE_TYPES = {f: ("bigint" if f in ("word_count", "character_count", "sentence_count", "grammar_errors") else "double") for f in T.FEATURES}


def rounded_features(df: DataFrame) -> DataFrame:
    return rounded(df, *[f for f, k in FEATURE_TYPES.items() if k == "double"])


def sql_features(cols=None) -> str:
    return ", ".join(f if FEATURE_TYPES[f] == "bigint" else f"{sr(f)} AS {f}" for f in (cols or T.FEATURES))
