"""Dialogue analytics: lines (season, episode, character, line) to summaries by season and speaker."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from weftwork.functions import text as T
from weftwork.operators import clean, combine, groups


def prepare_lines(raw: DataFrame) -> DataFrame:
    """Stray headers out, numbers cast, line breaks and punctuation removed, words counted."""
    lines = clean.drop_header_rows(raw, ["season", "episode", "character", "line"])
    lines = clean.cast_columns(lines, {"season": "int", "episode": "int"})
    lines = lines.withColumn("line", T.remove_newlines(F.col("line"))).withColumn("plain", T.strip_punct(F.col("line")))
    return lines.withColumn("words", T.word_count_ws(F.col("plain")))


def by_season(lines: DataFrame) -> DataFrame:
    """Episodes, speakers, lines and words per season, and lines and words per episode."""
    out = groups.group_summary(
        lines,
        ["season"],
        {"episodes": ("nunique", "episode"), "characters": ("nunique", "character"), "lines": ("count", "line"), "words": ("sum", "words")},
    )
    return out.withColumns(
        {
            "lines_per_episode": clean.ratio(F.col("lines"), F.col("episodes")),
            "words_per_episode": clean.ratio(F.col("words"), F.col("episodes")),
        }
    )


def by_character(lines: DataFrame, n: int = 10) -> DataFrame:
    """The speakers with most lines, with their mean line length."""
    out = groups.group_summary(lines, ["character"], {"lines": ("count", "line"), "words": ("sum", "words")})
    out = out.withColumn("length", clean.ratio(F.col("words"), F.col("lines")))
    return groups.top_groups(out, [F.desc("lines"), F.desc("words"), F.col("character")], n)


def season_shares(lines: DataFrame, speakers: Sequence[str]) -> DataFrame:
    """Share of each season's words by speaker, 0 where a speaker is absent."""
    per_season = lines.groupBy("season").agg(F.sum("words").alias("words"))
    each = lines.filter(F.col("character").isin(*speakers)).groupBy("character", "season").agg(F.sum("words").alias("words"))
    full = combine.fill_missing_groups(each, "character", "season", ["words"])
    return combine.share_of_total(full, per_season, ["season"], "words")
