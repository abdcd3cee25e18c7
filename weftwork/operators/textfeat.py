"""The text feature table: one narrow pass, no Python, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftwork.functions import text as T
from weftwork.functions.frame import explode_rows


def text_features(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with all features of ``functions.text.FEATURES`` added.

    Words, sentences and counts are staged as columns so each is computed once per row.
    """
    base = df.withColumn("_clean", T.feature_text(F.col(text)))
    base = base.withColumns({"_words": T.words(F.col("_clean")), "_sents": T.sentences(F.col("_clean"))})
    base = base.withColumns(
        {
            "word_count": F.size("_words").cast("bigint"),
            "character_count": F.length("_clean").cast("bigint"),
            "sentence_count": T.sentence_count(F.col("_sents")),
            "lexical_diversity": T.lexical_diversity(F.col("_words")),
            "avg_word_length": T.avg_word_length(F.col("_words")),
            "_syll": T.syllables(F.col("_clean"), F.size("_words")),
            "_complex": T.complex_words(F.col("_clean")),
            "_passive": T.passive_matches(F.col("_clean")),
            "punctuation_ratio": T.punctuation_ratio(F.col("_clean")),
            "grammar_errors": T.grammar_errors(F.col("_clean")),
            "burstiness": T.burstiness(F.col("_sents")),
        }
    )
    w, s = F.col("word_count").cast("double"), F.col("sentence_count")
    some = F.col("word_count") > 0
    zero = F.lit(0.0)
    out = {
        "word_count": F.col("word_count"),
        "character_count": F.col("character_count"),
        "sentence_count": s,
        "lexical_diversity": F.col("lexical_diversity"),
        "avg_sentence_length": w / s,
        "avg_word_length": F.col("avg_word_length"),
        "punctuation_ratio": F.col("punctuation_ratio"),
        "flesch_reading_ease": F.when(some, 206.835 - 1.015 * (w / s) - 84.6 * (F.col("_syll") / w)).otherwise(zero),
        "gunning_fog_index": F.when(some, 0.4 * (w / s + 100.0 * F.col("_complex") / w)).otherwise(zero),
        "grammar_errors": F.col("grammar_errors"),
        "passive_voice_ratio": F.col("_passive").cast("double") / s,
        "predictability_score": F.when(some, 1 - F.col("lexical_diversity")).otherwise(zero),
        "burstiness": F.col("burstiness"),
    }
    return base.select(*df.columns, *[out[f].alias(f) for f in T.FEATURES])


def sentiment(df: DataFrame, id_col: str, text: str, lexicon: DataFrame) -> DataFrame:
    """(id, sentiment_score): s / sqrt(s^2 + 15) with s the sum of the valences of a text's words.

    The lexicon joins the exploded words, so it may be any size; Spark broadcasts it when small.
    """
    ws = explode_rows(df, [id_col], T.words(T.feature_text(F.col(text))), "word")
    sums = ws.join(lexicon, "word").groupBy(id_col).agg(F.sum("valence").alias("s"))
    score = F.coalesce(F.col("s") / F.sqrt(F.col("s") * F.col("s") + 15.0), F.lit(0.0))
    return df.select(id_col).join(sums, id_col, "left").select(id_col, score.alias("sentiment_score"))
