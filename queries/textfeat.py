"""H: text features."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.registry import FEATURE_TYPES, query, rounded, rounded_features, sql_feature_ctes, sql_features, sr, texts
from weftwork.functions import text as T
from weftwork.functions import wordlists as wl
from weftwork.operators.textfeat import sentiment, text_features

NAMES = {
    "h01_word_count": "word_count",
    "h02_sentence_count": "sentence_count",
    "h03_lexical_diversity": "lexical_diversity",
    "h04_avg_sentence_length": "avg_sentence_length",
    "h05_avg_word_length": "avg_word_length",
    "h06_character_count": "character_count",
    "h07_punctuation_ratio": "punctuation_ratio",
    "h08_flesch_reading_ease": "flesch_reading_ease",
    "h09_gunning_fog_index": "gunning_fog_index",
    "h10_burstiness": "burstiness",
    "h12_passive_voice_ratio": "passive_voice_ratio",
    "h13_predictability_score": "predictability_score",
    "h14_grammar_errors": "grammar_errors",
}


def _register(name: str, feature: str) -> None:
    @query(name, f"WITH {sql_feature_ctes(keys='doc_id, lang')} SELECT doc_id, {sql_features([feature])} FROM feats")
    def one(spark, root):
        out = text_features(texts(spark, root)).select("doc_id", feature)
        return rounded(out, feature) if FEATURE_TYPES[feature] == "double" else out


for _name, _feature in NAMES.items():
    _register(_name, _feature)


LEXICON_SQL = "lex(word, valence) AS (VALUES " + ", ".join(f"('{w}', {v}::DOUBLE)" for w, v in wl.DEFAULT_LEXICON.items()) + ")"


@query("h11_sentiment_score", f"""WITH {LEXICON_SQL}, {sql_feature_ctes(keys='doc_id, lang')},
s AS (SELECT doc_id, sum(valence) AS s FROM (SELECT doc_id, unnest(words) AS word FROM _parts) w JOIN lex ON w.word = lex.word GROUP BY doc_id)
SELECT d.doc_id, {sr('coalesce(s / sqrt(s * s + 15.0), 0)')} AS sentiment_score FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id""")
def h11(spark, root):
    lexicon = spark.createDataFrame(list(wl.DEFAULT_LEXICON.items()), "word string, valence double")
    return rounded(sentiment(texts(spark, root), "doc_id", "text", lexicon), "sentiment_score")


@query("h15_text_features", f"WITH {sql_feature_ctes(keys='doc_id, lang')} SELECT doc_id, lang, {sql_features()} FROM feats")
def h15(spark, root):
    return rounded_features(text_features(texts(spark, root)).select("doc_id", "lang", *T.FEATURES))
