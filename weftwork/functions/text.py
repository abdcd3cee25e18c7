"""Text expressions: Column in, Column out, all built-in so they stay in the JVM.

Word and space classes are spelled out because ``\\w``, ``\\s`` and ``\\b`` are ASCII-only in
Java regular expressions while the results must follow Unicode.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from weftwork.functions import wordlists as wl

WORD_CHAR = r"\p{L}\p{N}_"
WORD = rf"[{WORD_CHAR}]+"
SPACE_CHAR = r"\t-\r\x1C-\x20\x85\p{Z}"
SPACE = rf"[{SPACE_CHAR}]"
NON_SPACE = rf"[^{SPACE_CHAR}]+"
PUNCT = rf"[^{WORD_CHAR}{SPACE_CHAR}]"
VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöøœùúûüýÿ"
_CONSONANT = rf"[{WORD_CHAR}&&[^{VOWELS}]]"
_START = rf"(?<![{WORD_CHAR}])"
_END = rf"(?![{WORD_CHAR}])"


def strip(c: Column) -> Column:
    """Trim every kind of white space."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def normalize_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, rf"{SPACE}+", " "))


def remove_newlines(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit(""))


def trim_chars(c: Column, n: int) -> Column:
    """The first ``n`` characters."""
    return F.substring(c, 1, n)


def strip_punct(c: Column) -> Column:
    return F.translate(F.lower(c), wl.PUNCTUATION, "")


def strip_accents(c: Column) -> Column:
    """Characters decomposed as Unicode defines it, without combining marks."""
    out = F.translate(c, wl.ACCENTED, wl.UNACCENTED)
    longer = out
    for char, plain in wl.ACCENTED_LONGER.items():  # some fifty characters of a few scripts
        longer = F.replace(longer, F.lit(char), F.lit(plain))
    # one or two ranges first: a class of many characters is slow, and most texts have none near them
    planes = [[c for c in sorted(wl.ACCENTED_LONGER) if (c > "\uffff") == beyond] for beyond in (False, True)]
    near = "".join(f"{some[0]}-{some[-1]}" for some in planes if some)
    return F.when(out.rlike(f"[{near}]") & out.rlike(f"[{''.join(wl.ACCENTED_LONGER)}]"), longer).otherwise(out)


def word_count_ws(c: Column) -> Column:
    return F.regexp_count(c, F.lit(NON_SPACE)).cast("bigint")


def split_ws(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({NON_SPACE})"), 1)


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), 1)


def terms(c: Column) -> Column:
    """Lower-cased words of two or more characters, as vectorisers take them."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"([{WORD_CHAR}]{{2,}})"), 1)


def clean_tokens_text(c: Column) -> Column:
    """Non-word characters to spaces, lone ASCII letters out, spaces collapsed, lower case."""
    c = F.regexp_replace(c, rf"[^{WORD_CHAR}]", " ")
    c = F.regexp_replace(c, r" +[a-zA-Z] +", " ")
    return F.lower(F.regexp_replace(c, " +", " "))


def tokenize(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def remove_stop_digits(tokens: Column, stop: Sequence[str]) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*stop) & ~t.rlike(r"^\p{Nd}+$"))


def stem(token: Column, suffixes: Sequence[str], keep: int = 3) -> Column:
    """Cut the longest listed suffix that leaves at least ``keep`` characters."""
    longest_first = sorted(suffixes, key=lambda s: (-len(s), s))
    return F.regexp_replace(token, rf"^(.{{{keep},}}?)(?:{'|'.join(longest_first)})$", "$1")


def stem_tokens(tokens: Column, suffixes: Sequence[str]) -> Column:
    return F.transform(tokens, lambda t: stem(t, suffixes))


# ---- the text features -------------------------------------------------------------------

FEATURES = [
    "word_count", "character_count", "sentence_count", "lexical_diversity", "avg_sentence_length",
    "avg_word_length", "punctuation_ratio", "flesch_reading_ease", "gunning_fog_index", "grammar_errors",
    "passive_voice_ratio", "predictability_score", "burstiness",
]


def feature_text(c: Column) -> Column:
    """The text all features are taken from: null is empty, line feeds are spaces, ends stripped."""
    return strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))


def sentences(clean: Column) -> Column:
    return F.filter(F.split(clean, "[.!?]+"), lambda s: s.rlike(rf"[^{SPACE_CHAR}]"))


def sentence_count(sents: Column) -> Column:
    return F.greatest(F.size(sents), F.lit(1)).cast("bigint")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def lexical_diversity(ws: Column) -> Column:
    return _ratio(F.size(F.array_distinct(ws)).cast("double"), F.size(ws))


def avg_word_length(ws: Column) -> Column:
    return _ratio(F.length(F.array_join(ws, "")).cast("double"), F.size(ws))


def punctuation_ratio(clean: Column) -> Column:
    return _ratio(F.regexp_count(clean, F.lit(PUNCT)).cast("double"), F.length(clean))


def syllables(clean: Column, n_words: Column) -> Column:
    """Vowel groups, with one for each of the ``n_words`` words that has none."""
    low = F.lower(clean)
    groups = F.regexp_count(low, F.lit(f"[{VOWELS}]+"))
    voiced = F.regexp_count(low, F.lit(rf"{_CONSONANT}*+[{VOWELS}][{WORD_CHAR}]*+"))
    return groups + n_words - voiced


def complex_words(clean: Column) -> Column:
    """Words of three or more vowel groups."""
    group = rf"{_CONSONANT}*+[{VOWELS}]++"
    return F.regexp_count(F.lower(clean), F.lit(rf"{_START}{group}{_CONSONANT}++[{VOWELS}]++{_CONSONANT}++[{VOWELS}][{WORD_CHAR}]*+"))


def burstiness(sents: Column) -> Column:
    """Population std of words per sentence over (mean + 1e-6), from integer sums."""
    sizes = F.transform(sents, lambda s: F.regexp_count(s, F.lit(NON_SPACE)).cast("bigint"))
    ratio = F.aggregate(
        sizes,
        F.struct(F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("q")),
        lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")),
        lambda a: (F.sqrt((F.size(sents) * a["q"] - a["s"] * a["s"]).cast("double")) / F.size(sents))
        / (a["s"].cast("double") / F.size(sents) + F.lit(1e-6)),
    )
    return F.when(F.size(sents) > 0, ratio).otherwise(F.lit(0.0))


def passive_matches(clean: Column) -> Column:
    forms = "|".join(wl.BE_FORMS)
    return F.regexp_count(clean, F.lit(rf"(?i){_START}(?:{forms}){SPACE}+{WORD}ed{_END}"))


def grammar_errors(clean: Column) -> Column:
    phrases = "|".join(wl.GRAMMAR_ERRORS)
    low = F.lower(clean)
    maybe = F.lit(False)
    for p in wl.GRAMMAR_ERRORS:  # a plain search first: most texts hold none
        maybe = maybe | F.contains(low, F.lit(p))
    count = F.regexp_count(low, F.lit(rf"{_START}(?:{phrases}){_END}")).cast("bigint")
    return F.when(maybe, count).otherwise(F.lit(0).cast("bigint"))


# ---- n-grams inside one row --------------------------------------------------------------


def ngrams(tokens: Column, n: int) -> Column:
    """Word n-grams joined by a blank; empty when there are fewer than ``n`` tokens."""
    if n == 1:
        return tokens
    return F.when(
        F.size(tokens) >= n,
        F.transform(
            F.sequence(F.lit(1), F.size(tokens) - F.lit(n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), " ")
        ),
    ).otherwise(F.array().cast("array<string>"))


def _windows(s: Column, n: int) -> Column:
    return F.when(
        F.length(s) >= n,
        F.transform(F.sequence(F.lit(1), F.length(s) - F.lit(n - 1)), lambda i: F.substr(s, i, F.lit(n))),
    ).otherwise(F.array().cast("array<string>"))


def char_ngrams(c: Column, lo: int, hi: int) -> Column:
    """All character n-grams of the text, runs of white space read as one blank."""
    s = F.regexp_replace(c, rf"{SPACE}{SPACE}+", " ")

    def cut(chars: Column, n: int) -> Column:
        places = F.sequence(F.lit(1), F.size(chars) - F.lit(n - 1))
        windows = F.transform(places, lambda i: F.array_join(F.slice(chars, i, n), ""))
        return F.when(F.size(chars) >= n, windows).otherwise(F.array().cast("array<string>"))

    # Cut into characters once, bound by a lambda: a place in an array is reached directly, one in a
    # string by counting from its start.
    return F.flatten(F.transform(F.array(F.split(s, "")), lambda chars: F.concat(*[cut(chars, n) for n in range(lo, hi + 1)])))


def word_char_ngrams(c: Column, lo: int, hi: int) -> Column:
    """Character n-grams inside words, each word padded with one blank on both sides.

    A padded word no longer than ``n`` gives itself once and no longer n-grams.
    """

    def of_word(p: Column) -> Column:
        short = F.when(F.length(p) < lo, F.array(p)).otherwise(F.array().cast("array<string>"))
        return F.concat(short, *[_windows(p, n) for n in range(lo, hi + 1)])

    padded = F.transform(split_ws(c), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, of_word))
