"""Word lists. Fixed values; stop words come from the lists Spark ships."""

from __future__ import annotations

import os
import sys
from functools import lru_cache
from pathlib import Path
from zipfile import ZipFile

import pyspark

# Punctuation removed from dialogue lines (ASCII punctuation, apostrophe kept).
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

# Forms of "to be" that open a passive phrase.
BE_FORMS = ["is", "are", "was", "were", "be", "been", "being"]

# Phrases counted as grammar errors.
GRAMMAR_ERRORS = ["ain't", "could of", "should of", "would of"]

# Default valences for the sentiment score; callers may pass any (word, valence) table.
DEFAULT_LEXICON = {
    "good": 1.9, "great": 3.1, "happy": 2.7, "love": 3.2, "excellent": 2.7, "nice": 1.8, "best": 3.2,
    "kind": 2.4, "help": 1.7, "thanks": 1.9, "fine": 0.8, "hope": 1.9, "win": 2.8, "safe": 1.9,
    "bad": -2.5, "worst": -3.1, "hate": -2.7, "awful": -2.0, "stupid": -2.4, "worthless": -1.9,
    "idiot": -2.3, "ugly": -2.3, "kill": -3.7, "pain": -2.3, "sad": -2.1, "wrong": -2.1, "lose": -1.1,
    "fear": -2.2, "angry": -2.3, "trash": -1.5, "disgusting": -2.4, "pathetic": -2.7,
}

# Suffixes cut by the rule stemmer, per language; the longest that leaves three characters wins.
SUFFIXES = {
    "english": ["ations", "ation", "ments", "ment", "ness", "ings", "ing", "edly", "ably", "able", "ies", "ed", "ly", "es", "er", "s"],
    "spanish": ["aciones", "amientos", "imientos", "amiento", "imiento", "ación", "mente", "idades", "idad", "adores",
                "ador", "ando", "iendo", "ados", "adas", "idos", "idas", "ado", "ada", "ido", "ida", "ar", "er", "ir",
                "os", "as", "es", "o", "a", "e", "s"],
}

def _accents() -> tuple[str, str, dict[str, str]]:
    """(characters, what each becomes; the longer ones): characters by their canonical decomposition
    without combining marks. Marks alone become nothing; their characters are the last of the first
    text, beyond the length of the second. Hangul syllables are left whole."""
    import unicodedata

    letters, gone, longer = {}, [], {}
    for code in [*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x30000)]:
        char = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFD", char) if not unicodedata.combining(c))
        if not plain:
            gone.append(char)
        elif len(plain) > 1:
            longer[char] = plain
        elif plain != char:
            letters[char] = plain
    return "".join([*letters, *gone]), "".join(letters.values()), longer


ACCENTED, UNACCENTED, ACCENTED_LONGER = _accents()


def _jar_folders():
    """Folders that may hold Spark's jars: beside PySpark (also where it is loaded from a zip below
    Spark's home), in SPARK_HOME, and in any PySpark on the path."""
    yield from (parent / "jars" for parent in Path(pyspark.__file__).resolve().parents)
    if home := os.environ.get("SPARK_HOME"):
        yield Path(home) / "jars"
    yield from (Path(entry) / "pyspark" / "jars" for entry in sys.path)


@lru_cache(maxsize=None)
def stopwords(language: str) -> tuple[str, ...]:
    """The stop-word list Spark's StopWordsRemover loads, sorted; read from the jar, without a JVM."""
    jar = next((j for d in _jar_folders() if d.is_dir() for j in sorted(d.glob("spark-mllib_*.jar"))), None)
    if jar is None:
        raise FileNotFoundError("spark-mllib jar: set SPARK_HOME to the Spark installation")
    with ZipFile(jar) as z:
        words = z.read(f"org/apache/spark/ml/feature/stopwords/{language}.txt").decode("utf-8").split("\n")
    return tuple(sorted({w.strip() for w in words if w.strip()}))
