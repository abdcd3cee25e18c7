"""A training corpus from raw documents, in stages that are written and read again.

Toxic documents go, then exact copies, near copies and documents that hold benchmark items; what is
left is encoded, and decoded again to see that it gives the text back. Each stage takes (spark,
docs, sf_dir) and works on all rows of the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftwork.llm.decontaminate import drop_contaminated
from weftwork.llm.exact_dedup import drop_copies
from weftwork.llm.simhash import drop_near_copies
from weftwork.llm.toxicity import drop_toxic
from weftwork.llm.unigram import encode, load_vocabulary
from weftwork.session import table, write_once


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs, words=3, max_bits=2)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = encode(docs, load_vocabulary(vocabulary_path()), carry=["doc_id", "lang", "source"], verify=True)
    return pieces.select("doc_id", "lang", "source", F.size("ids").alias("n_ids"), "ids", "round_trip")


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("sentencepiece", encoded),
]

#: Trained scores, fingerprints and lattices are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = write_once(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
