"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftwork.llm.credentials import fit_formats, secret_spans
from weftwork.llm.decontaminate import contamination
from weftwork.llm.exact_dedup import exact_dedup
from weftwork.llm.license_scan import license_matches
from weftwork.llm.line_dedup import line_dedup
from weftwork.llm.prefix_trie import prefix_trie, turn_digests, with_heads
from weftwork.llm.simhash import simhash_components
from weftwork.llm.spelling import spelling_variants, word_counts
from weftwork.llm.token_files import read_tokens, token_folder, write_tokens
from weftwork.llm.toxicity import toxicity
from weftwork.llm.unigram import encode, load_vocabulary
from weftwork.llm.url_filter import judge_urls
from weftwork.llm.wrappers import extract_pages
from weftwork.session import table, write_once

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file lies; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_simhash")
def op1(spark, root):
    found = simhash_components(table(spark, root, "documents"), words=3, max_bits=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query(
    "op6_exact_dedup",
    """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
)
def op6(spark, root):
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return exact_dedup(table(spark, root, "documents"), carry={"text_sha256": digest})


@query("op8_toxicity")
def op8(spark, root):
    return toxicity(table(spark, root, "documents"), table(spark, root, "labels"))


@query("op3_license_scan")
def op3(spark, root):
    return license_matches(table(spark, root, "documents"))


@query("op4_sentencepiece")
def op4(spark, root):
    """Ids of every document, and whether decoding them gives the text back."""
    vocabulary = load_vocabulary(tokenizer("piece_bpe_32k.model"))
    pieces = encode(table(spark, root, "documents"), vocabulary, verify=True)
    return pieces.select("doc_id", F.size("ids").alias("n_ids"), "ids", "round_trip")


@query("op9_decontaminate")
def op9(spark, root):
    return contamination(table(spark, root, "documents"), table(spark, root, "benchmark"))


@query(
    "op7_line_dedup",
    r"""
WITH l AS (
  SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (f.keeper <> k.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL OR f.keeper = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY k.doc_id""",
)
def op7(spark, root):
    found = line_dedup(table(spark, root, "documents"), min_chars=40, min_docs=5)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op2_token_files")
def op2(spark, root):
    path = token_folder(spark)
    write_tokens(table(spark, root, "documents"), path, tokenizer("byte_bpe_50k.json"), end_id=0)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


#: Fixed values: (verdict, host, path) rules of op10.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@query("op10_url_filter")
def op10(spark, root):
    return judge_urls(table(spark, root, "pages"), URL_RULES)


@query("op5_html_text")
def op5(spark, root):
    return extract_pages(table(spark, root, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query(
    "op13_prefix_trie",
    """
WITH RECURSIVE src AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
conv AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(conv_id::VARCHAR, '')]),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 6 AS h,
    max(pos) AS own
  FROM src GROUP BY conv_id),
heads AS (SELECT c.conv_id, s.pos, s.role, s.text FROM conv c JOIN src s ON s.conv_id = c.conv_id - c.conv_id % 100 AND s.pos <= c.h),
built AS (
  SELECT * FROM heads
  UNION ALL SELECT s.conv_id, s.pos - c.h + least(c.h, coalesce(b.own, 0)), s.role, s.text
  FROM src s JOIN conv c USING (conv_id) LEFT JOIN conv b ON b.conv_id = c.conv_id - c.conv_id % 100 WHERE s.pos > c.h),
len AS (SELECT conv_id, coalesce(max(pos), 0) AS n FROM conv LEFT JOIN built USING (conv_id) GROUP BY conv_id),
pre AS (
  SELECT conv_id, 0::BIGINT AS d, '' AS k, '' AS up, '' AS text, n FROM len
  UNION ALL
  SELECT pre.conv_id, d + 1, sha256(pre.k || '|' || length(b.role) || ':' || b.role || b.text), pre.k, b.text, n
  FROM pre JOIN built b ON b.conv_id = pre.conv_id AND b.pos = d + 1),
node AS (
  SELECT d, k, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * length(any_value(text)) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = n), '')) AS ends_sha256
  FROM pre GROUP BY d, k),
kids AS (SELECT up AS k, d - 1 AS d, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1, 2),
tree AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (d, k)),
sums AS (
  SELECT d, k, up, (n_children = 0)::BIGINT AS leaf, saved, d AS at, k AS who, up AS next FROM tree
  UNION ALL SELECT s.d, s.k, s.up, leaf, s.saved, t.d, t.k, t.up FROM sums s JOIN tree t ON t.d = s.at - 1 AND t.k = s.next WHERE s.at > 0)
SELECT t.conv_id, t.d AS depth, p.conv_id AS parent_conv_id, t.n_convs, t.n_children, sum(s.leaf)::BIGINT AS n_leaves, sum(s.saved)::BIGINT AS saved_tokens, t.ends_sha256
FROM tree t JOIN sums s ON s.at = t.d AND s.who = t.k LEFT JOIN node p ON t.d > 0 AND p.d = t.d - 1 AND p.k = t.up
GROUP BY ALL""",
)
def op13(spark, root):
    turns, convs = with_heads(turn_digests(table(spark, root, "conversations")))
    return prefix_trie(turns, convs)


@query("op11_spelling")
def op11(spark, root):
    return spelling_variants(write_once(word_counts(table(spark, root, "documents"), min_chars=7, min_count=2, slip=31)), factor=10)


@query("op12_secret_scan")
def op12(spark, root):
    docs = table(spark, root, "documents")
    found = secret_spans(docs, fit_formats(docs))
    base = F.filter("spans", lambda s: s["kind"] != "grammar")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))
