"""The registered queries of the subpackage: against SQL, or against brute force on the same table."""

import re
import zlib

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tools.check import compare, duck
from weftwork.llm import registered
from weftwork.llm.decontaminate import Settings, least_edits_by_bits, split_words

Q = registered.QUERIES


@pytest.fixture(scope="module")
def con(root):
    return duck(root)


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(registered.SQL))
def test_matches_sql(spark, root, con, name):
    assert compare(Q[name](spark, root), con, registered.SQL[name]) is None


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if votes[b] * 2 > len(shingles))


def brute_components(prints, most=2):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= most:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_op1(spark, root, docs):
    prints = {d: fingerprint(t) for d, t in docs}
    groups = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in Q["op1_simhash"](spark, root).collect()}
    assert got == {d: (f"{prints[d]:016x}", groups[d]) for d in prints}


def test_op2(spark, root, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(registered.tokenizer("byte_bpe_50k.json"))
    want, at = [], 0
    for d, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in Q["op2_token_files"](spark, root).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


def test_op3(spark, root, docs):
    from weftwork.llm.license_texts import STATEMENTS

    got = {(r.doc_id, r.license) for r in Q["op3_license_scan"](spark, root).filter("coverage = 1").collect()}
    for d, text in docs:
        for name, statement in STATEMENTS.items():
            found = " ".join(split_words(statement)) in " ".join(split_words(text))
            assert not found or (d, name) in got


def test_op4(spark, root, docs):
    rows = Q["op4_sentencepiece"](spark, root).collect()
    assert len(rows) == len(docs) and all(r.round_trip and r.n_ids == len(r.ids) for r in rows)


def test_op5(spark, root, con):
    import html

    got = {r.page_id: (r.url, r.text, r.n_chars) for r in Q["op5_html_text"](spark, root).collect()}
    for page, url, source in con.execute("SELECT page_id, url, html FROM pages").fetchall():
        inner = re.sub(r"</?(p|h1|br)>", " ", re.search("<article>(.*)</article>", source, re.S)[1])
        text = " ".join(html.unescape(re.sub("<[^>]*>", "", inner)).split())
        assert got[page] == (url, text, len(text))


def test_op8(spark, root, con):
    """Held-out accuracy, over the tables of the next size, where labels suffice to learn from."""
    big = root.replace("0.001", "0.1")
    got = {r.doc_id: r for r in Q["op8_toxicity"](spark, big).collect()}
    labels = duck(big).execute("SELECT doc_id, toxic FROM labels").fetchall()
    held = [(got[d], y) for d, y in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(r.held_out for r, _ in held) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert sum(r.predicted == y for r, y in held) / len(held) > 0.95


def test_op9(spark, root, con, docs):
    """Both ways, over whole texts: every match of brute force is found, and nothing else."""
    s = Settings()
    got = {(r.doc_id, r.item_id): r.edits for r in Q["op9_decontaminate"](spark, root).collect()}
    want = {}
    split = {d: split_words(t) for d, t in docs}
    held = {d: set(w) for d, w in split.items()}
    for item, text in con.execute("SELECT item_id, text FROM benchmark").fetchall():
        words = split_words(text)
        k = int((1 - s.similarity) * len(words) + 1e-9)
        bits = {w: sum(1 << i for i, x in enumerate(words) if x == w) for w in words}
        for d, mine in split.items():
            if sum(w in held[d] for w in words) >= len(words) - k:  # as many of its words must be there
                edits, _ = least_edits_by_bits(bits, len(words), mine)
                if edits <= k:
                    want[d, item] = edits
    assert got == want and want


def test_op10(spark, root, con):
    def judge(url):
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match("[^/?#]*", rest)[0]
            path = re.match("[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fits = [(len(h + p), h + p, v) for v, h, p in registered.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, *((max(fits)[1], max(fits)[2]) if fits else (None, "allow"))  # no page links to another host here

    rows = Q["op10_url_filter"](spark, root).collect()
    urls = dict(con.execute("SELECT page_id, url FROM pages").fetchall())
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows} == {p: judge(u) for p, u in urls.items()}


def test_pipeline(spark, root, docs):
    """Each stage against brute force on what the stage before kept."""
    import tempfile

    folder, df, before = tempfile.mkdtemp(), spark.read.parquet(f"{root}/documents.parquet"), dict(docs)
    columns = df.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, df, root).write.parquet(f"{folder}/{k}")
        df = spark.read.parquet(f"{folder}/{k}")
        kept = {r.doc_id for r in df.select("doc_id").collect()}
        if name == "exact_dedup":
            last = {t: d for d, t in sorted(before.items())}
            assert kept == set(last.values())
        elif name == "simhash_near_dedup":
            groups = brute_components({d: fingerprint(t) for d, t in before.items()})
            assert kept == set(groups.values())
        elif name == "benchmark_decontamination":
            found = {r.doc_id for r in Q["op9_decontaminate"](spark, root).collect()}
            assert kept == set(before) - found
        if k < len(corpus_pipeline.STAGES) - 1:
            assert df.columns == columns
        before = {d: t for d, t in before.items() if d in kept}
    assert corpus_pipeline.run(spark, root).count() == len(before)


def test_token_files_read_names_of_added_tokens_as_the_library_does(spark, tmp_path):
    from tokenizers import Tokenizer

    from weftwork.llm.token_files import read_tokens, write_tokens

    path = registered.tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "a  <|endoftext|>  ", "x<|endoftext|><|endoftext|> y z", "plain <|endof text", None, "", "a" * 70_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    write_tokens(df, f"{tmp_path}/files", path, end_id=0)
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in read_tokens(spark, f"{tmp_path}/files").collect()}
    assert got == {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
