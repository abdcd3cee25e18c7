"""Nulls, empty and long texts, ties, repeated rows, empty tables, and columns with clashing names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftwork.llm.decontaminate import contamination, drop_contaminated
from weftwork.llm.exact_dedup import drop_copies, exact_dedup
from weftwork.llm.license_scan import license_matches
from weftwork.llm.line_dedup import line_dedup
from weftwork.llm.registered import URL_RULES, tokenizer
from weftwork.llm.simhash import drop_near_copies, simhash_components
from weftwork.llm.token_files import read_tokens, token_folder, write_tokens
from weftwork.llm.toxicity import drop_toxic, toxicity
from weftwork.llm.unigram import decode, encode, load_vocabulary
from weftwork.llm.url_filter import judge_urls
from weftwork.llm.wrappers import extract_pages

LINE = "this line is longer than forty characters, I think"
LONG = " ".join(f"w{i % 977} x{i}" for i in range(60_000))
TEXTS = [
    (1, None), (2, ""), (3, "  \t "), (4, "same"), (5, "same"), (5, "same"), (None, "same"), (None, "alone"), (6, LONG), (7, LONG),
    *[(10 + i, f"{LINE}\nown {i}\n {LINE.upper()} ") for i in range(6)], (20, "stupid idiot words here"), (21, "naïve ▁ 😀\x00"),
]
BENCH = [(1, "one two three four five six seven eight nine ten"), (2, None), (3, "short"), (4, "")]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    extra = {c: F.lit(7) for c in ("n", "key", "fp", "kept", "id", "keep_id", "score", "host", "ids", "component_id", "shard", "lang", "source", "n_chars")}
    return plain.withColumns(extra)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("doc_id = -1")


@pytest.fixture(scope="module")
def vocabulary():
    return load_vocabulary(tokenizer("piece_bpe_32k.model"))


def test_exact(docs, none):
    rows = {(r.doc_id, r.keep_id): r for r in exact_dedup(docs).collect()}
    assert exact_dedup(docs).count() == len(TEXTS) and exact_dedup(none).count() == 0
    assert rows[1, 2].group_size == 2 and not rows[1, 2].kept and rows[2, 2].kept
    assert rows[4, 5].group_size == 4 and rows[5, 5].kept and not rows[None, 5].kept
    assert rows[None, None].kept and rows[6, 7].group_size == 2
    kept = drop_copies(docs)
    assert kept.columns == docs.columns and kept.filter("text = 'same'").count() == 2  # the repeated row stays with its like


def test_simhash(docs, none):
    rows = simhash_components(docs).collect()
    assert len(rows) == len(TEXTS) and simhash_components(none).count() == 0
    of = {r.doc_id: r.component_id for r in rows if r.doc_id}
    assert of[1] == of[2] == of[3] == 1 and of[5] == 4 and of[7] == 6
    assert {r.component_id for r in rows if r.doc_id is None} == {4, None}
    assert drop_near_copies(docs).columns == docs.columns


def test_simhash_hot_bucket(spark):
    """A large bucket gives the same components as pairs do."""
    import random

    from tests.llm.test_queries_llm import brute_components
    from weftwork.llm.components import components
    from weftwork.llm.simhash import links

    rng = random.Random(5)
    seeds = [rng.getrandbits(63) for _ in range(4)]
    prints = sorted({s ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 4))) for s in seeds for _ in range(60)})
    fps = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    for most in (1, 2):
        want = {p: g for p, g in brute_components({p: p for p in prints}, most).items()}
        for bucket in (2, 64):
            got = {r.node: r.root for r in components(links(fps, most, bucket)).collect()}
            assert {p: got.get(p, p) for p in prints} == want


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(4, 0), (4, 1), (None, 1), (6, None), (20, 1), (10, 0), (11, 0)], "doc_id bigint, toxic int")
    for labelled in (labels, labels.filter("toxic = 1"), labels.filter("toxic > 5")):
        rows = toxicity(docs, labelled).collect()
        assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity(none, labels).count() == 0
    assert drop_toxic(docs, labels.filter("toxic > 5")).count() == len(TEXTS)
    assert drop_toxic(docs, labels).columns == docs.columns


def test_sample_passes_over_what_does_not_fit(spark):
    from weftwork.llm.toxicity import Settings, labelled_sample

    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")

    def sample(giant):
        texts = [(i, "x" * 5000 if f"doc {i}" == giant else f"doc {i}") for i in range(40)]
        return labelled_sample(spark.createDataFrame(texts, "doc_id bigint, text string"), labels, settings=Settings(sample_chars=3000))

    texts, toxic = sample(None)
    assert set(toxic) == {0, 1} and len(texts) > 20
    assert sample(texts[0]) == (texts[1:], toxic[1:])


def test_last_stage_decodes(spark, docs, root):
    name, stage = corpus_pipeline.STAGES[-1]
    rows = stage(spark, docs.select("doc_id", "text", "lang", "source", "n_chars"), root).collect()
    assert len(rows) == len(TEXTS) and all(r.round_trip for r in rows)


def test_decontaminate(spark, docs, none):
    bench = spark.createDataFrame(BENCH, "item_id bigint, text string")
    leak = spark.createDataFrame([(30, "x ONE two three, four five six seven eight nine ten. y"), (31, "one two five six seven eight nine ten"), (32, "one two three four")], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in contamination(leak.union(docs.select("doc_id", "text")), bench).collect()}
    assert got == {(30, 1): 0, (31, 1): 2}
    assert contamination(none, bench).count() == 0 and contamination(docs, bench.filter("item_id < 0")).count() == 0
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS)


def test_recall_of_lsh():
    """Items with as many edits as allowed are found at the target recall."""
    import random

    from weftwork.llm.decontaminate import Settings, build_index, find_items

    rng, s, hit = random.Random(1), Settings(), 0
    items = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(30))) for i in range(200)]
    index = build_index(items, s)
    for number, (_, text) in enumerate(items):
        words = text.split()
        for _ in range(6):
            at, kind = rng.randrange(len(words)), rng.randrange(3)
            words[at : at + (kind != 0)] = [] if kind == 1 else [f"n{rng.randrange(99)}"]
        hit += any(f[0] == number for f in find_items("a b c " + " ".join(words) + " d e", index))
    assert hit / len(items) >= 0.95


def test_all_kinds_of_edits_are_found():
    """Items with as many edits of one kind as allowed, followed by words of the document, are all found."""
    import random

    from weftwork.llm.decontaminate import Settings, build_index, find_items, least_edits, least_edits_by_bits

    rng, number = random.Random(4), 0
    items = [(i, " ".join(f"w{rng.getrandbits(40)}" for _ in range(20 + i % 100))) for i in range(300)]
    index = build_index(items, Settings())
    for kind in ("deleted", "inserted", "changed"):
        for number, (_, text) in enumerate(items):
            words = text.split()
            k = index.edits[number]
            for at in sorted(rng.sample(range(1, len(words) - 1), k), reverse=True):
                words[at : at + (kind != "inserted")] = [] if kind == "deleted" else [f"n{rng.getrandbits(40)}"]
            around = [f"d{rng.getrandbits(40)}" for _ in range(60)]
            assert [f[:2] for f in find_items(" ".join(around[:30] + words + around[30:]), index)] == [(number, k)]
    for _ in range(500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(1, 70))] for _ in range(2))
        bits = {w: sum(1 << i for i, x in enumerate(a) if x == w) for w in a}
        assert least_edits_by_bits(bits, len(a), b) == least_edits(a, b, len(a))


def test_sentencepiece(docs, none, vocabulary):
    e = encode(docs.select("doc_id", "text"), vocabulary, carry=["doc_id", "text"])
    back = decode(e, vocabulary, carry=["doc_id", "text"]).collect()
    assert len(back) == len(TEXTS) and all(r.decoded == (r.text or "") for r in back)
    assert encode(none, vocabulary).count() == 0


def test_viterbi_against_brute_force(vocabulary):
    import random
    from functools import lru_cache

    from weftwork.llm.unigram import Encoder

    encoder, rng = Encoder(vocabulary), random.Random(3)
    score = {vocabulary.pieces[i]: vocabulary.scores[i] for i in vocabulary.ordinary}
    for _ in range(400):
        text = "".join(rng.choice(["the", "ing", " ", "é", "ción", "qu", "x", ".", "ß", "tion", "a", "  ", "###"]) for _ in range(rng.randint(1, 9)))
        marked = "▁" + text.replace(" ", "▁")

        @lru_cache(None)
        def best(i):
            return 0.0 if i == 0 else max(best(j) + score[marked[j:i]] for j in range(max(0, i - 20), i) if marked[j:i] in score)

        ids, _ = encoder.encode([text])
        assert abs(sum(vocabulary.scores[i] for i in ids) - best(len(marked))) < 1e-6


def test_token_files(spark, docs, none):
    for df, n in ((docs, len(TEXTS)), (none, 0)):
        path = token_folder(spark)
        write_tokens(df, path, tokenizer("byte_bpe_50k.json"))
        rows = sorted(read_tokens(spark, path).collect(), key=lambda r: r.start)
        assert len(rows) == n and all(len(r.ids) == 4 * r.n_tokens for r in rows)
        assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
        assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda d: (d is not None, d or 0))


def test_damaged_block():
    import numpy as np

    from weftwork.llm.token_files import _DOC, Coder, pack_block, scaled, unpack_block

    ids = np.random.default_rng(0).zipf(1.4, size=70_000)[:65_536] % 3000
    coder = Coder(scaled(np.bincount(ids, minlength=3000)))
    data = pack_block(coder, ids, np.array([(5, 0, len(ids), 0)], _DOC))
    assert (unpack_block(coder, data)[0] == ids).all()
    with pytest.raises(ValueError):
        unpack_block(coder, data[:5000] + b"?" + data[5001:])


def test_lines(docs, none):
    rows = line_dedup(docs).collect()
    assert len(rows) == len(TEXTS) and line_dedup(none).count() == 0
    of = {r.doc_id: r for r in rows}
    assert (of[1].n_lines, of[1].kept, of[2].n_lines) == (1, "", 1)
    assert of[10].n_dropped == 2 and of[10].kept == "own 0" and of[15].n_dropped == 0


def test_line_index_in_blocks(docs):
    from weftwork.llm import line_dedup as module

    whole = sorted((r.doc_id or 0, r.n_dropped, r.kept) for r in line_dedup(docs, min_chars=1, min_docs=1).collect())
    keys, module.SHARD_KEYS = module.SHARD_KEYS, 2
    try:
        assert sorted((r.doc_id or 0, r.n_dropped, r.kept) for r in line_dedup(docs, min_chars=1, min_docs=1, block_bytes=2000).collect()) == whole
    finally:
        module.SHARD_KEYS = keys


def test_perfect_hash():
    import numpy as np

    from weftwork.llm.line_dedup import PerfectHash

    rng = np.random.default_rng(1)
    a, b = rng.integers(-(2**63), 2**63 - 1, (2, 20_000))
    assert sorted(PerfectHash.build(a, b).slots(a, b).tolist()) == list(range(20_000))


def test_licenses(spark, docs, none):
    text = "before. Permission to use, copy, modify, and/or distribute this software for any purpose with or without a fee is hereby granted, provided that the above copyright notice and this permission notice appear in every copies. after"
    rows = license_matches(spark.createDataFrame([(1, text), (2, text + " " + text), (3, None)], "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.license) for r in rows) == [(1, "ISC"), (2, "ISC"), (2, "ISC")] and all(0.8 <= r.coverage < 1 for r in rows)
    assert license_matches(docs).count() == 0 and license_matches(none).count() == 0


def test_licenses_with_inserted_words(spark):
    texts = {
        1: "x Licensed under the terms of the Apache License, Version 2.0 y", 2: "It was released by us in 2010 under the well known MIT License.",
        3: "Licensed under CC BY 4.0", 4: "Released under the BSD License.", 5: "This work is licensed under the GNU General Public License, version 2",
        6: "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        7: "This work is licensed under the GNU Lesser General Public License, version 3", 8: "Released under the MIT License. Released under the MIT License.",
        9: "This work is licensed under the terms of the GNU General Public License, version 3",
    }
    rows = license_matches(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    got = sorted((r.doc_id, r.license, r.coverage, r.first_word) for r in rows)
    assert got == [(1, "Apache-2.0", 1.0, 1), (2, "MIT", 1.0, 2), (6, "CC-BY-SA-4.0", 1.0, 0), (8, "MIT", 1.0, 0), (8, "MIT", 1.0, 5), (9, "GPL-3.0", 1.0, 0)]


def test_pages(spark):
    side = '<body><div id="top"><ul><li><a href="/x">x</a></li></ul></div><div id="content"><h1>T &amp; U</h1><div class="post"><p>a{0} <b>bo</b>ld  and\n more &nbsp;text, long enough to be the main part of it all<p>second{0}</div><div class="comments"><p>a comment</div></div><div class="sidebar">z</div><form>f</form><script>"</p>"</script></body>'
    pages = [(i, f"http://s.org/{i}", side.format(i)) for i in range(5)] + [(9, None, None), (10, "nohost", ""), (11, "http://s.org/x", "<p>only this"), (12, "http://q.org", "<")]
    rows = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("host", F.lit(1))).collect()}
    assert rows[3] == "T & U a3 bold and more text, long enough to be the main part of it all second3"
    assert rows[9] == rows[10] == "" and rows[11] == "only this" and rows[12] == "<"
    assert extract_pages(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_self_closed_and_unclosed_elements():
    from weftwork.llm.wrappers import main_text

    for icon in ('<svg class="i"/>', "<math/>", '<object data="x" />', "<iframe src='y'/>"):
        assert main_text(f"<div><p>one {icon}two</p><p>three</p><svg><title>t</title></svg></div>", "") == "one two three"
    for name in ("svg", "object", "select", "iframe", "noscript", "template"):
        assert main_text(f"<div><p>one</p><span><{name}><i>in</span><p>two</p><{name}>in</{name}></div>", "") == "one two"
        assert main_text(f"<p>one<{name}><p>two", "") == "one two"  # nothing ends it
    assert main_text("<p>one</p><object data=a/>in</object><script>x<p>y", "") == "one"


def test_template_slots(spark):
    """What most pages of a host have word for word is no main text, whatever its class; copies count once."""
    page = '<body><div class="q1"><p>Our menu of today and all the other days of the week</p></div><div class="q2"><h1>Title</h1><p>{}</p><p>{}</p></div></body>'
    own = [f"story {i} is long enough to hold most of the text there is on this page, number {i}" for i in range(4)]
    pages = [(i, f"http://t.org/{i}", page.format(own[i], "shared by two" if i < 2 else "")) for i in range(4)]
    pages += [(10 + i, f"http://c.org/{i}", page.format("one story", "")) for i in range(5)]  # copies
    rows = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert [rows[i] for i in range(4)] == ["Title " + own[i] + (" shared by two" if i < 2 else "") for i in range(4)]
    assert all("one story" in rows[10 + i] for i in range(5))


def test_article_text_that_looks_like_something_else(spark):
    """Formulas, forms around a page, classes that share a word with a menu, and paragraphs that the
    pages of a host copy from each other are text of the article."""
    from weftwork.llm.wrappers import main_text

    assert main_text("<p>let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be <math/>given</p>", "") == "let x=2 be given"
    form = "<body><form action=x><div id=nav>menu</div><div><h1>T</h1><p>a page of a server that puts it all into one form</p></div></form></body>"
    assert main_text(form, "") == "T a page of a server that puts it all into one form"
    assert main_text("<body><p>a page with some text of its own, and a form</p><form>name and password</form></body>", "") == "a page with some text of its own, and a form"
    classes = '<article><h1>T</h1><p class="related-work">one</p><div class="share-price">two</div><div class="share-buttons">x</div><div class="socialBar">y</div><ul class="nav">z</ul><p>three</p></article>'
    assert main_text(classes, "article") == "T one two three"
    shared = "".join(f"<p>paragraph {i} that three of the four pages have word for word</p>" for i in range(5))
    pages = [(i, f"http://n.org/{i}", f"<body><div class=x>menu</div><article><h1>Title {i}</h1>{shared if i < 3 else ''}<p>Version {i}.</p></article></body>") for i in range(4)]
    pages += [(10 + i, f"http://m.org/{i}", f"<body><div class=x>menu</div><div class=y><h1>Title {i}</h1>{shared if i < 3 else ''}<p>Version {i}, with some more words.</p></div></body>") for i in range(4)]
    rows = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    plain = " ".join(f"paragraph {i} that three of the four pages have word for word" for i in range(5))
    assert [rows[i] for i in range(4)] == [f"Title {i} {plain if i < 3 else ''} Version {i}.".replace("  ", " ") for i in range(4)]
    assert [rows[10 + i] for i in range(4)] == [f"Title {i} {plain if i < 3 else ''} Version {i}, with some more words.".replace("  ", " ") for i in range(4)]


def test_places_of_the_wrapper_tell_constants_from_text(spark):
    """The same words in elements of the same names are template at one place and text at another; the
    wrapper, not the path, tells the places apart."""
    from weftwork.llm.wrappers import fold, places_in, stream_of, token_code

    page = "<body><div class=q1><ul><li>News</li><li>Sport</li></ul></div><div class=q2><h1>T{0}</h1><p>story {0} is long enough to hold most of the text that there is on page {0}</p>{1}</div></body>"
    sources = [page.format(i, "<ul><li>Sport</li><li>own</li></ul>" if i == 0 else "") for i in range(5)]
    rows = {r.page_id: r.text for r in extract_pages(spark.createDataFrame([(i, f"http://w.org/{i}", s) for i, s in enumerate(sources)], "page_id bigint, url string, html string")).collect()}
    story = "story {0} is long enough to hold most of the text that there is on page {0}"
    assert rows == {i: f"T{i} " + story.format(i) + (" Sport own" if i == 0 else "") for i in range(5)}
    streams = [stream_of(s) for s in sources]
    wrapper = [token_code(t) for t, _ in fold([[[t, False] for t in streams[1][0]], [[t, False] for t in streams[0][0]]])]
    first, second = places_in(streams[0], wrapper), places_in(streams[1], wrapper)
    assert first[:4] == second[:4] and len(first) == 6 and first[4] == first[5] > first[3]
    assert max(first) < len(wrapper)


def test_alignment_and_hosts_without_a_template(spark, monkeypatch):
    import random

    from weftwork.llm import wrappers

    def longest(a, b):
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
        return rows[-1][-1]

    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 30))] for _ in range(2))
        pairs = wrappers.common(np.array([ord(x) for x in a]), np.array([ord(x) for x in b]))
        assert len(pairs) == longest(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        both = [t for t, _ in wrappers.align([[x, False] for x in a], [[x, False] for x in b])]
        for w in (a, b):  # the wrapper has every stream in it
            it = iter(both)
            assert all(x in it for x in w)
    monkeypatch.setattr(wrappers, "LONGEST", 12)
    page = "<body><div class=q1><p>Our menu of today</p></div><div><h1>T{0}</h1><p>story {0} is long enough to hold most of the text there is</p></div></body>"
    pages = [(i, f"http://l.org/{i}", page.format(i)) for i in range(4)] + [(9, "http://l.org/9", "".join(f"<h{n}>x</h{n}><table><tr><td>y" for n in range(2, 6)))]
    rows = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert [rows[i] for i in range(4)] == [f"T{i} story {i} is long enough to hold most of the text there is" for i in range(4)]


def test_teasers_in_articles(spark):
    """Article elements replace the page only where they hold most of its text, by host and by page."""
    story = "the story of page {0}, which is told at some length, so that it outweighs what the cards beside it say {0}"
    cards = '<div class="cards"><article>card {0}</article><article>more {0}</article></div>'
    pages = [(i, f"http://t.org/{i}", f'<body><div class="x"><p>{story}</p></div>{cards}</body>'.format(i)) for i in range(4)]
    pages += [(10 + i, f"http://a.org/{i}", f"<body><article><p>{story}</p></article></body>".format(10 + i)) for i in range(9)]
    pages += [(19, "http://a.org/x", f"<body><div><p>{story}</p></div>{cards}</body>".format(19))]
    rows = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert all(story.format(i) in rows[i] for i in [*range(4), *range(10, 20)])


def test_wrapper_alignment():
    from weftwork.llm.wrappers import as_expression, fold, stream_of

    pages = ["<div><p>a<p>b</div>", "<div><p>a</div><div class=x>t</div>", "<div><p>a<p>b<p>c</div>"]
    streams = [[[t, False] for t in stream_of(p)[0]] for p in pages]
    assert streams[0] == streams[2]
    assert as_expression(fold([streams[0], streams[1]])) == "<div> (<p> # </p>)+ </div> ( <div[class=x]> # </div[class=x]> )?"


def test_urls(spark):
    def links(*hosts):
        return "".join(f'<A class="x" href="http://{h}/p">l</A>' for h in hosts)

    pages = [
        (1, "http://bad.net/x", links("bad.net")), (2, "http://a.com/", links("bad.net", "bad2.net")), (3, "http://b.com/", links("good.org")),
        (4, "https://GOOD.org/fr/?q", links("b.com")), (5, None, None), (6, "x.net/y", ""), (7, "http://sub.EXAMPLE.net/en/1#z", ""), (8, "http://bad2.net/a", None),
    ]
    rows = {r.page_id: r for r in judge_urls(spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("fit", F.lit(1)), URL_RULES).collect()}
    assert (rows[1].verdict, rows[1].rule, rows[7].rule, rows[7].verdict) == ("block", "net/", "example.net/en/", "allow")
    assert (rows[4].host, rows[4].path, rows[4].rule) == ("good.org", "/fr/", "org/fr/")
    assert rows[2].verdict == "block" and rows[2].rule is None  # links to blocked hosts only
    assert rows[3].verdict == "allow" and (rows[5].host, rows[5].path, rows[5].verdict) == ("", "", "allow") and rows[6].host == ""
    assert judge_urls(spark.createDataFrame([], "page_id bigint, url string, html string"), URL_RULES).count() == 0


def _judged_hosts(spark, links):
    pages = [(i, f"http://{host}/", "".join(f'<a href="http://{h}/p">l</a>' for h in to)) for i, (host, to) in enumerate(links)]
    return {r.host: r.verdict for r in judge_urls(spark.createDataFrame(pages, "page_id bigint, url string, html string"), URL_RULES).collect()}


def test_blocked_hosts_that_are_only_linked(spark):
    got = _judged_hosts(spark, [("a.com", ["spam.net"]), ("b.com", ["good.org"]), ("d.com", ["x.example.com"])])
    assert got == {"a.com": "block", "b.com": "allow", "d.com": "allow"}


def test_distrust_of_many_linkers(spark):
    """The verdict of a host does not hang on how many others link to the blocked host, or on what that links to."""
    bad = [f"b{i}.net" for i in range(10)]
    links = [*((f"h{i}.com", bad) for i in range(30)), *((f"one{i}.com", ["bad.net"]) for i in range(5)), *((f"few{i}.com", ["bad.net", "p.com", "q.com"]) for i in range(3))]
    for crawled in ([], [("bad.net", ["b0.net"]), ("b0.net", ["bad.net"])]):
        got = _judged_hosts(spark, links + crawled)
        assert all(got[h] == ("allow" if h.startswith("few") else "block") for h in got)


def test_propagation_against_power_iteration(spark):
    import numpy as np

    from weftwork.llm.url_filter import propagate

    rng, n, d = np.random.default_rng(2), 12, 0.7
    w = rng.integers(0, 4, (n, n)).astype(float) * (rng.random((n, n)) < 0.4)
    np.fill_diagonal(w, 0)
    trust, distrust = rng.random(n).round(2), rng.random(n).round(2)
    forth = w / np.maximum(w.sum(1, keepdims=True), 1e-300)
    back = (w / np.maximum(w.sum(0, keepdims=True), 1e-300)).T
    t, b = (1 - d) * trust, (1 - d) * distrust
    for _ in range(20):
        t, b = (1 - d) * trust + d * forth.T @ t, (1 - d) * distrust + d * back.T @ b
    seeds = spark.createDataFrame([(str(i), float(trust[i]), float(distrust[i])) for i in range(n)], "host string, trust double, distrust double")
    edges = spark.createDataFrame([(str(i), str(j), float(w[i, j])) for i in range(n) for j in range(n) if w[i, j]], "src string, dst string, w double")
    got = {r.host: (r.trust, r.distrust) for r in propagate(seeds, edges, d, tolerance=0).collect()}
    assert all(abs(got[str(i)][0] - t[i]) < 1e-9 and abs(got[str(i)][1] - b[i]) < 1e-9 for i in range(n))


def test_stages_on_edges(spark, docs, root):
    kept = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, kept, root).count() >= 0
        assert stage(spark, kept.filter("doc_id = -1"), root).count() == 0


def test_filters_take_any_column_names(spark):
    """Columns named like the filters' own, and like one another, stay what they are."""
    from weftwork.llm.simhash import drop_near_copies
    from weftwork.llm.toxicity import drop_toxic

    rows = [(1, "one two three four five six seven", 0.1, "x"), (2, "one two three four five six seven", 0.2, "y"), (None, "something else altogether here", 0.3, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, __score double, __gone string").withColumns({n: F.lit(n) for n in ("_id", "_row", "_gone", "a.b", "__id", "__text", "fp")})
    bench = spark.createDataFrame([(1, "five six seven eight nine ten eleven")], "item_id bigint, text string")
    labels = spark.createDataFrame([(1, 0), (2, 0)], "doc_id bigint, toxic int")
    near, clean, kind = drop_near_copies(df), drop_contaminated(df, bench), drop_toxic(df, labels)
    assert near.columns == clean.columns == kind.columns == df.columns
    assert sorted(r["__gone"] for r in near.collect()) == ["x", "z"]
    assert clean.count() == 3 and sorted(r["__score"] for r in kind.collect()) == [0.1, 0.2, 0.3]


def test_scripts_without_spaces(spark):
    from weftwork.llm.decontaminate import short_items

    item = "敏捷的棕色狐狸跳过了懒狗的背"
    bench = spark.createDataFrame([(1, item), (2, "too short"), (3, None)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, f"前言{item}后记"), (2, f"x {item[:5]}白{item[6:]} y"), (3, "敏捷的狐狸")], "doc_id bigint, text string")
    assert {(r.doc_id, r.item_id): r.edits for r in contamination(docs, bench).collect()} == {(1, 1): 0, (2, 1): 1}
    assert sorted(r.item_id for r in short_items(bench).collect()) == [2, 3]


def test_tables_of_chunks_are_bounded_in_characters(monkeypatch):
    from weftwork.llm import chunks

    monkeypatch.setattr(chunks, "CHARACTERS", 1000)
    table = chunks.ChunkTable(lambda new: (new, np.zeros(sum(map(len, new)), np.int32), np.array([len(c) for c in new])))
    for i in range(50):
        ids, sizes = table.encode([[f"{i:04d}" * 100], ["x"]])
        assert sizes.tolist() == [400, 1] and len(ids) == 401
        assert table.characters <= 1000 + 401
