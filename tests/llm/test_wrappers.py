"""Wrappers of hosts whose pages differ."""

import random

from weftwork.llm import wrappers
from weftwork.llm.wrappers import extract_pages, infer_slots

PAGE = "<body><div><ul><li>News</li><li>Sport</li></ul></div><div><h1>T{0}</h1><p>story {0} is long enough to hold most of the text that there is on page {0}</p>{1}</div></body>"


def texts(spark, sources):
    rows = [(i, f"http://w.org/{i}", s) for i, s in enumerate(sources)]
    return [r.text for r in extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).orderBy("page_id").collect()]


def test_places_do_not_depend_on_how_much_the_pages_differ(spark):
    """A page of thousands of elements that no other has leaves the host its wrapper: the same words at
    another place are text."""
    sources = [PAGE.format(i, "<ul><li>Sport</li><li>own</li></ul>" if i == 0 else "") for i in range(6)]
    story = "story {0} is long enough to hold most of the text that there is on page {0}"
    want = [f"T{i} " + story.format(i) + (" Sport own" if i == 0 else "") for i in range(6)]
    letters = "abcdefghijklmnopqrst"
    names = [a + b + c for a in letters for b in letters for c in letters][:2500]
    odd = "<body>" + "".join(f"<section class=q{n}></section>" for n in names) + "<p>odd</p></body>"
    assert texts(spark, sources) == want
    assert texts(spark, [*sources, odd]) == [*want, "odd"]


def test_wrappers_do_not_depend_on_rounds(spark, monkeypatch):
    """Streams are folded in one order, however many a round takes, and all of them fit."""
    rng = random.Random(2)
    blocks = [f"<div class={c}><p>{c} of all pages</p></div>" for c in "abcdefgh"]
    sources = ["<body>" + "".join(rng.sample(blocks, rng.randint(5, 8))) + f"<p>page {i}</p></body>" for i in range(40)]
    pages = spark.createDataFrame([("w" if i % 5 else "v", s) for i, s in enumerate(sources)], "host string, html string")
    slots = lambda part: {r.host: (r.codes, sorted(r.template or []), r.region) for r in infer_slots(pages, part=part).collect()}
    whole = slots(64)
    assert slots(5) == whole
    monkeypatch.setattr(wrappers, "LONGEST", 30)
    assert slots(64) == whole
    for i, s in enumerate(sources):
        codes = whole["w" if i % 5 else "v"][0]
        tokens, inside = wrappers.stream_of(s)
        rest = iter(codes)
        assert all(wrappers.token_code(t) in rest for t in tokens if wrappers.token_code(t) in set(codes))
        assert max(wrappers.places_in((tokens, inside), codes)) < len(codes)
