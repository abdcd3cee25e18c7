"""Main text of web pages, by wrappers inferred per host.

A page is a stream of tokens: tags and texts. Adjacent repetitions become repeated groups, so that pages
of one template mostly have equal streams. The distinct streams of a host are folded, one after the
other, into a wrapper, a regular expression without unions: streams are aligned, what both have stays,
what only one has becomes an optional group. A token that at most half of a host's pages have is no place
of a constant, so it is left out of the wrapper, which grows with a page and not with the pages. Hosts
with many distinct streams are folded in rounds: streams that the wrapper so far has in order need no
folding. Every stream then runs through its host's wrapper, so that each text of a page stands at a place
of it, alone or in a group, or at one that few pages have.

Texts at one place are compared over a host's distinct pages, in Spark: a text that most of them have word
for word is a constant of the wrapper, any other a text slot. Constants are template and left out, but
for titles and for paragraphs between others of the page's own. Elements that are never main text (by
name, role, class or id) are cut. Of the slots the main region is chosen: the article or main elements
if they hold nearly all of the text outside links, else the deepest element that does. A page with
less of its own text in the region is read as a whole.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections import Counter
from collections.abc import Collection, Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from weftwork.llm.url_filter import host_and_path
from weftwork.session import write_once

# Elements without content, elements whose content is not text of the page, elements
# that never hold main text, elements that do not interrupt a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object select annotation annotation-xml".split())
#: Raw elements whose content has no tags, and those that a slash in the tag closes.
LITERAL = frozenset("script style textarea title".split())
CLOSABLE = frozenset("svg object iframe".split())
NEVER = frozenset("head nav aside footer button dialog menu".split())
FORMS = frozenset("form fieldset".split())
INLINE = frozenset(
    "math semantics mi mn mo ms mtext mspace mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded mtable mtr mtd "
    "a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
# Words in a class or id that mark menus, headers, footers, sidebars, notices, adverts,
# forms and reader comments; roles that do.
MARKED = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer sidebar aside rail widget widgets "
    "notice notices cookie cookies consent gdpr popup modal overlay alert ad ads adv advert adverts advertisement advertising "
    "sponsor sponsored promo promotion banner form login signup subscribe newsletter search share sharing social related "
    "recommended recommendations comment comments commentlist discussion respond replies disqus pagination pager toolbar copyright "
    "topnav mainnav sitenav subnav sidenav mainmenu topmenu leftbar rightbar adbox adslot adsense adunit disclaimer paywall toast".split()
)
#: Words that say nothing beside a marked one: "share buttons" are marked, a "share price" is not.
PLAIN = frozenset("area bar block body box btn button buttons container content count group head heading icon icons inner item items label left link links list main outer panel post posts right section small text title top bottom wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
#: Tokens of streams after which a round of folding ends for a host, to go on with the streams that are
#: still to be folded. They are folded in one order, so that the wrapper does not depend on the rounds.
LONGEST = 65_536
#: The place of texts in a token that few pages have.
RARE = -1
#: The share of the text outside links that a main region holds.
SHARE = 0.8
#: Elements of running text. Lines straight in them are text of the region they stand in.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption".split())
#: Elements that come in runs: one of them is a run of length one.
RUNS = frozenset("p li tr dt dd".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def _words(value: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()) if w]


def _tokens(source: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, value) of all tags and texts; comments and the content of ``LITERAL`` elements are left out."""
    at, end = 0, len(source)
    while at < end:
        m = _TOKEN.match(source, at)
        if m is None:  # a tag that never ends
            return
        at = m.end()
        if m.group(4) is not None:
            yield "text", "", m.group(4)
        elif m.group(2):
            name = m.group(2).lower()
            slash = m.group(3).endswith("/")
            if m.group(1):
                yield "close", name, ""
            elif name in LITERAL:
                closing = re.compile(rf"</{re.escape(name)}[^>]*(?:>|\Z)", re.I).search(source, at)
                at = closing.end() if closing else end
            elif name in RAW:
                if not slash or name not in CLOSABLE or re.search(r"=\s*[^\s\"'>]+$", m.group(3)):  # the slash of an unquoted value closes nothing
                    yield "open", name, ""
            elif name in VOID or slash and name not in INLINE:
                yield "void", name, ""
            else:
                found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(m.group(3))} if m.group(3) else {}
                yield "open", name, " ".join(f"{k}={found[k]}" for k in ("class", "id", "role") if found.get(k))


def _raw_ends(tokens: list[tuple[str, str, str]]) -> dict[int, int]:
    """For each raw element that ends, by the place of its opening tag, the place of the first token
    after it: it ends with its own closing tag or before that of its parent."""
    ends, opened, count = {}, [], Counter()
    for i, (kind, name, _) in enumerate(tokens):
        if kind == "open":
            opened.append((name, i))
            count[name] += 1
        elif kind == "close" and count[name]:
            last = ""
            while last != name:
                last, at = opened.pop()
                count[last] -= 1
                if last in RAW:
                    ends[at] = i + (last == name)
    return ends


def read_page(source: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, value): "open" and "close" of elements, with the signature (class, id, role) as
    value of "open", "void" elements, and "text". Comments and raw elements are left out; of a raw
    element that neither its own closing tag nor its parent's ends, only the tag is."""
    tokens = list(_tokens(source))
    ends = _raw_ends(tokens) if any(name in RAW for kind, name, _ in tokens if kind == "open") else {}
    i = 0
    while i < len(tokens):
        if tokens[i][0] == "open" and tokens[i][1] in RAW:
            i = ends.get(i, i + 1)
        else:
            yield tokens[i]
            i += 1


def is_cut(name: str, signature: str, within: bool, forms: bool = True) -> bool:
    """Whether an element never holds main text; ``within``: it stands in an article or main element,
    where a class must be marked as a whole; ``forms``: forms never hold it."""
    if name in NEVER or name == "header" and not within or forms and name in FORMS:
        return True
    for part in signature.split(" ") if signature else ():
        if part.startswith("role=") and part[5:].lower() in ROLES:
            return True
    names = re.sub(r"(^| )(class|id|role)=", " ", signature)
    words = _words(names)
    # "with-sidebar" and the like speak of a neighbour; an article's own header holds its title
    own = {w for before, w in zip(["", *words], words) if before not in ("has", "with", "no", "without")}
    own |= {a + b for a, b in zip(words, words[1:])}  # side-bar
    if name in ("html", "body", "article", "main"):
        return name == "article" and bool({"comment", "comments", "reply", "replies"} & own)
    if not within:
        return bool(own & MARKED)
    marked = MARKED - {"header", "masthead"}
    for one in names.split():
        parts = _words(one)
        if own & marked and (marked & set(parts) and set(parts) <= marked | PLAIN or "".join(parts) in marked):
            return True
    return False


def _step(name: str, signature: str) -> str:
    """An element in a path: its name and the class and id without digits, which count pages."""
    return name + (f"[{re.sub('[0-9]+', '0', signature)}]" if signature else "")


def walk(source: str, forms: bool = True) -> Iterator[tuple[str, tuple, bool, str]]:
    """(kind, path, cut, value) of a page: "open" and "close" of block elements, "break" and "text".
    The path holds the open block elements; cut says that one of them never holds main text."""
    stack: list[tuple[str, str, bool, bool]] = []  # name, step, cut, within
    path: tuple = ()
    link = 0
    for kind, name, value in read_page(source):
        cut = bool(stack) and stack[-1][2]
        if kind == "text":
            yield ("link" if link else "text"), path, cut, value
        elif kind == "void":
            if name not in INLINE:
                yield "break", path, cut, ""
        elif name in INLINE:
            if name == "a":
                link = max(0, link + 1) if kind == "open" else max(0, link - 1)
        elif kind == "open":
            if name in RUNS or stack and stack[-1][0] == "p":  # these end an open paragraph or item
                while stack and (stack[-1][0] == "p" or stack[-1][0] == name and name in RUNS):
                    yield "close", path, stack[-1][2], stack.pop()[1]
                    path = path[:-1]
            within = bool(stack) and stack[-1][3]
            step = _step(name, value)
            link = 0
            stack.append((name, step, bool(stack) and stack[-1][2] or is_cut(name, value, within, forms), within or name in ("article", "main")))
            path = (*path, step)
            yield "open", path, stack[-1][2], step
        elif any(s[0] == name for s in stack):
            link = 0
            while stack:
                popped = stack.pop()
                yield "close", path, popped[2], popped[1]
                path = path[:-1]
                if popped[0] == name:
                    break
    while stack:
        popped = stack.pop()
        yield "close", path, popped[2], popped[1]
        path = path[:-1]


# ---- streams and wrappers -------------------------------------------------------------------
# A stream is a list of [token, optional]. Tokens: "<step>", "</step>", "#" for a text slot, and
# "(...)+" for a repeated group.


def stream_of(source: str) -> tuple[list[str], list[int]]:
    """The tokens of a page with its repetitions as groups, and the texts in each token."""
    return _stream(walk(source))


def _stream(events: Iterable[tuple[str, tuple, bool, str]]) -> tuple[list[str], list[int]]:
    tokens: list[str] = []
    for kind, _, _, value in events:
        if kind in ("text", "link"):
            if value.strip() and tokens[-1:] != ["#"]:
                tokens.append("#")
        elif kind != "break":
            tokens.append(f"<{value}>" if kind == "open" else f"</{value}>")
    return fold_runs(tokens)


def fold_runs(tokens: list[str]) -> tuple[list[str], list[int]]:
    """Runs of one element (p, li, ...) and adjacent equal elements become repeated groups, inner ones
    first; and the texts in each token that is left."""
    out: list[str] = []
    texts: list[int] = []
    opened: list[tuple[str, int]] = []
    for t in tokens:
        out.append(t)
        texts.append(int(t == "#"))
        if t.startswith("</"):
            step, start = opened.pop() if opened else (t[2:-1], 0)
            element = " ".join(out[start:])
            name = re.split(r"[\[>]", t[2:])[0]
            run = f"({element})+"
            again = out[start - 1 : start] == [run]
            size = len(out) - start
            if name in RUNS or again or " ".join(out[max(0, start - size) : start]) == element:
                before = start if again or name in RUNS else start - size
                inside = sum(texts[before:])
                del out[before:], texts[before:]
                if out[-1:] == [run]:
                    texts[-1] += inside
                else:
                    out.append(run)
                    texts.append(inside)
        elif t.startswith("<"):
            opened.append((t[1:-1], len(out) - 1))
    return out, texts


def token_code(token: str) -> int:
    """A token as a number, for streams that are compared with a wrapper."""
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) - (1 << 31)


def places_in(stream: tuple[list[str], list[int]], wrapper: Sequence[int] | None) -> list[int]:
    """The place in the wrapper (token codes) of each text of a stream, the first way it fits, RARE in
    tokens that the wrapper does not have; 0 without a wrapper. A wrapper has all other tokens of its
    streams in order."""
    tokens, texts = stream
    if wrapper is None:
        return [0] * sum(texts)
    wrapper = np.asarray(wrapper).tolist()
    out, at, known = [], 0, set(wrapper)
    for token, n in zip(tokens, texts):
        code = token_code(token)
        if code not in known:
            out.extend([RARE] * n)
            continue
        while at < len(wrapper) and wrapper[at] != code:
            at += 1
        out.extend([at] * n)
        at += 1
    return out


def _last_row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each beginning of ``b``, the length of its longest common subsequence with ``a``."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0)))
    return row


def common(a: np.ndarray, b: np.ndarray, at: int = 0, to: int = 0) -> list[tuple[int, int]]:
    """The places (in a, in b) of a longest common subsequence, by halving ``a``: no table is kept."""
    same = int((np.cumprod(a[: len(b)] == b[: len(a)])).sum())
    out = [(at + i, to + i) for i in range(same)]
    a, b, at, to = a[same:], b[same:], at + same, to + same
    size = min(len(a), len(b))
    tail = int(np.cumprod((a[len(a) - size :] == b[len(b) - size :])[::-1]).sum()) if size else 0
    ends = [(at + len(a) - tail + i, to + len(b) - tail + i) for i in range(tail)]
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if len(a) == 1 and len(b):
        place = np.flatnonzero(b == a[0])
        out += [(at, to + int(place[0]))] if len(place) else []
    elif len(a) and len(b):
        half = len(a) // 2
        cut = int((_last_row(a[:half], b) + _last_row(a[half:][::-1], b[::-1])[::-1]).argmax())
        out += common(a[:half], b[:cut], at, to) + common(a[half:], b[cut:], at + half, to + cut)
    return out + ends


def align(a: list[list], b: list[list]) -> list[list]:
    """The wrapper of two wrappers: their longest common part, the rest optional."""
    names: dict[str, int] = {}
    codes = [np.array([names.setdefault(t, len(names)) for t, _ in w], np.int32) for w in (a, b)]
    out, i, j = [], 0, 0
    for x, y in [*common(*codes), (len(a), len(b))]:
        out += [[t, True] for t, _ in a[i:x]] + [[t, True] for t, _ in b[j:y]]
        if x < len(a):
            out.append([a[x][0], a[x][1] or b[y][1]])
        i, j = x + 1, y + 1
    return out


def fold(streams: Iterable[list[list]]) -> list[list] | None:
    """The wrapper of many: the most frequent first, in the order given."""
    wrapper = None
    for s in streams:
        wrapper = s if wrapper is None else align(wrapper, s)
    return wrapper


def as_expression(wrapper: list[list]) -> str:
    """A wrapper for reading: optional groups as (...)?."""
    out, optional = [], False
    for token, may in wrapper:
        if may != optional:
            out.append("(" if may else ")?")
            optional = may
        out.append(token)
    return " ".join(out + [")?"] * optional)


# ---- slots ------------------------------------------------------------------------------------


class Line(NamedTuple):
    """A text between two tags that interrupt it: its slot (the path of the elements around it), the
    characters of it in links, the number of the innermost element around that is not one of running
    text, and the number of the stream's text it belongs to."""

    path: tuple
    text: str
    linked: int
    container: int
    number: int


def read_lines(source: str) -> tuple[list[Line], tuple[list[str], list[int]]]:
    """The lines of a page that are not cut, and its stream. Forms are cut, unless they hold nearly all
    of the page, as those that a server puts around it do."""
    events = [*walk(source)]
    lines = _lines_of(events)
    if re.search("<form|<fieldset", source, re.I):
        whole = _lines_of([*walk(source, False)])
        if sum(len(line.text) for line in lines) < (1 - SHARE) * sum(len(line.text) for line in whole):
            lines = whole
    return lines, _stream(events)


def _lines_of(events: list[tuple[str, tuple, bool, str]]) -> list[Line]:
    path, parts, linked, out = (), [], 0, []
    containers, opened, inside = [0], 0, 0  # the container of every open element, the last within
    number, fresh, mine = -1, True, 0
    for kind, at, cut, value in [*events, ("end", (), False, "")]:
        if kind in ("text", "link"):
            if fresh and value.strip():
                number, fresh = number + 1, False
            if not cut:
                path, inside, mine = at, containers[-1], max(number, 0)
                parts.append(html.unescape(value))
                linked += len(" ".join(parts[-1].split())) * (kind == "link")
            continue
        text = " ".join("".join(parts).split())
        if text:
            out.append(Line(path, text, min(linked, len(text)), inside, mine))
        parts, linked = [], 0
        fresh = fresh or kind != "break"
        if kind == "open":
            opened += 1
            containers.append(containers[-1] if re.split(r"[\[]", value)[0] in FLOW else opened)
        elif kind == "close":
            containers.pop()
    return out


def line_key(line: Line, place: int) -> int:
    """A place of the wrapper, slot and text as one number; 0 for a title, which belongs to the main text
    even if all pages share it, and for a text at a place that few pages have."""
    if place == RARE or line.path and re.match(r"h1(\[|$)", line.path[-1]):
        return 0
    return _key(place, xxhash.xxh64_intdigest(">".join(line.path) + "\0" + line.text, 11))


def _key(place: int, digest: int) -> int:
    return xxhash.xxh64_intdigest(f"{place} {digest}", 11) - (1 << 63) or 1


def main_region(sizes: dict[str, list[int]], share: float = SHARE) -> str:
    """The main region of a host: "article" or "main" if such elements hold ``share`` of the text
    outside links, else the path of the deepest element that does, "" for the whole page."""
    total = sum(c - l for c, l in sizes.values())
    if total <= 0:
        return ""
    for name in ("article", "main"):
        if sum(c - l for path, (c, l) in sizes.items() if _inside(tuple(path.split(">")), name)) >= share * total:
            return name
    best, weights = "", Counter()
    for path, (chars, link) in sizes.items():
        parts = path.split(">")
        for n in range(1, len(parts) + 1):
            if re.split(r"[\[]", parts[n - 1])[0] not in {*RUNS, "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}:
                weights[">".join(parts[:n])] += chars - link
    for path, weight in sorted(weights.items()):
        if weight >= share * total and path.count(">") >= best.count(">"):
            best = path
    while ">" in best:  # the title may stand beside the text
        above = best.rpartition(">")[0]
        if not any(path.startswith(above + ">") and re.match(r"(header(\[[^>]*)?>)?h1\b", path[len(above) + 1 :]) for path in sizes):
            break
        best = above
    return best


def _inside(path: tuple, region: str) -> bool:
    if region in ("article", "main"):
        return any(p == region or p.startswith(region + "[") for p in path)
    parts = tuple(region.split(">")) if region else ()
    return path[: len(parts)] == parts


def _own_lines(lines: list[Line], places: list[int], region: str, template: Collection[int]) -> list[Line]:
    """The lines that are not template. A line of the template stays if it is running text of the main
    region, in a container that has text of the page's own too: a paragraph copied from another page."""
    is_own = [line_key(line, places[line.number]) not in template for line in lines]
    live = {line.container for line, mine in zip(lines, is_own) if mine}
    return [line for line, mine in zip(lines, is_own) if mine or line.container in live and region and _inside(line.path, region) and _flows(line.path)]


def _flows(path: tuple) -> bool:
    return bool(path) and re.split(r"[\[]", path[-1])[0] in FLOW


def main_text(source: str | None, region: str, template: Collection[int] = (), wrapper: Sequence[int] | None = None, share: float = SHARE) -> str:
    """The text of a page in the region, its lines joined by one space, less the template that the
    host's wrapper (token codes) tells. A page with less than ``share`` of its text in the region is read
    as a whole, less what is cut; one that has nothing but template keeps that."""
    if not source:
        return ""
    lines, stream = read_lines(source)
    own = _own_lines(lines, places_in(stream, wrapper), region, template) if template else lines
    if not any(line_key(line, 0) for line in own):  # titles at most
        own = lines
    chosen = [line for line in own if _inside(line.path, region)]
    weigh = lambda some: sum(len(line.text) - line.linked for line in some)
    if not chosen or weigh(chosen) < share * weigh(own):
        chosen = own
    return " ".join(line.text for line in chosen)


# ---- Spark --------------------------------------------------------------------------------------


def _read(pages: DataFrame) -> DataFrame:
    """(host, page, stream, texts, lines) of each page: a hash of its html, its stream as JSON with the
    texts in each token, and its distinct lines with path, digest, text number, characters, and whether
    it is a title. From (host, html)."""
    kind = "array<struct<path: string, digest: bigint, number: int, chars: bigint, linked: bigint, title: boolean>>"

    def batches(it: Iterator) -> Iterator:
        import pyarrow as pa

        line = pa.list_(pa.struct([("path", pa.string()), ("digest", pa.int64()), ("number", pa.int32()), ("chars", pa.int64()), ("linked", pa.int64()), ("title", pa.bool_())]))
        for batch in it:
            streams, texts, found = [], [], []
            for t in batch.column(2).to_pylist():
                lines, (tokens, inside) = read_lines(t.decode("utf-8", "replace") if t else "")
                streams.append(json.dumps([[x, False] for x in tokens]))
                texts.append(inside)
                rows = []
                for one in lines:
                    path = ">".join(one.path)
                    digest = xxhash.xxh64_intdigest(path + "\0" + one.text, 11) - (1 << 63)
                    rows.append({"path": path, "digest": digest, "number": one.number, "chars": len(one.text), "linked": one.linked, "title": line_key(one, 0) == 0})
                found.append(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(streams, pa.string()), pa.array(texts, pa.list_(pa.int32())), pa.array(found, line)], names=["host", "page", "stream", "texts", "lines"])

    rows = pages.select("host", F.xxhash64("html").alias("page"), F.col("html").cast("binary").alias("html"))
    return rows.mapInArrow(batches, f"host string, page bigint, stream string, texts array<int>, lines {kind}")


def _frequent(streams: DataFrame, share: float) -> DataFrame:
    """The distinct streams (host, stream, n) with only those tokens that more than ``share`` of the host's
    pages have. Of them there are fewer than tokens of a page, divided by ``share``."""

    @F.pandas_udf("array<int>")
    def codes(streams: pd.Series) -> pd.Series:
        return pd.Series([sorted({token_code(t) for t, _ in json.loads(s)}) for s in streams], dtype=object)

    @F.pandas_udf("string")
    def kept(streams: pd.Series, frequent: pd.Series) -> pd.Series:
        some = [frozenset() if f is None else frozenset(f.tolist()) for f in frequent]
        return pd.Series([json.dumps([x for x in json.loads(s) if token_code(x[0]) in f]) for s, f in zip(streams, some)], dtype=object)

    pages = streams.groupBy("host").agg(F.sum("n").alias("pages"))
    counted = streams.select("host", "n", F.explode(codes("stream")).alias("token")).groupBy("host", "token").agg(F.sum("n").alias("n"))
    frequent = counted.join(pages, "host").filter(F.col("n") > share * F.col("pages")).groupBy("host").agg(F.collect_list("token").alias("frequent"))
    return streams.join(write_once(frequent), "host", "left").select("host", kept("stream", "frequent").alias("stream"), "n").groupBy("host", "stream").agg(F.sum("n").alias("n"))


def _folded(streams: DataFrame, part: int) -> DataFrame:
    """(host, wrapper) from the distinct streams (host, stream, n) of hosts, the most frequent first."""
    so_far = (1 << 63) - 1  # in the place of a wrapper's count: it comes first

    def fold_part(group: pd.DataFrame) -> pd.DataFrame:
        order = group.sort_values(["n", "stream"], ascending=[False, True])
        taken, tokens = [], 0
        for s, n in zip(order["stream"], order["n"]):
            if tokens > LONGEST:
                break
            taken.append(json.loads(s))
            tokens += len(taken[-1]) if n < so_far else 0
        return pd.DataFrame({"host": [group["host"].iloc[0]], "stream": [json.dumps(fold(taken))], "whole": [len(taken) == len(order)]})

    @F.pandas_udf("boolean")
    def fits(streams: pd.Series, wrappers: pd.Series) -> pd.Series:
        out, read, tokens = [], None, []
        for s, w in zip(streams, wrappers):
            if w != read:
                read, tokens = w, [t for t, _ in json.loads(w)]
            rest = iter(tokens)
            out.append(all(t in rest for t, _ in json.loads(s)))
        return pd.Series(out, dtype=bool)

    left, wrappers, most = streams, None, _most(streams)
    while True:
        taken = left
        if most > part:
            rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "stream"))
            taken = left.withColumn("rank", rank).filter(F.col("rank") <= part).drop("rank")
        if wrappers is not None:
            taken = taken.unionByName(wrappers.select("host", "stream", F.lit(so_far).alias("n")))
        wrappers = write_once(taken.groupBy("host").applyInPandas(fold_part, "host string, stream string, whole boolean"))
        if most <= part and not wrappers.filter("not whole").head(1):
            return wrappers.select("host", F.col("stream").alias("wrapper"))
        known = wrappers.select(F.col("host").alias("_host"), F.col("stream").alias("_wrapper"))
        both = left.join(known, F.col("host").eqNullSafe(F.col("_host")))
        left = write_once(both.filter(~fits("stream", "_wrapper")).select("host", "stream", "n"))
        most = _most(left)
        if most == 0:
            return wrappers.select("host", F.col("stream").alias("wrapper"))


def _most(streams: DataFrame) -> int:
    return streams.groupBy("host").count().agg(F.max("count")).first()[0] or 0


def infer_wrappers(pages: DataFrame, part: int = 64) -> DataFrame:
    """(host, wrapper) of each host, of all tokens; from (host, html). A round folds ``part`` distinct
    streams of a host at most."""
    return _folded(write_once(_read(pages).groupBy("host", "stream").agg(F.count(F.lit(1)).alias("n"))), part)


def _placed(read: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(host, page, lines): the lines with their ``key`` by the place that the host's wrapper gives them."""
    kind = "array<struct<path: string, key: bigint, chars: bigint, linked: bigint>>"

    @F.pandas_udf("array<bigint>")
    def keys(streams: pd.Series, texts: pd.Series, numbers: pd.Series, digests: pd.Series, titles: pd.Series, codes: pd.Series) -> pd.Series:
        out = []
        for stream, inside, number, digest, title, wrapper in zip(streams, texts, numbers, digests, titles, codes):
            places = places_in(([t for t, _ in json.loads(stream)], [int(n) for n in inside]), wrapper)
            out.append([0 if t or places[n] == RARE else _key(places[n], int(d) + (1 << 63)) for n, d, t in zip(number, digest, title)])
        return pd.Series(out, dtype=object)

    both = read.join(wrappers, "host")
    found = keys("stream", "texts", F.col("lines.number"), F.col("lines.digest"), F.col("lines.title"), "codes")
    rows = both.select("host", "page", "lines", found.alias("keys"))
    return rows.select("host", "page", F.zip_with("lines", "keys", lambda l, k: F.struct(l["path"].alias("path"), k.alias("key"), l["chars"].alias("chars"), l["linked"].alias("linked"))).cast(kind).alias("lines"))


def infer_slots(pages: DataFrame, share: float = 0.5, least: int = 3, part: int = 64) -> DataFrame:
    """(host, region, template, codes) of each host; from (host, html). The template is the keys of the
    texts that more than ``share`` of the host's distinct pages, and ``least`` of them, have at one place of
    the wrapper; the codes are the wrapper's tokens."""
    read = write_once(_read(pages).dropDuplicates(["host", "page"]))
    named = F.coalesce("host", F.lit(""))  # pages without a host are one group
    read = read.withColumn("host", named)
    streams = write_once(read.groupBy("host", "stream").agg(F.count(F.lit(1)).alias("n")))
    wrappers = _folded(write_once(_frequent(streams, share)), part)

    @F.pandas_udf("array<int>")
    def codes(wrappers: pd.Series) -> pd.Series:
        return pd.Series([[token_code(t) for t, _ in json.loads(w)] for w in wrappers], dtype=object)

    wrappers = write_once(wrappers.select("host", codes("wrapper").alias("codes")))
    read = write_once(_placed(read, wrappers))
    # a page counts once for each of its lines
    lines = read.select("host", F.explode(F.array_distinct("lines.key")).alias("key"))
    # a key stands for its place, path and text; the few that are common are all that meets the hosts' page counts
    common = write_once(lines.filter("key <> 0").groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least))
    pages_of = write_once(read.groupBy("host").agg(F.count(F.lit(1)).alias("pages")))
    shared = common.join(pages_of, "host").filter(F.col("n") > share * F.col("pages"))
    template = write_once(shared.groupBy("host").agg(F.collect_list("key").alias("template")))  # at most 1 / share times the lines of a page

    # template lines are few a host: what they hold is taken off the sums of all lines
    hosts = pages_of.select("host").join(template, "host", "left")
    both = read.join(template, "host", "left").select("host", F.explode(own_sizes("lines", "template")).alias("l")).select("host", "l.*")
    sums = both.groupBy("host", "path").agg(F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    per_host = sums.groupBy("host").agg(F.collect_list(F.struct("path", "chars", "linked")).alias("sizes"))  # as many as the host's templates have paths

    @F.pandas_udf("string")
    def region(sizes: pd.Series) -> pd.Series:
        return pd.Series([main_region({x["path"]: [x["chars"], x["linked"]] for x in s} if s is not None else {}) for s in sizes], dtype=object)

    return hosts.join(per_host, "host", "left").join(wrappers, "host").select("host", region("sizes").alias("region"), "template", "codes")


def own_sizes(lines: str, template: str) -> Column:
    """The lines of a page that are not of its host's template."""
    return F.expr(f"filter({lines}, x -> {template} is null or not array_contains({template}, x.key))")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url and ``text``, the main text of the whole html.

    Null html counts as empty and has empty text. Pages without a host (null urls too) form one
    group. Repeated rows have a row each, but count once where texts are compared. A host with fewer
    than three distinct pages has a wrapper, but no text of it can be told to be constant.
    """
    host, _ = host_and_path("__url")
    named = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), F.col(html_col).alias("html")).withColumn("host", F.coalesce(host, F.lit("")))
    # written, so that the join shuffles it itself and can split the pages of a large host
    slots = write_once(infer_slots(named.select("host", "html")))

    @F.pandas_udf("string")
    def text(sources: pd.Series, regions: pd.Series, templates: pd.Series, codes: pd.Series) -> pd.Series:
        return pd.Series([main_text(s, r or "", frozenset() if t is None else frozenset(t.tolist()), c) for s, r, t, c in zip(sources, regions, templates, codes)], dtype=object)

    both = named.join(slots, "host", "left")
    return both.select(F.col("__id").alias(id_col), F.col("__url").alias(url_col), text("html", "region", "template", "codes").alias("text"))
