"""URL filter: host and path rules, and link-graph propagation for the hosts that rules leave open.

Rules seed a graph of hosts: a host is trusted by the share of its pages that a rule allows, and
distrusted by the share that a rule for whole hosts blocks (one that blocks a folder says nothing of
the rest); a host that pages only link to is judged by the rules for whole hosts. Trust follows links
(personalised PageRank from the trusted hosts), distrust runs against them (from the blocked hosts to
those that link to them), by the share of a host's own links: how many others link there, and what a
blocked host links to, makes no difference. A host is blocked if its distrust exceeds its trust by
``threshold`` of what a wholly blocked host has.
Edges join hosts, weighted by the pages that link; pages of one host count as one source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from weftwork.session import materialise, write_once

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: An absolute link of a page; the host is the second group.
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*([a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_and_path(url: str) -> tuple[Column, Column]:
    """What stands between the first :// and the next of / ? #, A-Z lower-cased, and from there up to
    ? or #; both empty without a ://."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url)))
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0), F.lit(""))
    return F.translate(host, _UPPER, _LOWER), path


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest (verdict, host, path) rule that fits, as a struct; null if none does."""
    fits = []
    for verdict, rule_host, rule_path in rules:
        on = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = rule_host + rule_path
        fits.append(F.when(on, F.struct(F.lit(len(name)).alias("size"), F.lit(name).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array_compact(F.array(*fits))) if fits else F.lit(None).cast("struct<size int, rule string, verdict string>")


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w): pages of host ``src`` that link to host ``dst``; from (host, html)."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), 2), lambda h: F.translate(h, _UPPER, _LOWER)))
    links = pages.filter("host <> '' and html is not null").select(F.col("host").alias("src"), F.explode(found).alias("dst"))
    return links.filter("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = 0.7, rounds: int = 20, tolerance: float = 1e-4, by_links: bool = False) -> DataFrame:
    """(host, trust, distrust) from (host, trust, distrust) seeds. Each round is one join per
    direction and a sum; it is written to the shared folder, so that no round is computed twice.

    Distrust is dealt out over the hosts that link to a host; with ``by_links`` a host gets that of the
    hosts it links to by the share of its links, as far as it is not distrusted by its own seed."""
    seeds = materialise(seeds)
    out_sum, in_sum = edges.groupBy("src").agg(F.sum("w").alias("o")), edges.groupBy("dst").agg(F.sum("w").alias("i"))
    shares = materialise(edges.join(out_sum, "src").join(in_sum, "dst").select("src", "dst", (F.col("w") / F.col("o")).alias("forth"), (F.col("w") / F.col("i")).alias("back")))
    if by_links:
        own = seeds.select(F.col("host").alias("src"), F.col("distrust").alias("own"))
        shares = materialise(shares.join(own, "src", "left").select("src", "dst", "forth", (F.col("forth") * (1 - F.coalesce("own", F.lit(0.0)))).alias("back")))
    base = seeds.select("host", *[(F.col(c) * (1 - damping)).alias(c) for c in ("trust", "distrust")])
    ranks = base
    if shares.isEmpty():
        return ranks
    for _ in range(rounds):
        forth = shares.join(ranks, shares.src == ranks.host).select(F.col("dst").alias("host"), (F.col("forth") * F.col("trust") * damping).alias("trust"), F.lit(0.0).alias("distrust"))
        back = shares.join(ranks, shares.dst == ranks.host).select(F.col("src").alias("host"), F.lit(0.0).alias("trust"), (F.col("back") * F.col("distrust") * damping).alias("distrust"))
        new = base.union(forth).union(back).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        before = ranks.select("host", F.col("trust").alias("t0"), F.col("distrust").alias("d0"))
        change = F.greatest(F.abs(F.col("trust") - F.coalesce("t0", F.lit(0.0))), F.abs(F.col("distrust") - F.coalesce("d0", F.lit(0.0))))
        both = materialise(new.join(before, "host", "left").select("host", "trust", "distrust", change.alias("change")))
        ranks = both.drop("change")
        if (both.agg(F.max("change")).first()[0] or 0) < tolerance:
            break
    return ranks


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    damping: float = 0.7,
    threshold: float = 0.5,
) -> DataFrame:
    """One row per row of ``pages``: id, ``host``, ``path``, ``rule`` (null if none fits) and
    ``verdict``, the rule's or else that of the host's trust and distrust.

    A null url, or one without ://, has an empty host and path, fits no rule and is allowed. Null
    html has no links. Repeated rows count as pages of their own.
    """
    named = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), F.col(html_col).alias("html"))
    host, path = host_and_path("__url")
    named = named.withColumns({"host": host, "path": path})
    judged = named.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    whole = [rule for rule in rules if rule[2] in ("", "/")]
    blocks = [h + p for verdict, h, p in whole if verdict == "block"]
    share = lambda on: F.avg(F.when(on, 1.0).otherwise(0.0))
    crawled = write_once(judged.filter("host <> ''").groupBy("host").agg(share(F.col("fit.verdict") == "allow").alias("trust"), share(F.col("fit.rule").isin(blocks)).alias("distrust")))
    edges = write_once(host_edges(named.select("host", "html")))
    linked = edges.select(F.col("dst").alias("host")).distinct().join(crawled, "host", "left_anti").withColumn("fit", rule_for(F.col("host"), F.lit("/"), whole))
    is_judged = lambda verdict: (F.col("fit.verdict") == verdict).cast("double")
    seeds = crawled.union(linked.filter("fit is not null").select("host", is_judged("allow"), is_judged("block")))
    ranks = propagate(seeds, edges, damping, by_links=True)
    # only the blocked hosts are joined; written first, so that the pages of a large host are split
    blocked = write_once(ranks.filter(F.col("distrust") - F.col("trust") >= threshold * (1 - damping)).select("host", F.lit("block").alias("method")))
    return (
        judged.select("__id", "host", "path", "fit")
        .join(blocked, "host", "left")
        .select(F.col("__id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", "method", F.lit("allow")).alias("verdict"))
    )
