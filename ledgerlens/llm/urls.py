"""URL filters: host rules, and trust and distrust spread over the link graph.

Rules judge a url by host and path.  A host that no rule judges is judged by
its links: trust starts at hosts with allowed pages and follows links
(personalised PageRank); distrust starts at hosts with blocked pages and goes
against links, to those who point at them.  Both are held against what would
arrive if every host were a seed.  Links are counted by host pair before
anything else, so a host that holds most pages is a few rows of the graph.
Built-in functions only.
"""

from __future__ import annotations

import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import materialize

ALLOW, BLOCK = "allow", "block"
HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
ROUNDS_A_TABLE = 4


class UrlRule(NamedTuple):
    host: str
    path: str
    verdict: str


#: The rules of the query.
RULES = (
    UrlRule("net", "/", BLOCK),
    UrlRule("example.net", "/en/", ALLOW),
    UrlRule("example.com", "/de/", BLOCK),
    UrlRule("org", "/fr/", ALLOW),
)


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits, else nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text = F.when(fits, r.host + r.path).otherwise(text)
        verdict = F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def judged_by_rules(pages: DataFrame, rules: tuple[UrlRule, ...]) -> DataFrame:
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return parts.select("page_id", "host", "path", text.alias("rule"), verdict.alias("ruled"))


def host_links(pages: DataFrame) -> DataFrame:
    """source, target, pages: how many pages of a host link to a host.

    A relative link stays on its host; a link of another scheme is none.
    """
    host = host_of(F.col("url"))
    links = pages.select(host.alias("source"), F.regexp_extract_all("html", F.lit(HREF), 1).alias("links"))
    target = lambda x: (
        F.when(x.startswith("//"), host_of(F.concat(F.lit("http:"), x)))
        .when(x.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), host_of(x))
        .when(x.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(""))
        .otherwise(F.col("source"))
    )
    found = links.where(F.col("source") != "").select(
        "source", F.explode(F.array_distinct(F.transform("links", target))).alias("target")
    )
    return found.where(F.col("target") != "").groupBy("source", "target").agg(F.count("*").alias("pages"))


def spread(seeds: DataFrame, links: DataFrame, damping: float, rounds: int) -> DataFrame:
    """host, trust, distrust after ``rounds`` of propagation, each from 0 to 1.

    ``seeds``: host, trust, distrust, each from 0 to 1.  A personalised PageRank
    runs from the seeds and one from all hosts alike, along links for trust and
    against them for distrust; links of a host to itself are none.  What reaches
    a host from the seeds is divided by what reaches it from all hosts, so the
    number of hosts that share a link's target cancels out.  A host's score is
    its own seed and that share, weighed ``1 - damping`` and ``damping``.
    """
    kinds = F.array(
        F.struct(F.lit("trust").alias("kind"), F.col("source").alias("host"), F.col("target").alias("to"), "pages"),
        F.struct(F.lit("distrust").alias("kind"), F.col("target").alias("host"), F.col("source").alias("to"), "pages"),
    )
    both = links.where(F.col("source") != F.col("target")).select(F.inline(kinds))
    total = both.groupBy("kind", "host").agg(F.sum("pages").alias("all_pages"))
    edges = materialize(
        both.join(total, ["kind", "host"]).select("kind", "host", "to", (F.col("pages") / F.col("all_pages")).alias("part")),
        "host-edges",
    )
    own = seeds.unpivot("host", ["trust", "distrust"], "kind", "seed").select("kind", "host", "seed")
    linked = edges.select("kind", F.explode(F.array("host", "to")).alias("host")).distinct()
    start = materialize(
        linked.join(own, ["kind", "host"], "left").select("kind", "host", F.coalesce("seed", F.lit(0.0)).alias("seed")),
        "host-seeds",
    )
    sums = [F.sum(c).alias(c) for c in ("score", "evenly")]
    base = start.select("kind", "host", (F.col("seed") * (1 - damping)).alias("score"), F.lit(1 - damping).alias("evenly"))
    scores = start.select("kind", "host", F.col("seed").alias("score"), F.lit(1.0).alias("evenly"))
    for i in range(rounds):
        moved = scores.join(edges, ["kind", "host"]).select(
            "kind", F.col("to").alias("host"), *((F.col(c) * F.col("part") * damping).alias(c) for c in ("score", "evenly"))
        )
        if i + 1 < rounds:
            scores = base.unionByName(moved).groupBy("kind", "host").agg(*sums)
            if (i + 1) % ROUNDS_A_TABLE == 0:
                scores = materialize(scores, "host-scores")
    reached = moved.groupBy("kind", "host").agg(*sums)
    parts = own.select("kind", "host", (F.col("seed") * (1 - damping)).alias("part")).unionByName(
        reached.select("kind", "host", (F.col("score") / F.col("evenly") * damping).alias("part"))
    )
    return parts.groupBy("host").agg(
        *(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("part"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust"))
    )


def judge(
    pages: DataFrame,
    rules: tuple[UrlRule, ...] = RULES,
    damping: float = 0.85,
    rounds: int = 8,
    least: float = 0.1,
) -> DataFrame:
    """page_id, host, path, rule, verdict for each page.

    Every host with a ruled page is a seed: of trust by the share of its pages
    that the rules allow, of distrust by the share they block.  Without a rule
    a page is blocked where its host's distrust is at least ``least`` and above
    its trust, else allowed; a page without a host is allowed.  Both scores are
    shares (``spread``), so the verdict on a host does not depend on how many
    pages, hosts or fellow linkers there are.  At least one round is made.
    Null urls and html, repeated rows and other columns do no harm; an empty
    table gives no rows.
    """
    judged = judged_by_rules(pages, rules)
    share = lambda v: F.avg((F.coalesce(F.col("ruled"), F.lit("")) == v).cast("double"))
    seeds = judged.where(F.col("host") != "").groupBy("host").agg(share(ALLOW).alias("trust"), share(BLOCK).alias("distrust"))
    scores = spread(seeds, host_links(pages), damping, max(1, rounds))
    bad = scores.where((F.col("distrust") >= least) & (F.col("distrust") > F.col("trust"))).select("host", F.lit(BLOCK).alias("spread"))
    return judged.join(bad, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", "spread", F.lit(ALLOW)).alias("verdict")
    )
