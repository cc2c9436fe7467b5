"""URL filters: parts, longest rule, and spread of trust and distrust."""

import re
from collections import defaultdict

import pytest

from ledgerlens.llm import urls

URLS = [
    (1, "HTTP://WWW.Example.NET/en/x?q=/de/#y", "www.example.net", "/en/x", "example.net/en/", "allow"),
    (2, "http://example.net/de/", "example.net", "/de/", "net/", "block"),
    (3, "http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
    (4, "https://a.example.com/de/1", "a.example.com", "/de/1", "example.com/de/", "block"),
    (5, "http://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"),
    (6, "http://x.org/fr", "x.org", "/fr", None, "allow"),
    (7, None, "", "", None, "allow"),
    (8, "no scheme/en/", "", "", None, "allow"),
    (9, "http://net", "net", "", None, "allow"),
    (10, "http://net/?a", "net", "/", "net/", "block"),
    (11, "a?b=://c.net/x", "c.net", "/x", "net/", "block"),
    (12, "://ÀB.org/fr/é", "Àb.org", "/fr/é", "org/fr/", "allow"),
    (13, "http://", "", "", None, "allow"),
]


def test_parts_and_rules(spark):
    pages = spark.createDataFrame([u[:2] for u in URLS], "page_id long, url string").selectExpr("*", "cast(null as string) as html", "1 as rule")
    got = sorted(tuple(r) for r in urls.judge(pages).collect())
    assert got == [(i, h, p, r, v) for i, _, h, p, r, v in URLS]
    assert urls.judge(pages.limit(0)).count() == 0
    assert urls.judge(pages.unionAll(pages)).count() == 2 * len(URLS)


GRAPH = [
    ("http://bad.net/", ["/x"]),
    ("http://farm.com/a", ["http://bad.net/", "//bad.net/2"]),
    ("http://farm.com/b", ["http://bad.net/"]),
    ("http://news.org/fr/", ["http://good.com/", "mailto:a@b.net"]),
    ("http://good.com/", ["relative", "#top"]),
    ("http://mixed.com/", ["http://bad.net", "http://good.com/", "HTTPS://news.org/"]),
]


def plain(pages, damping, rounds):
    host = lambda u: u.split("://")[1].split("/")[0] if "://" in u else ""
    edges, n, seeds = defaultdict(float), defaultdict(float), defaultdict(lambda: [0.0, 0.0])
    for url, links in pages:
        own = host(url)
        n[own] += 1
        seeds[own][0] += url.endswith("/fr/")
        seeds[own][1] += ".net/" in url
        targets = {host(("http:" + x) if x.startswith("//") else x.lower()) if "//" in x else "" if ":" in x else own for x in links}
        for t in targets - {"", own}:
            edges[own, t] += 1
    out, into = defaultdict(float), defaultdict(float)
    for (a, b), w in edges.items():
        out[a] += w
        into[b] += w
    t0 = {h: s[0] / n[h] for h, s in seeds.items()}
    d0 = {h: s[1] / n[h] for h, s in seeds.items()}
    hosts = {h for e in edges for h in e}
    t, d, te, de = (defaultdict(float, ((h, x.get(h, 0)) for h in hosts)) for x in (t0, d0, dict.fromkeys(hosts, 1), dict.fromkeys(hosts, 1)))
    for _ in range(rounds):
        moved = [defaultdict(float) for _ in range(4)]
        for (a, b), w in edges.items():
            for to, kind, at in ((b, moved[0], t[a] / out[a]), (b, moved[1], te[a] / out[a]), (a, moved[2], d[b] / into[b]), (a, moved[3], de[b] / into[b])):
                kind[to] += damping * at * w
        t, te, d, de = (
            defaultdict(float, ((h, (1 - damping) * x.get(h, 0) + m[h]) for h in hosts))
            for x, m in zip((t0, dict.fromkeys(hosts, 1), d0, dict.fromkeys(hosts, 1)), moved, strict=True)
        )
    share = lambda m, e, h: m[h] / e[h] if e.get(h) else 0.0
    return {
        h: tuple((1 - damping) * x.get(h, 0) + damping * share(*m, h) for x, m in ((t0, moved[:2]), (d0, moved[2:]))) for h in {*hosts, *n}
    }


def test_spread_over_links(spark):
    rows = [(i, u, "".join(f"<A HREF='{x}'>a</A>" for x in links)) for i, (u, links) in enumerate(GRAPH)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    judged = urls.judged_by_rules(pages, urls.RULES)
    seeds = judged.groupBy("host").agg(
        *(urls.F.avg((urls.F.coalesce("ruled", urls.F.lit("")) == v).cast("double")).alias(k) for k, v in (("trust", "allow"), ("distrust", "block")))
    )
    got = {r["host"]: (r["trust"], r["distrust"]) for r in urls.spread(seeds, urls.host_links(pages), 0.85, 6).collect()}
    want = plain(GRAPH, 0.85, 6)
    assert set(got) == set(want)
    for h, pair in want.items():
        assert got[h] == pytest.approx(pair)
    verdict = {r["host"]: r["verdict"] for r in urls.judge(pages, rounds=6).collect()}
    assert verdict == {"bad.net": "block", "farm.com": "block", "mixed.com": "block", "good.com": "allow", "news.org": "allow"}


def linked(spark, graph):
    rows = [(i, u, "".join(f"<a href='{x}'>a</a>" for x in links)) for i, (u, links) in enumerate(graph)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def farm(linkers, pages_a_host):
    """Linkers of one blocked host, as many of a good one, and a portal that links to all of them."""
    everyone = [f"http://{kind}{i}.com/" for kind in ("farm", "fan") for i in range(linkers)]
    return [
        ("http://bad.net/", []), ("http://good.org/fr/", []),
        *((f"http://farm{i}.com/{p}", ["http://bad.net/", "/own"]) for i in range(linkers) for p in range(pages_a_host)),
        *((f"http://fan{i}.com/{p}", ["http://good.org/"]) for i in range(linkers) for p in range(pages_a_host)),
        ("http://portal.com/", ["http://bad.net/", *everyone[linkers:], *(f"http://other{i}.com/" for i in range(20))]),
        *((f"http://some.org/{p}", []) for p in ("fr/1", "x", "y", "z")),
        *((f"http://part.example.com/{p}", []) for p in ("de/1", "x", "y", "z")),
        *((f"http://points{i}.com/", ["http://part.example.com/x"]) for i in range(3)),
    ]


@pytest.mark.parametrize("linkers,pages_a_host", [(1, 1), (12, 3), (500, 2)])
def test_same_verdicts_at_every_size(spark, linkers, pages_a_host):
    verdicts = defaultdict(set)
    for r in urls.judge(linked(spark, farm(linkers, pages_a_host))).where("rule is null").collect():
        verdicts[re.sub(r"^(farm|fan|points)\d+\.com$", r"\1", r["host"])].add(r["verdict"])
    assert verdicts.pop("farm") == {"block"} and verdicts.pop("fan") == {"allow"}
    assert verdicts["portal.com"] == {"allow"} and verdicts["some.org"] == {"allow"} and verdicts["part.example.com"] == {"allow"}
    assert verdicts["points"] == {"block"}  # a quarter of what they point at is blocked


def test_sql_on_linked_hosts(spark):
    import duckdb
    from ledgerlens.llm.oracle import ORACLE

    pages = linked(spark, [*GRAPH, *farm(12, 3)])
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    want = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({ORACLE['op5_url_filters']})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in urls.judge(pages).collect())


def test_plan_is_native(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for frame in (urls.host_links(pages), urls.judge(pages)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
