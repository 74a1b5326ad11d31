import re
from collections import defaultdict

from pyspark.sql import functions as F

from quotalake.llm import urls
from quotalake.llm.queries import RULES, op5_urls

RULE_TABLE = [(r.verdict, r.host, r.path) for r in RULES]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", rest).groups()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule_for(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULE_TABLE if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def slow_verdicts(rows):
    """Ranks by dense iteration over all links."""
    split_rows = [(p, *split(u), h) for p, u, h in rows]
    seeds, weights = defaultdict(lambda: [0.0, 0.0]), defaultdict(float)
    for _, host, path, html in split_rows:
        verdict = rule_for(host, path)[1]
        if verdict and host:
            seeds[host][verdict == "block"] += 1
        for link in re.findall(urls.LINK.replace("(?i)", ""), html or "", re.I):
            to = split(link)[0]
            if host and to and to != host:
                weights[host, to] += 1
    total = sum(sum(s) for s in seeds.values()) or 1
    rank = []
    for kind in (0, 1):
        edges = {(a, b) if kind == 0 else (b, a): w for (a, b), w in weights.items()}
        out = defaultdict(float)
        for (a, _), w in edges.items():
            out[a] += w
        base = {h: (1 - urls.DAMPING) * s[kind] / total for h, s in seeds.items()}
        r = dict(base)
        for _ in range(200):
            new = defaultdict(float, base)
            for (a, b), w in edges.items():
                new[b] += urls.DAMPING * r.get(a, 0) * w / out[a]
            r = new
        rank.append(r)
    out = {}
    for page, host, path, _ in split_rows:
        rule, verdict = rule_for(host, path)
        t, d = rank[0].get(host, 0), rank[1].get(host, 0)
        out[page] = (host, path, rule, verdict or ("block" if t + d > 0 and d / (t + d) > 0.5 else "allow"))
    return out


def link(*targets):
    return "".join(f'<a class="x" href="{t}">t</a>' for t in targets)


PAGES = [
    (1, "http://good.org/x", link("http://friend.net/", "HTTPS://Friend.NET/b?q", "/local")),
    (2, "https://bad.com/de/1", link("http://good.org/")), (3, "https://bad.com/other", None),
    (4, "http://points-at-bad.net/p", link("http://bad.com/de/", "http://bad.com/x")),
    (5, "http://friend.net", ""), (6, "http://friend.net/a", None), (7, "http://nobody.net/", link("mailto:x@y.z")),
    (8, None, link("http://bad.com/")), (9, "no scheme", None), (10, "x://", None), (11, "http://A.Example.ORG/es/x?y#z", None),
    (12, "http://example.org/en/1", None), (13, "http://example.org/en/2", None), (14, "http://fr.com/fr/", None),
    (15, "http://notorg/x", None), (16, "http://org/x", None), (17, "http://x.org", None), (18, "http://x.org?/fr/", None),
    (19, "http://mixed.com/fr/1", None), (20, "http://mixed.com/de/1", None), (21, "http://mixed.com/zz", None),
    (22, "http://Ünï.net/é\n#f", None), (23, "a://b://c.org/x", None), (None, "http://good.org/n", None), (6, "http://friend.net/a", None),
]


def test_matches_slow_iteration(spark):
    pages = spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, host string, rule string")
    got = urls.judge_urls(pages, RULES).collect()
    expected = slow_verdicts(PAGES)
    assert len(got) == len(PAGES)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == expected[r.page_id], r
    assert expected[4][3] == "block" and expected[5][3] == "allow" and expected[21][3] == "allow"


def test_whole_table_and_empty(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in op5_urls(spark, sf).collect()} == slow_verdicts(rows)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.judge_urls(none, RULES).count() == 0


def test_reach_of_a_seed_does_not_depend_on_the_table(spark):
    hops, name = 44, "http://h{}.net/".format
    chain = [(k, name(k), link(name(k + 1) if k < hops else "http://bad.com/de/")) for k in range(1, hops + 1)]
    rows = spark.createDataFrame([*chain, (0, "http://bad.com/de/", None)], "page_id long, url string, html string")
    others = spark.range(1000, 201_000).selectExpr("id as page_id", "'http://good.org/' as url", "cast(null as string) as html")
    found = urls.judge_urls(rows.unionByName(others), RULES).where("page_id < 1000").collect()
    assert {(r.page_id, r.verdict, r.distrust_share) for r in found} == {(k, "block", 1.0) for k in range(hops + 1)}


def test_links_are_counted_whole(spark):
    pages = spark.createDataFrame([(k, "http://a.net/", link(*["http://b.net/"] * 3000)) for k in range(3)],
                                  "page_id long, url string, html string")
    assert [tuple(r) for r in urls.host_links(pages).select("src", "dst", F.col("weight")).collect()] == [("a.net", "b.net", 9000)]


def test_links_without_a_scheme_reach_their_host(spark):
    rows = [(1, "http://near.net/", link("//bad.com/de/?u=http://good.org/")), (2, "http://bad.com/de/", None),
            (3, "http://here.net/", link("/a//b.net/", "///", "//", "a//b.net/", "?x=//b.net/")),
            (4, "https://good.org/", "<a href=//Friend.NET:80/x>t</a> <A HREF = ' //two.net#y'>t</A>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    edges = {(r.src, r.dst, r.weight) for r in urls.host_links(pages).collect()}
    assert edges == {("near.net", "bad.com", 1), ("good.org", "friend.net:80", 1), ("good.org", "two.net", 1)}
    assert {r.page_id: r.verdict for r in urls.judge_urls(pages, RULES).collect()} == {1: "block", 2: "block", 3: "allow", 4: "allow"}
