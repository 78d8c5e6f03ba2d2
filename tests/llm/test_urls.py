import random
import re

from pyspark.sql import functions as F

from loam.llm.urls import RULES, judge

HOSTS = ["www.example.com", "example.com", "m.example.com", "a.net", "fnet", "net", "x.org", "EXAMPLE.com", "com", "y.org:80"]
PATHS = ["", "/", "/en/", "/en/1?x=/es/", "/es/2#top", "/fr/", "/fr", "?q=/en/", "/EN/", "/es/a/b"]


def plain(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]) if m else ""
    path = m[2] if m else ""
    best = None
    for verdict, rule in RULES:
        of, rest = rule.split("/", 1)
        if (host == of or host.endswith("." + of)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return host, path, best


def test_rules(spark):
    urls = [f"http://{h}{p}" for h in HOSTS for p in PATHS] + [None, "", "no scheme", "://x.net/fr/1", "http://a.net/es/?u=http://b.com/"]
    rows = judge(spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path, best = plain(urls[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best[1], best[0] if best else "allow")


def test_aliases_against_a_search(spark):
    rng = random.Random(6)
    urls = [f"http://h{i}.{rng.choice(['org', 'org', 'org', 'net', 'com'])}/{rng.choice(['en', 'fr', 'x'])}/{i}" for i in range(120)]
    urls += ["http://www.example.com/en/9"]
    links, rows = {u: set() for u in urls}, []
    for i, u in enumerate(urls):
        html = "<html>"
        if rng.random() < 0.5:
            v = rng.choice(urls)
            html += rng.choice([f'<link rel="canonical" href="{v}">', f"<LINK href='{v}' rel=canonical>", f'<meta http-equiv="refresh" content="0; url={v}">', f'<script>window.location.href = "{v}";</script>'])
            links[u].add(v), links[v].add(u)
        rows.append((i, u, html, "x"))
    rows += [(500, "http://gone.org/a", '<link rel="canonical" href="/b">', "x"), (501, "http://gone.org/b", '<meta http-equiv=refresh content="1;url=http://z.net/fr/q">', "x"), (500, "http://gone.org/a", '<link rel="canonical" href="/b">', "x")]

    def reach(u):
        seen, todo = {u}, [u]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        return seen

    got = judge(spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id >= 500:
            assert r.verdict == "block" and r.by == "alias"
            continue
        own = plain(urls[r.page_id])[2]
        said = {b[0] for b in (plain(v)[2] for v in reach(urls[r.page_id])) if b}
        assert r.verdict == (own[0] if own else "block" if said == {"block"} else "allow")
    assert {r.by for r in got} == {"rule", "alias", "default"}


def test_empty(spark):
    assert judge(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_all_links_of_a_page(spark):
    blocked = "http://x.net/fr/1"
    pages = [
        "<script>if(m){location.href='http://m.org/a'}else{location.href='http://x.net/fr/1'}</script>",
        "<script>location = 'Paris'; location.replace('http://x.net/fr/1')</script>",
        '<link rel="canonical" href="http://m.org/b"><link rel="canonical" href="http://x.net/fr/1">',
        '<link rel="canonical"><link rel="canonical" href="http://x.net/fr/1">',
        '<meta http-equiv="refresh" content="5"><meta http-equiv="refresh" content="0;url=http://m.org/c"><meta http-equiv=refresh content="0;url=http://x.net/fr/1">',
    ]
    rows = [(i, f"http://p{i}.org/", html) for i, html in enumerate(pages)] + [(9, "http://p9.org/", "<p>none</p>"), (10, None, pages[0])]
    rows += [(20, "http://m.org/a", None), (21, "http://m.org/b", None), (22, "http://m.org/c", None), (30, blocked, None)]
    got = {r.page_id: (r.verdict, r.by) for r in judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**dict.fromkeys([0, 1, 2, 3, 4, 20, 21, 22], ("block", "alias")), 9: ("allow", "default"), 10: ("allow", "default"), 30: ("block", "rule")}


def test_rules_of_one_length(spark):
    docs = spark.createDataFrame([(1, "http://a.com/x/1", None)], "page_id long, url string, html string")
    for rules in ((("allow", "a.com/x/"), ("block", "a.com/x/")), (("block", "a.com/x/"), ("allow", "a.com/x/"))):
        assert [r.verdict for r in judge(docs, rules).collect()] == ["allow"]


def test_many_aliases_and_long_pages(spark):
    """A chain of 3000 redirects to a blocked URL, a hub of 3000 pages with one canonical URL, and a very long page."""
    rows = [(i, f"http://c{i}.org/", f'<meta http-equiv="refresh" content="0;url=http://c{i + 1}.org/">') for i in range(3000)]
    rows += [(3000, "http://c3000.org/", '<link rel="canonical" href="http://x.net/fr/1">')]
    rows += [(10000 + i, f"http://h{i}.org/", '<link rel="canonical" href="http://hub.org/">') for i in range(3000)]
    rows += [(20000, "http://long.org/", "<p>" + "redirect location canonical " * 100_000 + '<link rel="canonical" href="http://x.net/es/1">')]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in judge(docs).collect()}
    assert all(got[i] == "block" for i in range(3001)) and all(got[10000 + i] == "allow" for i in range(3000)) and got[20000] == "block"


def test_a_large_component_and_many_ruled_pages_meet_in_no_task(spark):
    """With broadcasts off, rows of ruled pages and of one large component are dealt to all tasks."""
    pages = [(i, "http://a.com/", None) for i in range(3000)] + [(5000 + i, f"http://h{i}.org/", '<link rel="canonical" href="http://x.net/es/">') for i in range(3000)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = judge(spark.createDataFrame(pages, "page_id long, url string, html string"))
        sizes = [r["count"] for r in out.withColumn("_p", F.spark_partition_id()).groupBy("_p").count().collect()]
        assert out.groupBy("by").count().collect() and max(sizes) < 0.4 * 6000
        assert {r.by: r["count"] for r in out.groupBy("by").count().collect()} == {"rule": 3000, "alias": 3000}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
