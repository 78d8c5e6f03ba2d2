"""URL filters: redirects and canonical links make URLs equivalent, and block decisions go to all aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loam.llm.common import drop_table, join_keyed, materialize, table
from loam.llm.components import components

#: (verdict, host and path) of the production rules.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

#: A link tag with its rel, and a refresh or location that sends the reader on; the target is group 1 of the second.
_CANONICAL = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*>"
_REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*>"
_HREF = r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)"
_TARGET = r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)"
_LOCATION = r"(?i)\blocation(?:\.href)?\s*=\s*[\"']([^\"']+)[\"']|\blocation\.replace\(\s*[\"']([^\"']+)[\"']"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; empty for null and without ://."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty for null and without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null where none fits. Of rules of one length an allow goes
    before a block."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "allow")):  # the last of them is asked first
        of, _, rest = text.partition("/")
        fits = ((host == of) | F.endswith(host, F.lit(f".{of}"))) & F.startswith(path, F.lit(f"/{rest}"))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return rule, verdict


def normal(url: Column) -> Column:
    """One form of equal URLs: no fragment, scheme and host in lower case, / for an empty path."""
    bare = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    scheme = lower_ascii(F.regexp_extract(bare, r"(?s)^(.*?)://", 1))
    rest = F.regexp_extract(bare, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    return F.when(bare.contains("://"), F.concat(scheme, F.lit("://"), host_of(bare), F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest)))).otherwise(bare)


def resolve(base: Column, link: Column) -> Column:
    """A link as its page understands it: with a scheme as it is, else on the page's scheme, host or folder."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^?#]*/)", 1)
    link = F.replace(F.trim(link), F.lit("&amp;"), F.lit("&"))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(site, link))
        .when(F.startswith(link, F.lit("?")), F.concat(F.regexp_extract(base, r"(?s)^(.*?://[^?#]*)", 1), link))
        .when(folder != "", F.concat(folder, link))
        .otherwise(F.concat(site, F.lit("/"), link))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """src, dst: URLs in their normal form that any redirect or canonical link of a page makes equivalent."""
    head = F.coalesce(F.col("html"), F.lit(""))
    every = lambda c, pattern, group: F.regexp_extract_all(c, F.lit(pattern), F.lit(group))
    of_tags = lambda tags, pattern: F.transform(every(head, tags, 0), lambda tag: F.regexp_extract(tag, pattern, 1))
    found = F.concat(of_tags(_CANONICAL, _HREF), of_tags(_REFRESH, _TARGET), every(head, _LOCATION, 1), every(head, _LOCATION, 2))
    # A text that none of these words stand in has no link; that is cheaper to see than the patterns are to run.
    low = lower_ascii(head)
    some = low.contains("canonical") | low.contains("refresh") | low.contains("location")
    links = pages.where(F.col("url").isNotNull() & some).select("url", F.explode(found).alias("link")).where("link <> ''")
    return links.select(normal(F.col("url")).alias("src"), normal(resolve(F.col("url"), F.col("link"))).alias("dst")).where("src <> dst").distinct()


def judge(pages: DataFrame, rules=RULES, default: str = "allow", edges: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and by (rule, alias or default) of every page.

    A URL that a rule fits has the rule's verdict, whatever its aliases have: an explicit allow goes first. Any other
    URL is blocked if one of its aliases is blocked by a rule and none is explicitly allowed, else it gets `default`.
    Aliases are all URLs of a connected component of redirect and canonical-link edges, also those that are no page.
    `edges` (src, dst) adds known redirects to those found in the pages. Null URLs and URLs without :// have empty host
    and path and no rule. Equal URLs are judged alike; repeated rows each give a row, an empty table none.
    """
    links = alias_edges(pages)
    if edges is not None:
        links = links.unionByName(edges.select(normal(F.col("src")).alias("src"), normal(F.col("dst")).alias("dst")).where("src <> dst")).distinct()
    links = materialize(links, "aliases")
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("rule", rule).withColumn("verdict", verdict)
    if not links.limit(1).count():
        out = rows.withColumn("blocked", F.lit(False))
    else:
        # URLs get numbers by a hash of 64 bits; two URLs of one hash would only be taken for aliases.
        number = lambda c: F.xxhash64(c)
        found = components(links.select(number("src").alias("a"), number("dst").alias("b")))
        urls = links.select(F.col("src").alias("u")).unionByName(links.select(F.col("dst").alias("u"))).distinct()
        _, told = ruled(host_of(F.col("u")), path_of(F.col("u")), rules)
        said = urls.select(number("u").alias("node"), told.alias("told")).join(found, "node")
        some = lambda v: F.coalesce(F.bool_or(F.col("told") == v), F.lit(False))
        judged = materialize(said.groupBy("component").agg((some("block") & ~some("allow")).alias("_blocked"), F.count(F.lit(1)).alias("_urls")), "judged")
        # A component may hold a third of all URLs: it is dealt to pieces.
        aliases = join_keyed(found, judged, ["component"], "_urls", F.col("node")).where("_blocked").select(F.col("node").alias("_node"), F.lit(True).alias("_free"))
        aliases = materialize(aliases, "blocked")
        drop_table(found)
        drop_table(judged)
        # Pages with a rule find no alias; a key of their own deals them to all tasks.
        free = F.col("rule").isNull()
        keyed = rows.withColumn("_free", free).withColumn("_node", F.when(free, number(normal(F.col("url")))).otherwise(F.xxhash64("page_id", "url")))
        out = keyed.join(aliases.withColumn("blocked", F.lit(True)), ["_node", "_free"], "left")
    by_alias = F.coalesce("blocked", F.lit(False))
    out = out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(by_alias, "block").otherwise(default)).alias("verdict"), F.when(F.col("rule").isNotNull(), "rule").when(by_alias, "alias").otherwise("default").alias("by"))
    return out


def op9_url_redirect_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
