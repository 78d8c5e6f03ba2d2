"""The registered queries over the driver's tables, each with the same query in SQL where SQL can express it.

All run over whole tables and whole texts. Names in brackets are those of the operators that a query is for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loam.functions import js
from loam.operators import answer, chunks, embed, extract, retrieval, schema
from loam.operators.containment import contains_join
from loam.plans.registry import ORACLES, QUERIES, query
from loam.plans.tables import part_schemas, read, region_records, sources
from loam.sources import files
from loam.streaming import streams
from loam.syntax.nodes import ts_nodes

# ---------------------------------------------------------------- retrieval

_KEYWORD = """
    words AS (SELECT item_id, w, count(*) AS m FROM (SELECT item_id, unnest(string_split(lower(text), ' ')) AS w FROM benchmark) GROUP BY item_id, w),
    hits AS (SELECT w.w, c.strategy, c.chunk_id FROM (SELECT DISTINCT w FROM words) w JOIN chunks c ON contains(c.low, w.w)),
    found AS (SELECT item_id, strategy, chunk_id, sum(m) AS score FROM words JOIN hits USING (w) GROUP BY ALL)"""


@query(f"""WITH chunks AS (SELECT 'd' AS strategy, doc_id AS chunk_id, lower(text) AS low FROM documents), {_KEYWORD},
    every AS (SELECT b.item_id, c.chunk_id, coalesce(f.score, 0) AS score FROM benchmark b CROSS JOIN chunks c LEFT JOIN found f ON f.item_id = b.item_id AND f.chunk_id = c.chunk_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS r FROM every)
    SELECT item_id AS query_id, r::INT AS rank, chunk_id AS doc_id, score::INT AS score FROM ranked WHERE r <= 3""")
def keyword_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[keyword score, top-k] The best three documents of each question."""
    top = retrieval.keyword_top(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), 3, "doc_id", "text", "item_id", "text")
    return top.select(F.col("query").alias("query_id"), "rank", F.col("chunk").alias("doc_id"), "score")


@query(f"""WITH chunks AS (SELECT 'd' AS strategy, doc_id AS chunk_id, lower(text) AS low FROM documents), {_KEYWORD},
    best AS (SELECT b.item_id, coalesce(max(f.score), 0) AS s FROM benchmark b LEFT JOIN found f USING (item_id) GROUP BY b.item_id)
    SELECT count(*) FILTER (s > 0) AS correct, count(*) AS total, round(100.0::DOUBLE * count(*) FILTER (s > 0) / count(*), 2) AS accuracy FROM best""")
def retrieval_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[correct queries, accuracy] Questions whose best document has a word of theirs."""
    top = retrieval.keyword_top(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), 1, "doc_id", "text", "item_id", "text")
    return retrieval.accuracy(top.withColumn("all", F.lit(1)), ["all"]).drop("all")


def _cut(docs: DataFrame, separator: str) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", separator)).alias("at", "text")).select((F.col("doc_id") * 1000000 + F.col("at")).alias("chunk_id"), "text")


@query(f"""WITH chunks AS (
        SELECT 'line' AS strategy, doc_id * 1000000 + generate_subscripts(l, 1) - 1 AS chunk_id, lower(unnest(l)) AS low FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
        UNION ALL SELECT 'sentence', doc_id * 1000000 + generate_subscripts(l, 1) - 1, lower(unnest(l)) FROM (SELECT doc_id, string_split(text, '. ') AS l FROM documents)), {_KEYWORD},
    best AS (SELECT strategy, item_id, max(score) AS s FROM found GROUP BY ALL),
    n AS (SELECT count(*) FILTER (strategy = 'line' AND s > 0) AS line, count(*) FILTER (strategy = 'sentence' AND s > 0) AS sentence FROM best)
    SELECT line, sentence, CASE WHEN line > sentence THEN 'line chunking performed better' WHEN sentence > line THEN 'sentence chunking performed better'
        ELSE 'Both strategies performed equally' END AS verdict FROM n""")
def strategy_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[comparison of strategies] Line chunks against sentence chunks: questions whose best chunk has a word of theirs."""
    docs, asked = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    top = lambda cut: retrieval.keyword_top(_cut(docs, cut), asked, 1, "chunk_id", "text", "item_id", "text")
    both = top("\n").withColumn("strategy", F.lit("line")).unionByName(top("\\. ").withColumn("strategy", F.lit("sentence")))
    return retrieval.verdict(retrieval.accuracy(both, ["strategy"]), "line", "sentence")


@query("""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
        FROM embeddings q CROSS JOIN embeddings v WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[cosine, top-k] The five nearest vectors of every fiftieth vector."""
    items = read(spark, sf_dir, "embeddings")
    top = retrieval.vector_top(items, items.where("vec_id % 50 = 0"), 5)
    return top.select(F.col("query").alias("query_id"), "rank", F.col("item").alias("vec_id"), "score")


@query("""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) * CASE WHEN v.label % 2 = 0 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END
            + CASE WHEN contains('show v' || q.label || ' items', 'v' || v.label) THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END, 6) AS score
        FROM embeddings q CROSS JOIN embeddings v WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5""")
def boosted_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[boost] The same with weights for kinds of items and for names that the question has."""
    kind, name = F.when(F.col("label") % 2 == 0, "component").otherwise("chunk"), F.concat(F.lit("v"), "label")
    items = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", kind.alias("kind"), name.alias("name"), F.concat(F.lit("show v"), "label", F.lit(" items")).alias("question"))
    top = retrieval.vector_top(items, items.where("vec_id % 50 = 0"), 5, kind="kind", name="name", question="question")
    return top.select(F.col("query").alias("query_id"), "rank", F.col("item").alias("vec_id"), "score")


@query()
def hash_embedding_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[embedding provider] Documents by vectors of hashed words; test_hash_embedding_top5 holds it against a plain loop."""
    docs = embed.embedded(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "embedding")
    asked = embed.embedded(read(spark, sf_dir, "benchmark").select("item_id", "text")).select(F.col("item_id").alias("doc_id"), "embedding")
    top = retrieval.vector_top(docs, asked, 5, "doc_id")
    return top.select(F.col("query").alias("item_id"), "rank", F.col("item").alias("doc_id"), "score")


# ---------------------------------------------------------------- texts, tags, patterns


@query("""WITH l AS (SELECT page_id, regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1) AS t FROM pages),
    e AS (SELECT page_id, unnest(t) AS tag, generate_subscripts(t, 1) AS i FROM l), f AS (SELECT page_id, tag, min(i) AS i FROM e GROUP BY ALL)
    SELECT page_id, string_agg(tag, ',' ORDER BY i) AS tags FROM f GROUP BY page_id""")
def tags_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[tags, distinct in order] The tags of each page in the order of their first occurrence."""
    tags = js.first_seen(F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)))
    return read(spark, sf_dir, "pages").select("page_id", js.joined(tags, ",").alias("tags")).where("tags <> ''")


@query("""WITH e AS (SELECT regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM pages)
    SELECT lang, tag, count(*) AS n FROM e GROUP BY ROLLUP (lang, tag)""")
def chunk_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[row counts] Tags by language, with totals."""
    tags = F.explode(F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)))
    rows = read(spark, sf_dir, "pages").select(F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"), tags.alias("tag"))
    return rows.rollup("lang", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT doc_id, regexp_extract_all(text, '([a-z]+) of ([^.]*?)[.]', 1) AS i, regexp_extract_all(text, '([a-z]+) of ([^.]*?)[.]', 0) AS t FROM documents)
    SELECT doc_id, (generate_subscripts(t, 1) - 1)::INT AS ord, unnest(i) AS id, 'clause' AS type, unnest(t) AS text FROM l""")
def regex_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[pattern chunks] All matches of a lazy pattern with their first group."""
    return extract.pattern_chunks(read(spark, sf_dir, "documents"), "([a-z]+) of ([^.]*?)[.]", "clause", "doc_id", "text")


@query("SELECT doc_id, CASE WHEN text IS NULL THEN '' WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS short FROM documents")
def shorten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[text cut]"""
    return read(spark, sf_dir, "documents").select("doc_id", js.shortened(F.col("text")).alias("short"))


@query("""WITH l AS (SELECT doc_id, regexp_extract_all(text, 'the ([a-z]+)', 1) AS w FROM documents)
    SELECT doc_id, len(w) <> len(list_distinct(w)) AS repeats FROM l""")
def dedup_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[duplicate test] Whether a name occurs twice among those that a pattern finds."""
    names = F.regexp_extract_all("text", F.lit("the ([a-z]+)"), F.lit(1))
    return read(spark, sf_dir, "documents").select("doc_id", (F.size(names) != F.size(F.array_distinct(names))).alias("repeats"))


@query("""SELECT p_partkey, chr(10) || 'export interface ' || p_brand_id || ' { onPick?: (e: any) => void; other: Partial<A1>; a: A1; b: A1[]; c: AB }' AS cleaned
    FROM (SELECT p_partkey, 'B' || regexp_extract(p_brand, '([0-9]+)', 1) AS p_brand_id FROM part)""")
def clean_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[React types, reference repair] Source text made of each part's columns, cleaned."""
    body = F.concat(
        F.lit('import React, { X } from "react";\nexport interface B'), F.regexp_extract("p_brand", "([0-9]+)", 1), F.lit(" { onPick?: (e: MouseEvent<HTMLElement>) => void; other: Partial<A>; a: A; b:   A[]; c: AB }")
    )
    return read(spark, sf_dir, "part").select("p_partkey", schema.repaired(schema.without_react_types(body), F.array(F.lit("A"))).alias("cleaned"))


@query("""SELECT c_custkey, c_mktsegment || row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS renamed FROM customer""")
def rename_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[occurrence numbers] Names numbered by their occurrence in a group."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey"))
    return read(spark, sf_dir, "customer").select("c_custkey", F.concat("c_mktsegment", n.cast("string")).alias("renamed"))


@query("""WITH p AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_replace(url, '^[a-z]+://', '/src/components/') ELSE url END AS path FROM pages),
    s AS (SELECT page_id, path, string_split(path, '/') AS l FROM p)
    SELECT page_id, CASE WHEN list_position(l, 'components') > 0 THEN coalesce(l[list_position(l, 'components') + 1], 'unknown') ELSE 'unknown' END AS component,
        l[-1] AS file_name, regexp_extract(l[-1], '[^.].*?([.][^.]*)$', 1) AS extension, regexp_replace(path, '/[^/]*$', '') AS folder FROM s""")
def path_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[component, name, extension of paths]"""
    path = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "^[a-z]+://", "/src/components/")).otherwise(F.col("url"))
    rows = read(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    name = files.file_name_of(F.col("path"))
    return rows.select("page_id", files.component_of_path(F.col("path")).alias("component"), name.alias("file_name"), files.extension_of(name).alias("extension"), files.folder_of(F.col("path")).alias("folder"))


# ---------------------------------------------------------------- properties and schemas

_NAMES = """(SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'onMouse' WHEN 1 THEN 'aria-' WHEN 2 THEN 'color' WHEN 3 THEN 'href' WHEN 4 THEN 'once' WHEN 5 THEN 'x' ELSE '' END || event_type AS name FROM events)"""


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.element_at(F.array(*map(F.lit, ("onMouse", "aria-", "color", "href", "once", "x", ""))), (F.col("event_id") % 7 + 1).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", F.concat(heads, "event_type").alias("name"))


@query(f"SELECT event_id, name, CASE WHEN starts_with(name, 'on') THEN 'event' WHEN contains(lower(name), 'ref') THEN 'ref' ELSE 'property' END AS kind FROM {_NAMES}")
def prop_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[kinds of properties]"""
    return _names(spark, sf_dir).withColumn("kind", schema.property_kind(F.col("name")))


@query(f"""SELECT event_id, name FROM {_NAMES} WHERE NOT ({" OR ".join(f"starts_with(name, '{p}')" for p in chunks.DULL_PROPS)})""")
def blacklist_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[dull properties]"""
    return _names(spark, sf_dir).where(chunks.useful_prop(F.col("name")))


@query("""SELECT event_id, key, json_extract_string(props, '$."' || key || '"') AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)""")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[JSON to rows]"""
    return read(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


@query("""WITH v AS (SELECT 'C' || p_partkey AS c, p_brand AS b, p_type AS t, CASE WHEN p_size % 2 = 0 THEN p_name END AS said FROM part),
    x AS (SELECT c, b, t, said, unnest([
        {'d': c || 'Props', 'n': 'label', 'k': 'property', 'y': 'number', 'l': NULL, 's': NULL, 'e': NULL, 'x': 'label property of ' || c || ' component.'},
        {'d': c || 'Props', 'n': 'onPick', 'k': 'event', 'y': NULL, 'l': NULL, 's': '() => void', 'e': NULL, 'x': 'Callback function triggered when pick occurs in ' || c || '.'},
        {'d': c || 'Props', 'n': 'once', 'k': 'event', 'y': NULL, 'l': NULL, 's': 'unknown', 'e': NULL, 'x': 'Callback function triggered when ce occurs in ' || c || '.'},
        {'d': c || 'Props', 'n': 'innerRef', 'k': 'ref', 'y': 'ref', 'l': NULL, 's': NULL, 'e': NULL, 'x': 'innerRef property of ' || c || ' component.'},
        {'d': c || 'Props', 'n': 'items', 'k': 'property', 'y': 'Node[]', 'l': 'Node', 's': NULL, 'e': NULL, 'x': 'items property of ' || c || ' component.'},
        {'d': c || 'Props', 'n': 'sizes', 'k': 'property', 'y': 'number[]', 'l': NULL, 's': NULL, 'e': NULL, 'x': 'sizes property of ' || c || ' component.'},
        {'d': c || 'Props', 'n': 'bag', 'k': 'property', 'y': 'array', 'l': NULL, 's': NULL, 'e': NULL, 'x': 'bag property of ' || c || ' component.'},
        {'d': c || 'Props', 'n': 'kind', 'k': 'property', 'y': 'string', 'l': NULL, 's': NULL, 'e': b || '|' || t, 'x': 'kind can be one of: ' || b || ', ' || t || '.'},
        {'d': c || 'Props', 'n': 'flag', 'k': 'property', 'y': 'boolean', 'l': NULL, 's': NULL, 'e': NULL, 'x': coalesce(said, 'Boolean flag to control flag behavior in ' || c || '.')},
        {'d': c || 'Props', 'n': 'multi', 'k': 'property', 'y': 'string,number', 'l': NULL, 's': NULL, 'e': NULL, 'x': 'multi property of ' || c || ' component.'},
        {'d': c || 'Props', 'n': 'link', 'k': 'property', 'y': 'Other', 'l': 'Other', 's': NULL, 'e': NULL, 'x': 'link property of ' || c || ' component.'},
        {'d': c || 'Props', 'n': 'free', 'k': 'property', 'y': 'any', 'l': NULL, 's': NULL, 'e': NULL, 'x': 'free property of ' || c || ' component.'},
        {'d': c || 'Props', 'n': 'extra', 'k': 'property', 'y': 'boolean', 'l': NULL, 's': NULL, 'e': NULL, 'x': 'Boolean flag to control extra behavior in ' || c || '.'},
        {'d': 'Node', 'n': 'id', 'k': 'property', 'y': 'string', 'l': NULL, 's': NULL, 'e': NULL, 'x': 'id property of ' || c || ' component.'}]) AS r FROM v)
    SELECT c AS component, r.d AS definition, r.d <> c || 'Props' AS is_sub_type, r.n AS name, r.x AS description, r.k AS type, r.y AS data_type, r.e AS enum, r.l AS links_to, r.s AS signature FROM x""")
def schema_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[inherited properties, type resolution, description, flattening] Schema documents made of each part's columns."""
    rows = schema.schema_chunks(part_schemas(spark, sf_dir))
    return rows.select("component", "definition", F.col("isSubType").alias("is_sub_type"), "name", "description", "type", F.col("dataType").alias("data_type"), F.array_join("enum", "|").alias("enum"), F.col("linksTo").alias("links_to"), "signature")


@query("""WITH d AS (SELECT p_brand || '-' || p_size AS component, CASE p_partkey % 5 WHEN 0 THEN p_brand || '-' || p_size || 'Props' WHEN 1 THEN 'My' || p_size || 'PROPS' WHEN 2 THEN 'Data' || p_size ELSE 'Z' || p_size END AS definition, p_type AS body, p_partkey FROM part),
    r AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY CASE WHEN definition = component || 'Props' THEN 1 WHEN contains(lower(definition), 'props') THEN 2
        WHEN contains(lower(definition), 'data') THEN 3 ELSE 4 END, p_partkey) AS n FROM d)
    SELECT component, definition, body FROM r WHERE n = 1""")
def schema_select_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[schema selection] Of each brand and size, whose definitions begin at any priority."""
    m, component = F.col("p_partkey") % 5, F.concat_ws("-", "p_brand", "p_size")
    name = F.when(m == 0, F.concat(component, F.lit("Props"))).when(m == 1, F.concat(F.lit("My"), "p_size", F.lit("PROPS"))).when(m == 2, F.concat(F.lit("Data"), "p_size")).otherwise(F.concat(F.lit("Z"), "p_size"))
    rows = read(spark, sf_dir, "part").select(component.alias("component"), name.alias("definition"), F.col("p_type").alias("body"), F.col("p_partkey").alias("ord"))
    return schema.selected(rows)


@query("""WITH RECURSIVE e AS (SELECT a.n_name AS owner, lower(a.n_name) AS name, 'T' || a.n_regionkey AS said, b.n_name AS target FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey * 7 + 3) % 25
        UNION ALL SELECT a.n_name, 'r' || a.n_nationkey, b.n_name, b.n_name FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey + 5) % 25),
    reached(root, path, seen, depth, name, said, target) AS (SELECT owner, name, [owner], 1, name, said, target FROM e
        UNION ALL SELECT r.root, r.path || '.' || e.name, list_append(r.seen, e.owner), r.depth + 1, e.name, e.said, e.target FROM reached r JOIN e ON e.owner = r.target
        WHERE r.depth <= 4 AND NOT list_contains(r.seen, r.target))
    SELECT root, path, depth::INT AS depth, name, said FROM reached""")
def type_recursion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[recursive types] All property paths along cyclic references, to a depth."""
    n = read(spark, sf_dir, "nation")
    b = n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("target"))
    one = n.join(b, F.col("k") == (F.col("n_nationkey") * 7 + 3) % 25).select(F.col("n_name").alias("owner"), F.lower("n_name").alias("name"), F.concat(F.lit("T"), "n_regionkey").alias("said"), "target")
    two = n.join(b, F.col("k") == (F.col("n_nationkey") + 5) % 25).select(F.col("n_name").alias("owner"), F.concat(F.lit("r"), "n_nationkey").alias("name"), F.col("target").alias("said"), "target")
    return schema.type_tree(spark, one.unionByName(two), 4)


# ---------------------------------------------------------------- joins and aggregates


@query("SELECT d.doc_id, coalesce(l.quality, -1)::INT AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[left lookup]"""
    rows = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce("quality", F.lit(-1)).cast("int").alias("quality"))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def exists_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[existence]"""
    return read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[absence]"""
    return read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""SELECT l_orderkey, string_agg(l_partkey || ':' || coalesce(p_type, ''), '; ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS dependencies
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey""")
def enriched_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[dependencies with their schemas] Unnest, left join, nest again in order."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(read(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"), "left")
    line = F.concat("l_partkey", F.lit(":"), F.coalesce("p_type", F.lit("")))
    return rows.groupBy("l_orderkey").agg(js.joined(js.in_order(line, F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")), "; ").alias("dependencies"))


@query("""SELECT user_id, event_type AS last_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[last value]"""
    return read(spark, sf_dir, "events").groupBy("user_id").agg(js.last_wins(F.col("event_type"), F.col("ts"), F.col("event_id")).alias("last_type"))


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[windows of a stream, run as a batch]"""
    return streams.windowed_counts(read(spark, sf_dir, "events"), watermark=None)


# ---------------------------------------------------------------- chunks of components

_REC = """n AS (SELECT r_name AS c, n_name AS n, n_nationkey AS k, CASE WHEN n_nationkey % 2 = 1 THEN lower(n_name) ELSE n_name END AS m FROM region JOIN nation ON r_regionkey = n_regionkey)"""


@query(f"""WITH {_REC},
    props AS (SELECT c, list(CASE WHEN k % 3 = 0 THEN n || ' (string)' WHEN k % 3 = 1 THEN n || ' (ref)' ELSE n END ORDER BY k)[1:10] AS l FROM n WHERE k % 4 <> 0 GROUP BY c),
    tags AS (SELECT c, list(m ORDER BY k)[1:5] AS l FROM n WHERE k % 2 = 0 GROUP BY c),
    b AS (SELECT 1 AS b, 0 AS k, c, 'overview' AS type, c || ' is a UI component composed of ' || string_agg(n, ', ' ORDER BY k) || ' that manages state.' AS text FROM n GROUP BY c
        UNION ALL SELECT 2, 0, c, 'props', c || ' accepts props: ' || array_to_string(l, ', ') FROM props
        UNION ALL SELECT 3, 0, c, 'dependencies', c || ' depends on: ' || string_agg(n, ', ' ORDER BY k) FROM n WHERE k % 3 <> 0 GROUP BY c
        UNION ALL SELECT 4, 0, c, 'composition', c || ' is composed of: ' || string_agg(n, ', ' ORDER BY k) FROM n GROUP BY c
        UNION ALL SELECT 5, 0, c, 'render_flow', c || ' renders ' || array_to_string(l, ', ') FROM tags
        UNION ALL SELECT 6, k, c, 'state', c || ' manages state: ' || CASE WHEN length(repeat(n || ' ', k)) > 200 THEN left(repeat(n || ' ', k), 200) || '...' ELSE repeat(n || ' ', k) END FROM n
        UNION ALL SELECT 7, k, c, CASE WHEN k % 2 = 0 THEN 'subcomponent' ELSE 'function_summary' END, m || CASE WHEN k % 2 = 0 THEN ' is a reusable UI subcomponent' ELSE ' is a helper logic function' END FROM n
        UNION ALL SELECT 8, k, c, 'example', '<' || m || ' />' FROM n WHERE k % 2 = 0
        UNION ALL SELECT DISTINCT 9, 0, c, 'example', '<' || c || ' />' FROM n)
    SELECT c AS component, (row_number() OVER (PARTITION BY c ORDER BY b, k) - 1)::INT AS ord, type, text FROM b""")
def rag_chunks_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[retrieval chunks] All kinds of chunks of component records, in order."""
    return chunks.rag_chunks(region_records(spark, sf_dir))


@query(f"""WITH {_REC},
    b AS (SELECT DISTINCT 1 AS b, 0 AS k, c, 'behavior' AS type, NULL AS name, c || ' uses React useState hook for internal state management.' AS text FROM n
        UNION ALL SELECT 2, k, c, 'dependency', NULL, c || ' imports and uses ' || n || ' component.' FROM n
        UNION ALL SELECT 3, k, c, 'render', NULL, c || ' renders ' || m || ' component in JSX.' FROM n
        UNION ALL SELECT 4, k, c, 'function', m, c || ' contains function ' || m || ': code of ' || n FROM n)
    SELECT c AS component, (row_number() OVER (PARTITION BY c ORDER BY b, k) - 1)::INT AS ord, type, name, text FROM b""")
def knowledge_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[knowledge chunks]"""
    return chunks.knowledge_chunks(region_records(spark, sf_dir).withColumn("dependencies", F.col("internalComponents")))


@query("""SELECT p_brand || '_props' AS id, p_brand AS component, 'component-props' AS type, p_brand || ' component props ' || string_agg(p_name || ' ' || p_type, ' ' ORDER BY p_partkey) AS text FROM part WHERE p_size % 7 > 0 GROUP BY p_brand""")
def component_props_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[property texts, entries without properties] One text for each brand."""
    props = F.when(F.col("p_size") % 7 > 0, F.array(F.struct(F.col("p_name").alias("name"), F.col("p_type").alias("type"))))
    entries = read(spark, sf_dir, "part").select(F.col("p_brand").alias("component"), F.col("p_partkey").alias("ord"), props.alias("properties"))
    return chunks.component_props(entries).drop("metadata")


@query("""SELECT p_partkey, 'The ' || p_brand || ' component has a property called "' || coalesce(CASE WHEN p_size % 3 > 0 THEN p_name END, 'undefined') || '".' || chr(10) || chr(10) || 'Type: ' || p_type || chr(10) || chr(10) || 'Description:' || chr(10)
        || 'No description provided.' || chr(10) || chr(10) || 'Code:' AS chunk_text,
    'This is the full implementation of the ' || p_brand || ' component.' || chr(10) || chr(10) || 'Code:' || chr(10) || p_name AS component_text FROM part""")
def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[texts for embedding]"""
    name = F.when(F.col("p_size") % 3 > 0, F.col("p_name"))
    return read(spark, sf_dir, "part").select(
        "p_partkey", embed.chunk_text(F.col("p_brand"), name, F.col("p_type"), F.lit(""), F.lit("")).alias("chunk_text"), embed.component_text(F.col("p_brand"), F.col("p_name")).alias("component_text")
    )


# ---------------------------------------------------------------- source files


@query("""WITH c AS (SELECT 'C' || p_partkey AS c, p_type, p_size FROM part),
    b AS (SELECT c, unnest([
        {'o': 0, 't': 'overview', 'x': c || ' is a UI component composed of Inner that manages state.'},
        {'o': 1, 't': 'props', 'x': c || ' accepts props: label (string), onPick, once, innerRef, items (array), sizes (array), bag (array), kind (string), flag (boolean), multi (string,number)'},
        {'o': 2, 't': 'dependencies', 'x': c || ' depends on: IThing, Dep'}, {'o': 3, 't': 'composition', 'x': c || ' is composed of: Inner'},
        {'o': 4, 't': 'render_flow', 'x': c || ' renders Dep, Inner, Foo.Bar'}, {'o': 5, 't': 'state', 'x': c || ' manages state: [s, setS] = useState<string>("' || p_type || '")'},
        {'o': 6, 't': 'function_summary', 'x': 'helper is a helper logic function'}, {'o': 7, 't': 'subcomponent', 'x': 'Inner is a reusable UI subcomponent'},
        {'o': 8, 't': 'example', 'x': '<Inner />'}, {'o': 9, 't': 'example', 'x': '<' || c || ' />'}]) AS r FROM c)
    SELECT c AS component, r.o::INT AS ord, r.t AS type, r.x AS text FROM b""")
def merged_rag_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[records with schemas, retrieval chunks] From sources and schema documents to chunks in one plan."""
    records = extract.records(ts_nodes(sources(spark, sf_dir)))
    chosen = schema.selected(schema.exploded_definitions(part_schemas(spark, sf_dir))).select("component", F.to_json(F.create_map("definition", "body")).alias("schema"))
    merged = schema.with_schemas(records, chosen)
    return chunks.rag_chunks(merged.withColumn("schema", F.from_json("schema", schema.MAP)))


@query("""SELECT 'C' || p_partkey AS component, 'src/components/C' || p_partkey || '.tsx' AS file, 'IThing,Dep' AS dependencies, 'Dep,Inner,Foo.Bar' AS jsx_usage, 'Inner' AS internal_components,
    '[s, setS] = useState<string>("' || p_type || '")' AS state,
    'helper|const helper = (x: number): number => x + ' || p_size || ';#Inner|const Inner = () => <Dep v={`<${s}> ${helper(1)}`} />;' AS functions FROM part""")
def component_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[imports, state, functions, internal components, tags] Records of TSX sources made of each part's columns."""
    rows = extract.records(ts_nodes(sources(spark, sf_dir)))
    return rows.select(
        "component", "file", js.joined(F.col("dependencies"), ",").alias("dependencies"), js.joined(F.col("jsxUsage"), ",").alias("jsx_usage"), js.joined(F.col("internalComponents"), ",").alias("internal_components"),
        js.joined(F.transform("state", lambda s: s["code"]), "#").alias("state"), js.joined(F.transform("functions", lambda f: F.concat(f["name"], F.lit("|"), f["code"])), "#").alias("functions"),
    )


@query("""SELECT 'babel' AS parser, 'Inner' AS component, CASE WHEN p_partkey % 2 = 0 THEN 'C' || p_partkey || 'Props' ELSE '' END AS props_interface, 'src/components/C' || p_partkey || '.tsx' AS file FROM part
    UNION ALL SELECT 'typescript', 'Inner', '', 'src/components/C' || p_partkey || '.tsx' FROM part UNION ALL SELECT 'tree-sitter', 'Inner', NULL, 'src/components/C' || p_partkey || '.tsx' FROM part""")
def front_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[three front ends] The last component of each file and its interface."""
    rows = extract.front_ends(ts_nodes(sources(spark, sf_dir)))
    return rows.withColumnRenamed("propsInterface", "props_interface")


@query("""WITH k AS (SELECT 'src/components/C' || p_partkey || '.tsx' AS file FROM part)
    SELECT file, 'VariableStatement' AS kind, 4 AS n FROM k UNION ALL SELECT file, 'ArrowFunction', 3 FROM k""")
def ast_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[syntax chunks] Chunks of each file by kind."""
    rows = extract.ast_chunks(ts_nodes(sources(spark, sf_dir)))
    kind = F.when(F.col("text").rlike("^(const|export)"), "VariableStatement").otherwise("ArrowFunction")
    return rows.groupBy("file", kind.alias("kind")).agg(F.count(F.lit(1)).cast("int").alias("n"))


# ---------------------------------------------------------------- answers

_CODE = " OR ".join(f"contains(lower(text), '{w}')" for w in answer.CODE_WORDS)


@query(f"SELECT conv_id, turn, {_CODE} AS code FROM conversations")
def code_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[kind of request]"""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", answer.code_request(F.col("text")).alias("code"))


@query("""SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN role || '.t' || turn || ': q' ELSE text END, chr(10) ORDER BY turn, text) AS context FROM conversations GROUP BY conv_id""")
def context_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[context of a prompt]"""
    line = answer.context_line(F.when(F.col("role") == "user", "property").otherwise("x"), F.col("role"), F.concat(F.lit("t"), "turn"), F.lit("q"), F.col("text"))
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(js.joined(js.in_order(line, F.col("turn"), F.col("text")), "\n").alias("context"))


@query("""WITH q AS (SELECT conv_id, turn, text || ' about ' || n_name AS question FROM conversations JOIN nation ON n_nationkey = (conv_id + turn) % 25)
    SELECT conv_id, turn, question, n_nationkey FROM q JOIN nation ON contains(lower(question), lower(n_name))""")
def theta_component_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[names in a question] A join by containment of whole names; questions are made to name a nation."""
    asked, names = read(spark, sf_dir, "conversations"), read(spark, sf_dir, "nation")
    named = asked.join(names.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n")), F.col("k") == (F.col("conv_id") + F.col("turn")) % 25)
    asked = named.select("conv_id", "turn", F.concat("text", F.lit(" about "), "n").alias("question"))
    return contains_join(asked, names, "question", "n_name").select("conv_id", "turn", "question", "n_nationkey")


@query("""WITH n AS (SELECT count(*) AS n FROM part), q AS (SELECT conv_id, turn, text || ' of ' || p_type AS question FROM conversations, n JOIN part ON p_partkey = 1 + (conv_id * 31 + turn) % n),
    w AS (SELECT DISTINCT p_type AS name FROM part UNION SELECT p_brand FROM part UNION SELECT p_name FROM part UNION SELECT 'part ' || p_partkey FROM part)
    SELECT conv_id, turn, name FROM q JOIN w ON contains(lower(question), lower(name))""")
def names_in_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[names in a question, both sides large] Names, brands and types of all parts in all turns of conversations."""
    part = read(spark, sf_dir, "part")
    n = part.count()
    asked = read(spark, sf_dir, "conversations").withColumn("p_partkey", 1 + (F.col("conv_id") * 31 + F.col("turn")) % n)
    asked = asked.join(part.select("p_partkey", "p_type"), "p_partkey").select("conv_id", "turn", F.concat("text", F.lit(" of "), "p_type").alias("question"))
    said = F.array("p_type", "p_brand", "p_name", F.concat(F.lit("part "), "p_partkey"))
    return contains_join(asked, part.select(F.explode(said).alias("name")).distinct()).select("conv_id", "turn", "name")


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query(f"""SELECT conv_id, turn, md5(replace(replace(CASE WHEN {_CODE} THEN {_sql_text(answer.CODE_PROMPT)} ELSE {_sql_text(answer.QA_PROMPT)} END, '{{context}}', role), '{{question}}', text)) AS prompt_md5 FROM conversations""")
def prompt_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[prompts and their routing]"""
    rows = read(spark, sf_dir, "conversations")
    prompt = F.when(answer.code_request(F.col("text")), answer.filled(answer.CODE_PROMPT, F.col("role"), F.col("text"))).otherwise(answer.filled(answer.QA_PROMPT, F.col("role"), F.col("text")))
    return rows.select("conv_id", "turn", F.md5(prompt.cast("binary")).alias("prompt_md5"))


from loam.plans import answer_queries, scope_queries, source_queries  # noqa: E402,F401  (they register theirs)
