"""The operators that SQL can express, as DuckDB runs them: all pairs and recursive searches, for small tables."""

from __future__ import annotations

from loam.llm.urls import RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


NGRAM_JOIN = rf"""WITH RECURSIVE
    w AS (SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
    d AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
    k AS (SELECT doc_id, s, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS h FROM d),
    c AS (SELECT h, min(doc_id) AS rep, count(*) AS docs, any_value(s) AS s, any_value(n) AS n FROM k WHERE n > 0 GROUP BY h),
    t AS (SELECT h, unnest(s) AS x FROM c),
    p AS (SELECT a.h AS a, b.h AS b, count(*) AS i FROM t a JOIN t b USING (x) WHERE a.h < b.h GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN c x ON x.h = a JOIN c y ON y.h = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    reach(a, b) AS (SELECT h, h FROM c UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
    comp AS (SELECT r.a AS h, min(c.rep) AS component_id FROM reach r JOIN c ON c.h = r.b GROUP BY r.a),
    links AS (SELECT e.a AS h, sum(c.docs) AS m FROM e JOIN c ON c.h = e.b GROUP BY e.a)
    SELECT k.doc_id, k.n AS n_shingles, coalesce(comp.component_id, k.doc_id) AS component_id, CASE WHEN k.n = 0 THEN 0 ELSE (coalesce(links.m, 0) + c.docs - 1)::BIGINT END AS n_links
    FROM k LEFT JOIN c USING (h) LEFT JOIN comp USING (h) LEFT JOIN links USING (h)"""

KNN = """WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5"""


def _host(url: str) -> str:
    return f"coalesce({_lower(f"regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1)")}, '')"


def _normal(url: str) -> str:
    """One form of equal URLs."""
    bare = f"regexp_replace(trim({url}), '(?s)#.*$', '')"
    rest = f"regexp_extract({bare}, '(?s)^.*?://[^/?#]*(.*)$', 1)"
    return f"""CASE WHEN contains({bare}, '://') THEN {_lower(f"regexp_extract({bare}, '(?s)^(.*?)://', 1)")} || '://' || {_host(bare)} || CASE WHEN starts_with({rest}, '/') THEN {rest} ELSE '/' || {rest} END ELSE {bare} END"""


def _resolved(base: str, link: str) -> str:
    """A link as its page understands it."""
    site, folder = f"regexp_extract({base}, '(?s)^(.*?://[^/?#]*)', 1)", f"regexp_extract({base}, '(?s)^(.*?://[^?#]*/)', 1)"
    return f"""CASE WHEN regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {link} WHEN starts_with({link}, '//') THEN regexp_extract({base}, '(?s)^(.*?)://', 1) || ':' || {link}
        WHEN starts_with({link}, '/') THEN {site} || {link} WHEN starts_with({link}, '?') THEN regexp_extract({base}, '(?s)^(.*?://[^?#]*)', 1) || {link} WHEN {folder} <> '' THEN {folder} || {link} ELSE {site} || '/' || {link} END"""


def _case(value: int, host: str = "host", path: str = "path") -> str:
    """The longest rule that fits, or its verdict."""
    whens = []
    for rule in sorted(RULES, key=lambda r: (-len(r[1]), r[0] != "allow")):
        of, _, rest = rule[1].partition("/")
        whens.append(f"WHEN ({host} = '{of}' OR ends_with({host}, '.{of}')) AND starts_with({path}, '/{rest}') THEN '{rule[value]}'")
    return f"CASE {' '.join(whens)} END"


_PATH = r"coalesce(regexp_extract({0}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"

URL_FILTER = rf"""WITH RECURSIVE
    tags AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*>')) AS tag, 'href' AS key FROM pages WHERE url IS NOT NULL UNION ALL SELECT url, unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*>')), 'url' FROM pages WHERE url IS NOT NULL),
    raw AS (SELECT url, regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1) AS link FROM tags WHERE key = 'href' AND regexp_matches(tag, '(?is)\brel\s*=\s*["'']?canonical\b')
        UNION ALL SELECT url, regexp_extract(tag, '(?is)\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1) FROM tags WHERE key = 'url' AND regexp_matches(tag, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b')
        UNION ALL SELECT url, unnest(regexp_extract_all(html, '(?i)\blocation(?:\.href)?\s*=\s*["'']([^"'']+)["'']', 1)) FROM pages WHERE url IS NOT NULL
        UNION ALL SELECT url, unnest(regexp_extract_all(html, '(?i)\blocation\.replace\(\s*["'']([^"'']+)["'']', 1)) FROM pages WHERE url IS NOT NULL),
    found AS (SELECT url, replace(trim(link), '&amp;', '&') AS link FROM raw WHERE link <> ''),
    edges AS (SELECT DISTINCT {_normal('url')} AS src, {_normal(f"({_resolved('url', 'link')})")} AS dst FROM found),
    both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
    reach(a, b) AS (SELECT src, src FROM both_ways UNION SELECT r.a, e.dst FROM reach r JOIN both_ways e ON e.src = r.b),
    told AS (SELECT a, {_case(0, _host('b'), _PATH.format('b'))} AS v FROM reach),
    blocked AS (SELECT a FROM told GROUP BY a HAVING bool_or(coalesce(v = 'block', false)) AND NOT bool_or(coalesce(v = 'allow', false))),
    p AS (SELECT page_id, {_normal('url')} AS u, {_host('url')} AS host, {_PATH.format('url')} AS path FROM pages),
    r AS (SELECT *, {_case(1)} AS rule, {_case(0)} AS v, u IN (SELECT a FROM blocked) AS alias FROM p)
    SELECT page_id, host, path, rule, coalesce(v, CASE WHEN alias THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN rule IS NOT NULL THEN 'rule' WHEN alias THEN 'alias' ELSE 'default' END AS by FROM r"""

#: Documents of equal flags are counted first here; the operator replays each one.
FILTER_AUDIT = r"""WITH
    d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    e AS (SELECT *, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS again FROM d),
    g AS (SELECT part, (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
        || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN again THEN 'E' ELSE '' END) AS fs,
        doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) IS TRUE AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) IS TRUE AS toxic FROM e),
    h AS (SELECT part, fs, good, toxic, count(*) AS n FROM g GROUP BY ALL),
    l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    r AS (SELECT h.*, o, CASE WHEN fs = '' THEN 6 ELSE list_min(list_transform(string_split(fs, ''), lambda x: strpos(o, x))) END AS first FROM h, o),
    s AS (SELECT *, i::INT AS step, substr(o, i::INT, 1) AS f FROM r, (SELECT unnest(range(1, 6)) AS i)),
    c AS (SELECT part, o AS filter_order, step, f, coalesce(sum(n) FILTER (first > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (first = step), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (contains(fs, f) AND first < step), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fs = f), 0)::BIGINT AS unique_fails,
        coalesce(sum(n) FILTER (first = step AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (first = step AND toxic), 0)::BIGINT AS toxic_lost FROM s GROUP BY ALL)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM c"""


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({v})::VARCHAR || ':' || {v}, '-')" for v in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"


def _crc32(text: str) -> str:
    """Unsigned crc32 of an ASCII text, bit by bit."""
    bits = "list_reduce(list_concat([xor(a, b)], [0::BIGINT FOR i IN range(8)]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], [ascii(c)::BIGINT FOR c IN string_split({text}, '')]), lambda a, b: {bits}), 4294967295)"


def _tree(leaves: str) -> str:
    """Recursive levels above rows of (g, nodes)."""
    return f"SELECT g, 0 AS level, nodes FROM {leaves} UNION ALL SELECT g, level + 1, [sha256(array_to_string(nodes[i + 1:i + 3], '')) FOR i IN range(0, len(nodes), 3)] FROM {{}} WHERE len(nodes) > 1"


def _runs(at: str) -> str:
    """left|right of the node above place `at` on each level."""
    own = f"({at} // (3 ** level)::BIGINT)"
    run = f"({own} - {own} % 3)"
    return f"list(array_to_string(nodes[{run} + 1:{own}], '') || '|' || array_to_string(nodes[{own} + 2:{run} + 3], '') ORDER BY level) FILTER (len(nodes) > 1)"


MERKLE = f"""WITH RECURSIVE
    f AS (SELECT doc_id, coalesce('=' || source, '') AS g, {_leaf('text')} AS leaf, CASE WHEN {_crc32('doc_id::VARCHAR')} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS now FROM documents),
    p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM f),
    b AS (SELECT g, list(leaf ORDER BY pos) AS nodes FROM p GROUP BY g),
    t AS ({_tree('b').format('t')}),
    sub AS (SELECT g, nodes[1] AS subroot, row_number() OVER (ORDER BY g) - 1 AS place FROM t WHERE len(nodes) = 1),
    c AS (SELECT '' AS g, list(subroot ORDER BY place) AS nodes FROM sub),
    u AS ({_tree('c').format('u')}),
    root AS (SELECT nodes[1] AS root FROM u WHERE len(nodes) = 1),
    low AS (SELECT p.doc_id, p.g, p.pos, any_value(p.leaf) AS leaf, any_value(p.now) AS now, coalesce({_runs('p.pos')}, []) AS runs FROM p JOIN t USING (g) GROUP BY p.doc_id, p.g, p.pos),
    high AS (SELECT sub.g, sub.subroot, coalesce({_runs('sub.place')}, []) AS above FROM sub, u GROUP BY sub.g, sub.subroot, sub.place),
    m AS (SELECT doc_id, leaf, now, subroot, root, list_concat(runs, above) AS proof FROM low JOIN high USING (g), root),
    o AS (SELECT *, list_reduce(list_concat([now], proof), lambda a, b: sha256(split_part(b, '|', 1) || a || split_part(b, '|', 2))) AS folded_root FROM m)
    SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(proof, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM o"""

WARC = """WITH
    p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
    q AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest, CASE WHEN octet_length(b) >= 1000 THEN max(page_id) OVER (PARTITION BY b) END AS latest FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN latest IS NOT NULL AND page_id IS DISTINCT FROM latest THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN page_id IS DISTINCT FROM latest THEN latest END AS refers_to FROM q"""
