"""Registered queries from chunks to answers: columns of scores, indexes, search, prompts, and the fixed questions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from loam.operators import answer, embed, retrieval
from loam.plans import rag
from loam.plans.catalogue import _CODE, _cut
from loam.plans.registry import query
from loam.plans.shapes import sql_text
from loam.plans.tables import read
from loam.sources import stores

#: Letters whose counts stand for a text in the queries that SQL can follow.
_LETTERS = "aeionrst"


def letter_counts(texts: list[str]) -> list[list[float]]:
    """A provider of vectors that SQL can compute too: how often a few letters occur, and one."""
    return [[float(t.lower().count(c)) for c in _LETTERS] + [1.0] for t in texts]


def _vector(text: str) -> str:
    return "[" + ", ".join(f"(length({text}) - length(replace(lower({text}), '{c}', '')))::DOUBLE" for c in _LETTERS) + ", 1.0::DOUBLE]"


@query("""SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS dot
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[sums of products and cosine as columns] Every vector and the next one."""
    a = read(spark, sf_dir, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(retrieval.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"), F.round(retrieval.dot(F.col("embedding"), F.col("other")), 4).alias("dot"))


@query("""SELECT conv_id, turn, role, len(list_filter(string_split('the  of Ing ' || role, ' '), lambda w: contains(lower(text), lower(w))))::INT AS score FROM conversations""")
def keyword_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[keyword score as a column] With an empty word, which always counts."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", retrieval.keyword_score(F.concat(F.lit("the  of Ing "), "role"), F.col("text")).alias("score"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 5")
def first_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[the first five documents, for a look]"""
    return read(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy("doc_id").limit(5)


_ASKED = ", ".join(f"({i}, {sql_text(q)})" for i, q in enumerate(retrieval.QUESTIONS))


def _benchmark(chunks: str) -> str:
    """Of each strategy, how many of the fixed questions have a chunk with a word of theirs."""
    return f"""WITH q(query_id, question) AS (VALUES {_ASKED}), chunks AS ({chunks}), every(strategy) AS (VALUES ('first'), ('second')),
    words AS (SELECT DISTINCT query_id, unnest(string_split(lower(question), ' ')) AS w FROM q),
    there AS (SELECT DISTINCT strategy, w FROM (SELECT DISTINCT w FROM words) JOIN chunks ON contains(low, w)),
    n AS (SELECT strategy, count(DISTINCT query_id) AS correct FROM every JOIN words ON true JOIN there USING (strategy, w) GROUP BY strategy),
    f AS (SELECT e.strategy, coalesce(n.correct, 0) AS correct, 10 AS total, round(100.0::DOUBLE * coalesce(n.correct, 0) / 10, 2) AS accuracy FROM every e LEFT JOIN n USING (strategy))"""


@query(_benchmark("SELECT 'first' AS strategy, lower(unnest(string_split(text, chr(10)))) AS low FROM documents UNION ALL SELECT 'second', lower(unnest(string_split(text, '. '))) FROM documents") + " SELECT strategy, correct, total::BIGINT AS total, accuracy FROM f")
def question_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[the benchmark of ten fixed questions: correct where the best score is over 0, accuracy] Lines and sentences of
    all documents."""
    asked = spark.createDataFrame(list(enumerate(retrieval.QUESTIONS)), "query_id long, text string")
    docs = read(spark, sf_dir, "documents")
    tops = [retrieval.keyword_top(_cut(docs, cut), asked, 3).withColumn("strategy", F.lit(name)) for name, cut in (("first", "\n"), ("second", "\\. "))]
    return retrieval.accuracy(tops[0].unionByName(tops[1]), ["strategy"])


@query(_benchmark("SELECT 'first' AS strategy, lower(text) AS low FROM conversations UNION ALL SELECT 'second', lower(p_type || ' ' || p_brand) FROM part") + """,
    v AS (SELECT max(correct) FILTER (strategy = 'first') AS first, max(correct) FILTER (strategy = 'second') AS second FROM f)
    SELECT first, second, CASE WHEN first > second THEN 'first chunking performed better' WHEN second > first THEN 'second chunking performed better' ELSE 'Both strategies performed equally' END AS verdict FROM v""")
def compared_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[comparison of two sets of chunks by the fixed questions] Turns of conversations, types and brands of parts."""
    asked = spark.createDataFrame(list(enumerate(retrieval.QUESTIONS)), "query_id long, text string")
    turns = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), "text")
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id"), F.concat_ws(" ", "p_type", "p_brand").alias("text"))
    return rag.compare(spark, turns, parts, asked, ("first", "second"))


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of an index: a property chunk, a chunk with a text of its own, and a component, for each part."""
    part = read(spark, sf_dir, "part")
    none = F.lit(None).cast("string")
    name = F.concat(F.lit("C"), "p_partkey")
    props = part.select(name.alias("component"), F.lit("property").alias("type"), F.lower("p_brand").alias("name"), F.col("p_type").alias("dataType"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("description"), F.concat(F.lit("() => "), "p_size").alias("signature"), none.alias("text"))
    own = part.select(name.alias("component"), F.lit("render").alias("type"), none.alias("name"), none.alias("dataType"), none.alias("description"), none.alias("signature"), F.concat(name, F.lit(" renders "), "p_name").alias("text"))
    code = part.select(name.alias("component"), F.when(F.col("p_size") % 3 > 0, F.concat_ws(" ", "p_name", "p_type")).alias("code"))
    return embed.index(props.unionByName(own), code, letter_counts)


_ITEMS = f"""items AS (SELECT *, {_vector('text')} AS v FROM (
        SELECT p_partkey * 3 AS id, 'C' || p_partkey AS component, lower(p_brand) AS name, 'property' AS chunk_type, 'chunk' AS item_type, p_type AS dt,
            'The C' || p_partkey || ' component has a property called "' || lower(p_brand) || '".' || chr(10) || chr(10) || 'Type: ' || p_type || chr(10) || chr(10) || 'Description:' || chr(10) || CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'No description provided.' END || chr(10) || chr(10) || 'Code:' || chr(10) || '() => ' || p_size AS text FROM part
        UNION ALL SELECT p_partkey * 3 + 1, 'C' || p_partkey, NULL, 'render', 'chunk', NULL, 'C' || p_partkey || ' renders ' || p_name FROM part
        UNION ALL SELECT p_partkey * 3 + 2, 'C' || p_partkey, NULL, NULL, 'component', NULL, 'This is the full implementation of the C' || p_partkey || ' component.' || chr(10) || chr(10) || 'Code:' || chr(10) || p_name || ' ' || p_type FROM part WHERE p_size % 3 > 0))"""


@query(f"WITH {_ITEMS} SELECT component, name, chunk_type, item_type, dt AS data_type, text, array_to_string(list_transform(v, lambda x: x::INT), ',') AS vector FROM items")
def index_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[index of chunks and components with code, texts for embedding, provider] Vectors of letter counts."""
    vector = F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",")
    return _index(spark, sf_dir).select("component", "name", "chunk_type", "item_type", F.col("dataType").alias("data_type"), "text", vector.alias("vector"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each nation, some of which name a brand and some of which ask for code."""
    n, k = F.col("n_name"), F.col("n_nationkey")
    text = F.concat(F.when(k % 2 == 0, F.concat(F.lit("Create C"), k)).otherwise(F.lit("What of brand#")), F.when(k % 2 == 1, ((k % 5 + 1) * 10 + k % 4 + 1).cast("string")).otherwise(F.lit("")), F.lit(" in "), n)
    return read(spark, sf_dir, "nation").select(k.cast("long").alias("question_id"), text.alias("question"))


_RANKED = f"""{_ITEMS},
    q AS (SELECT *, {_vector('question')} AS w FROM (SELECT n_nationkey AS question_id, CASE WHEN n_nationkey % 2 = 0 THEN 'Create C' || n_nationkey ELSE 'What of brand#' || ((n_nationkey % 5 + 1) * 10 + n_nationkey % 4 + 1) END || ' in ' || n_name AS question FROM nation)),
    s AS (SELECT question_id, question, i.*, round(list_cosine_similarity(w, v) * CASE WHEN item_type = 'component' THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END + CASE WHEN contains(lower(question), lower(coalesce(name, component))) THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END, 6) AS score FROM q CROSS JOIN items i),
    r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM s)"""


def _search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index with ids that SQL gives too, which ties go by."""
    place = F.when(F.col("item_type") == "component", 2).when(F.col("chunk_type") == "render", 1).otherwise(0)
    return _index(spark, sf_dir).withColumn("item_id", F.substring("component", 2, 20).cast("long") * 3 + place)


@query(f"WITH {_RANKED} SELECT question_id::BIGINT AS question_id, rank::INT AS rank, id AS item_id, score, component, item_type FROM r WHERE rank <= 5")
def search_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[query embedding, search, boost by kind and name] The five best items of each question."""
    return rag.search(_search_index(spark, sf_dir), _questions(spark, sf_dir), letter_counts).select("question_id", "rank", "item_id", "score", "component", "item_type")


@query(f"""WITH {_RANKED}, k AS (SELECT *, {_CODE.replace('lower(text)', 'lower(question)')} AS code FROM r WHERE rank <= 5),
    c AS (SELECT question_id, string_agg(CASE WHEN chunk_type = 'property' THEN component || '.' || name || ': ' || dt ELSE text END, chr(10) ORDER BY rank) AS context FROM k WHERE code OR contains(lower(question), lower(component)) GROUP BY question_id),
    p AS (SELECT q.question_id, {_CODE.replace('lower(text)', 'lower(q.question)')} AS code, replace(replace(CASE WHEN {_CODE.replace('lower(text)', 'lower(q.question)')} THEN {sql_text(answer.CODE_PROMPT)} ELSE {sql_text(answer.QA_PROMPT)} END, '{{question}}', q.question), '{{context}}', coalesce(c.context, '')) AS prompt FROM q LEFT JOIN c USING (question_id))
    SELECT question_id::BIGINT AS question_id, code, md5(prompt) AS prompt_md5, length(prompt) || ' ' || right(prompt, 9) AS answer FROM p""")
def asked_and_answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[from question to context, prompt and a model's answer] The model says how long the prompt is, and its end."""
    asked = rag.ask(_search_index(spark, sf_dir), _questions(spark, sf_dir), letter_counts)
    return answer.answered(asked, lambda p: f"{len(p)} {p[-9:]}").select("question_id", "code", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"), "answer")


def _flaky(texts: list[str], calls: dict[str, int] = {}) -> list[list[float]]:  # noqa: B006  (a process remembers)
    """Fails as often in a row as the text's length says, up to three times; then gives the letters and the tries."""
    (text,) = texts
    calls[text] = calls.get(text, 0) + 1
    if calls[text] <= len(text) % 4:
        raise OSError("not now")
    return [[*letter_counts(texts)[0], float(calls.pop(text))]]


@query(f"SELECT p_partkey, array_to_string(list_transform(list_append({_vector('p_name')}, 1.0::DOUBLE + length(p_name) % 4), lambda x: x::INT), ',') AS vector FROM part")
def retried_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[retries of a provider that fails] Each text fails up to three times before it gets its vector."""
    rows = embed.embedded(read(spark, sf_dir, "part").select("p_partkey", "p_name"), _flaky, "p_name", batch=1, wait=0)
    return rows.select("p_partkey", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("vector"))


@query(f"""WITH t AS (SELECT 1 AS run, p_partkey, p_type AS text FROM part UNION ALL SELECT 2, p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type || ' ' || p_brand ELSE p_type END FROM part),
    n AS (SELECT text, min(run) AS first FROM t GROUP BY text)
    SELECT t.run::INT AS run, p_partkey, array_to_string(list_transform({_vector('text')}, lambda x: x::INT), ',') AS vector, (SELECT count(*) FROM n WHERE first = t.run) AS calls FROM t""")
def reused_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[embeddings kept by content] Two runs over types of parts, some of them changed; calls: the texts that the provider got."""
    part, at = read(spark, sf_dir, "part"), f"{stores.shared_dir(spark)}/loam-vectors-{uuid.uuid4().hex}"
    stores._TABLES.setdefault(spark.sparkContext.applicationId, []).append(at)
    said = (F.col("p_type"), F.when(F.col("p_size") % 2 == 0, F.concat_ws(" ", "p_type", "p_brand")).otherwise(F.col("p_type")))
    out = None
    for run, text in enumerate(said, 1):
        rows = embed.embedded_once(part.select("p_partkey", text.alias("text")), at, letter_counts, "letters", batch=1)
        calls = embed.stored(spark, at).where(F.col("run") == run).count()
        rows = rows.select(F.lit(run).alias("run"), "p_partkey", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("vector"), F.lit(calls).cast("long").alias("calls"))
        out = rows if out is None else out.unionByName(rows)
    return out
