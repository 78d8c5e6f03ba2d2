"""The whole way: from a folder of sources to an index, and from questions to prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loam.operators import answer, chunks, embed, extract, retrieval, schema
from loam.sources import files
from loam.sources.stores import kept, written
from loam.syntax.nodes import component_name, ts_nodes


def component_chunks(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Chunks of schemas and of sources, and the code of each component, for all component folders below a root."""
    found = kept(files.scan(spark, root, "typescript"), "sources")
    folders = files.component_folders(found)
    types = files.first_existing(found, folders, files.TYPES_CANDIDATES).where("content is not null")
    documents = schema.schema_documents(schema.nodes_or_retry(schema.cleaned(types)))
    named = types.select("component", F.col("file_path").alias("file")).join(documents, "file").select("component", "schema")
    parts = schema.schema_chunks(named).drop("ord", "place", "definition", "isSubType", "linksTo", "enum")
    code = files.first_existing(found, folders, files.CODE_CANDIDATES).where("content is not null")
    records = extract.records(ts_nodes(code)).withColumn("component", component_name(F.col("file")))
    known = chunks.knowledge_chunks(records).drop("ord")
    return parts.unionByName(known, allowMissingColumns=True), code.select("component", F.col("content").alias("code"))


def build_index(spark: SparkSession, root: str, provider: embed.Provider | None = None, **how) -> DataFrame:
    """item_id and the columns of an index, for a folder of components. `store=path` embeds what is new to it alone."""
    held = embed.index(*component_chunks(spark, root), provider, **how)
    return held.withColumn("item_id", F.xxhash64("component", "item_type", "chunk_type", "name", "text"))


def search(index: DataFrame, questions: DataFrame, provider: embed.Provider | None = None, k: int = 5) -> DataFrame:
    """question_id, rank, score and the columns of the best k items of each question.

    An index that a provider is still to make is written first, and so are the questions' vectors: the provider gets each
    item and each question once.
    """
    index = written(index, "index")
    asked = kept(embed.embedded(questions.select("question_id", "question"), provider, "question", "embedding"), "asked")
    asked = asked.select(F.col("question_id").alias("item_id"), "embedding", "question")
    named = index.withColumn("_name", F.coalesce("name", "component"))
    top = retrieval.vector_top(named, asked, k, "item_id", kind="item_type", name="_name", question="question")
    return top.select(F.col("query").alias("question_id"), F.col("item").alias("item_id"), "rank", "score").join(index.drop("embedding"), "item_id")


def ask(index: DataFrame, questions: DataFrame, provider: embed.Provider | None = None, k: int = 5) -> DataFrame:
    """question_id, question, code, context, prompt of every question."""
    return answer.prompts(search(index, questions, provider, k), questions)


def compare(spark: SparkSession, first: DataFrame, second: DataFrame, questions: DataFrame, names: tuple[str, str] = ("Function", "AST")) -> DataFrame:
    """The verdict on two sets of chunks (chunk_id, text) by the questions (query_id, text)."""
    tops = [retrieval.keyword_top(c, questions, 3).withColumn("strategy", F.lit(n)) for c, n in zip((first, second), names, strict=True)]
    return retrieval.verdict(retrieval.accuracy(tops[0].unionByName(tops[1]), ["strategy"]), *names)
