"""From questions to prompts: kind of request, context of the best items, and the prompt for a language model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from loam.functions.js import contains_any, in_order, joined, text

#: Words that make a question a request for code.
CODE_WORDS = ("create", "build", "page", "dashboard", "component")

#: The prompts; {context} and {question} stand for theirs.
CODE_PROMPT = """
You are a senior React engineer working with a proprietary UI component library.

You are given:
1. A user request
2. Metadata about available UI components

Your goal:
Generate a complete React implementation using available components.

Rules:
- Prioritize using provided components
- Do NOT invent components or props
- Only use custom code if necessary
- Return ONLY React code (no explanation)

Context:
{context}

User request:
{question}
"""
QA_PROMPT = """
You are a UI component documentation assistant.

Answer ONLY using the provided context.

Question:
{question}

Context:
{context}

Instructions:
- If the question is about props → list them clearly
- Do NOT generate React code
- Do NOT invent information
- Keep answer short and factual
- If something is not specified → say "Not specified"

Answer:
"""


def code_request(question: Column) -> Column:
    return contains_any(F.lower(question), CODE_WORDS)


def named_in(question: Column, component: Column) -> Column:
    """Whether the question has the component's name in it; a missing one counts as `undefined`."""
    return F.contains(F.lower(question), F.lower(text(component)))


def context_line(kind: Column, component: Column, name: Column, data_type: Column, said: Column) -> Column:
    return F.when(kind == "property", F.concat(text(component), F.lit("."), text(name), F.lit(": "), text(data_type))).otherwise(said)


def filled(template: str, context: Column, question: Column) -> Column:
    """A prompt with its two places filled; what is filled in is not read for places again."""
    parts, values = [], {"context": context, "question": question}
    rest = template
    while rest:
        at = min((i for i in (rest.find("{context}"), rest.find("{question}")) if i >= 0), default=-1)
        if at < 0:
            parts.append(F.lit(rest))
            break
        name = "context" if rest.startswith("{context}", at) else "question"
        parts += [F.lit(rest[:at]), values[name]]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def prompts(ranked: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id, question, code, context, prompt of every question.

    ranked: question_id, rank, chunk_type, component, name, dataType, text. Items of a question that is no request for
    code count only if the question names their component. A question without items has an empty context.
    """
    asked = questions.select("question_id", "question", code_request(F.col("question")).alias("code"))
    kept = ranked.join(asked, "question_id").where(F.col("code") | named_in(F.col("question"), F.col("component")))
    line = context_line(F.col("chunk_type"), F.col("component"), F.col("name"), F.col("dataType"), F.coalesce("text", F.lit("")))
    context = kept.groupBy("question_id").agg(joined(in_order(line, F.col("rank")), "\n").alias("context"))
    out = asked.join(context, "question_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    prompt = F.when(F.col("code"), filled(CODE_PROMPT, F.col("context"), F.col("question"))).otherwise(filled(QA_PROMPT, F.col("context"), F.col("question")))
    return out.withColumn("prompt", prompt)


def answered(asked: DataFrame, model: Callable[[str], str], column: str = "prompt", out: str = "answer") -> DataFrame:
    """asked with a model's answer to each prompt, called from the executors one prompt at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [model(p) for p in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string())], names=[*batch.schema.names, out])

    return asked.mapInArrow(run, T.StructType([*asked.schema.fields, T.StructField(out, T.StringType())]))
