"""Column expressions with the string and list semantics that the chunk and prompt rules were written for."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

#: White space that trimming removes at both ends of a template.
_EDGES = r"^[\s ﻿]+|[\s ﻿]+$"


def text(c: Column) -> Column:
    """A value inside a template: null prints as `undefined`."""
    return F.coalesce(c.cast("string"), F.lit("undefined"))


def or_else(c: Column, default: str) -> Column:
    """Null and empty strings give the default."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, _EDGES, "")


def shortened(c: Column, most: int = 200, mark: str = "...") -> Column:
    """Longer texts are cut at `most` characters and marked; null gives an empty text."""
    return F.coalesce(F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(mark))).otherwise(c), F.lit(""))


def capitalised(name: Column) -> Column:
    """Whether the first character is its own upper case: capitals, but also _, $ and digits."""
    first = F.substring(name, 1, 1)
    return (first == F.upper(first)) & (F.length(name) > 0)


def replaced_once(c: Column, old: str, new: str) -> Column:
    """Replaces the first occurrence alone."""
    at = F.instr(c, old)
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.lit(new), F.substring(c, at + len(old), F.length(c)))).otherwise(c)


def starts_with_any(c: Column, prefixes) -> Column:
    """One chain of tests, which stays inside generated code; a lambda over a list would not."""
    return reduce(or_, (F.startswith(c, F.lit(p)) for p in prefixes))


def contains_any(c: Column, parts) -> Column:
    return reduce(or_, (F.contains(c, F.lit(p)) for p in parts))


def joined(items: Column, separator: str) -> Column:
    """Joins a list; null items print as empty strings."""
    return F.array_join(items, separator, "")


def without_blanks(items: Column) -> Column:
    return F.filter(items, lambda x: x.isNotNull() & (x != ""))


def first_seen(items: Column) -> Column:
    """Distinct items in the order of their first occurrence."""
    return F.array_distinct(items)


def in_order(value: Column, *order: Column) -> Column:
    """Aggregate: the values of a group as a list in the given order (nulls are left out)."""
    key = [o.alias(f"k{i}") for i, o in enumerate(order)]
    return F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(*key, value.alias("v"))))), lambda s: s["v"])


def last_wins(value: Column, *order: Column) -> Column:
    """Aggregate: the value that comes last."""
    return F.max_by(value, F.struct(*order))


def first_match(value: Column, *order: Column) -> Column:
    """Aggregate: the value that comes first."""
    return F.min_by(value, F.struct(*order))


def once(df: DataFrame, *kept: str, **columns: Column) -> DataFrame:
    """df's columns `kept` (all if none is named) and new ones, each of which is evaluated once a row, however often
    later expressions use it: they pass through a generator, which the optimizer does not fold projections across."""
    held = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_once")
    return df.select(*(kept or df.columns), held).select(*(kept or df.columns), *(F.col(f"_once.{n}").alias(n) for n in columns))
