"""Every registered query against its SQL on the smallest tables, and the package without its optional parts."""

import math
import os
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from loam.plans import catalogue

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


def same(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(same(r[c]) for c in columns) for r in df.collect())
    rel = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == Counter(tuple(same(r[i]) for i in order) for r in rel.fetchall())


def test_queries_without_sql_run(spark):
    for name in set(catalogue.QUERIES) - set(catalogue.ORACLES):
        assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "rank", "doc_id", "score"] and df.count() == 120


def test_nothing_else_imports_the_subpackage_and_the_rest_works_without_it(tmp_path):
    for f in (ROOT / "loam").rglob("*.py"):
        assert "llm" in f.relative_to(ROOT).parts or "loam.llm" not in f.read_text(), f
    shutil.copytree(ROOT / "loam", tmp_path / "loam", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = f"""
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()
print('ROWS', e.entry(spark).count(), e.queries()['record_shapes'](spark, '{SF}').count())
print('NAMES', *sorted(e.queries()))
"""
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True, timeout=300)
    assert "ROWS 120 200" in said.stdout and said.stdout.rpartition("NAMES")[2].split() == sorted(catalogue.QUERIES), said.stderr
