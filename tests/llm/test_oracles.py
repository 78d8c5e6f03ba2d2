"""The operators that SQL can express against DuckDB, on the small tables and on pages with aliases."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from loam.llm.oracles import URL_FILTER
from loam.llm.queries import ORACLES, QUERIES
from loam.llm.urls import judge

SF = "/root/testdata/sf0.001"


def rows(con, sql, columns):
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(columns)
    return Counter(tuple(r[names.index(c)] for c in sorted(columns)) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    df = QUERIES[name](spark, SF)
    assert Counter(tuple(r[c] for c in sorted(df.columns)) for r in df.collect()) == rows(con, ORACLES[name], df.columns)


def test_aliases_equal_their_sql(spark, tmp_path):
    pages = [(i, f"http://c{i}.org/a", f'<meta http-equiv="refresh" content="0; url=http://c{i + 1}.org/a">') for i in range(30)]
    pages += [(30, "HTTP://c30.org/a#x", "<LINK href='/b?c=1&amp;d' rel=canonical><link rel=icon href=i>"), (31, "http://c30.org/b?c=1&d", "<script>location.href = '//x.net/fr/1'</script>")]
    pages += [(40, "http://y.org", "<script>location.replace( 'z' )</script>"), (41, "http://y.org/z", '<link rel="canonical" href="http://www.example.com/en/1">'), (42, "http://y.org/q/r", '<link rel="canonical" href="../s">')]
    pages += [(50, None, "<p>"), (51, "nothing", None), (52, "http://a.com/x", '<link rel="canonical" href="http://x.net/es/">'), (53, "http://b.org/", '<link rel="canonical" href="http://x.net/es/"><link rel="canonical" href="http://b.org/c">')]
    df = judge(spark.createDataFrame(pages, "page_id long, url string, html string"))
    got = df.collect()
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", pages)
    assert Counter(tuple(r[c] for c in sorted(df.columns)) for r in got) == rows(con, URL_FILTER, df.columns)
    assert Counter(r.by for r in got)["alias"] > 30
