import gzip
import hashlib
import io
import os
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loam.llm.common import remove_tables
from loam.llm.warc import ArchiveProblem, Members, bare_digest, op13_warc_archives, page_of, read_archive, read_archives, record_parts, records_of, resolved, write_archives

PAGES = "page_id long, url string, html string, record_type string, payload string, key int, same string"


def pages(spark, more=()):
    big, other = "<p>ü</p>" * 200, "x" * 1000
    rows = [(1, "http://a.b/c d\r\nX: y", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "x" * 999), (6, "u", "x" * 999), (7, "", other), (8, "u", other), (8, "u", other), (None, "n", big), (None, None, "only\r\n\r\nhere" * 100), (-3, "WARC/1.1\r\n\r\n", "WARC/1.1\r\n\r\n" * 90), (9, "long", "".join(random.Random(1).choices("abcdef\n", k=700_000)))]
    return spark.createDataFrame([(*r, "z", "z", 1, "z") for r in [*rows, *more]], PAGES)


def brute(rows):
    latest = {}
    for r in rows:
        b = (r.html or "").encode()
        if len(b) >= 1000 and r.page_id is not None:
            latest[b] = max(latest.get(b, r.page_id), r.page_id)
    out = []
    for r in rows:
        b = (r.html or "").encode()
        to = latest.get(b) if latest.get(b) != r.page_id else None
        out.append((r.page_id, len(b), hashlib.sha1(b).hexdigest(), "response" if to is None else "revisit", to))
    return Counter(out)


def test_query_against_brute_force(spark, tmp_path):
    more = [(i, f"http://h/{i}", ("copy " if i % 3 else f"own {i} ") * 300) for i in range(100, 700)]
    pages(spark, more).repartition(5).write.parquet(f"{tmp_path}/pages.parquet")
    got = op13_warc_archives(spark, str(tmp_path))
    assert Counter(tuple(r) for r in got.collect()) == brute(spark.read.parquet(f"{tmp_path}/pages.parquet").collect())
    assert remove_tables(spark) >= 2


def test_round_trip_with_payloads(spark, tmp_path):
    records = records_of(pages(spark))
    write_archives(records, str(tmp_path), archive_bytes=4000)
    back = read_archives(spark, str(tmp_path), payload=True)
    rows = back.collect()
    want = {(r.page_id, r.html or "") for r in pages(spark).collect()}
    assert {(r.page_id, r.payload.decode()) for r in resolved(back).select(page_of(F.col("record_id")).alias("page_id"), "payload").collect()} == want
    assert all(r.error is None and (r.record_type == "revisit") == (r.payload is None) == (r.refers_to is not None) for r in rows)
    assert len({r.archive for r in rows}) > 1 and {r.target_uri for r in rows} >= {None, "http://a.b/c%20d%0D%0AX:%20y"}
    # Any reader of gzip files sees the same records, a member each.
    for name in {r.archive for r in rows}:
        data = (tmp_path / name).read_bytes()
        members = list(Members(io.BytesIO(data)))
        assert gzip.decompress(data).count(b"WARC-Record-ID: ") == sum(r.archive == name for r in rows)
        for r in rows:
            if r.archive == name:
                one = zlib.decompressobj(31).decompress(data[r.offset :])
                assert one.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode()) and one.endswith(b"\r\n\r\n")
        assert members[0][0] == 0


def archive(*rows):
    """Bytes of an archive, and where each member begins."""
    out, at = b"", []
    for row in rows:
        at.append(len(out))
        out += gzip.compress(b"".join((*record_parts(row), b"\r\n\r\n")))
    return out, at


def page(n, **more):
    return {"record_id": f"urn:{n}", "record_type": "response", "target_uri": "u", "date": "d", "refers_to": None, "payload": f"page {n}".encode() * 50} | more


def raw(text):
    return gzip.compress(text.encode())


def test_bad_records_are_said_and_the_next_go_on():
    good = b"".join((*record_parts(page(1)), b"\r\n\r\n"))
    wrong = {
        "payload digest": re.sub(rb"WARC-Block-Digest: \S+\r\n", b"", good).replace(b"page 1page", b"page 2page", 1),
        "block digest": good.replace(b"page 1page", b"page 2page", 1),
        "short of its length": good[:-200],
        "doesn't end": good + b"more",
        "no length": re.sub(rb"\r\nContent-Length: \d+\r\n\r\nHTTP", b"\r\nX: 1\r\n\r\nHTTP", good),
        "no record begins": b"PNG" + good,
        "head has no end": b"WARC/1.1\r\nX: y",
        "line without a name": good.replace(b"WARC-Date: ", b"WARC-Date ", 1).replace(b"WARC-Date d", b"WARC-Date", 1),
        "payload has": re.sub(rb"WARC-Block-Digest: \S+\r\n", b"", good).replace(b"Content-Length: 300\r\n\r\npage", b"Content-Length: 301\r\n\r\npage"[:-4] + b"page", 1),
    }
    for what, bad in wrong.items():
        data = gzip.compress(good) + gzip.compress(bad) + gzip.compress(good)
        rows = list(read_archive(io.BytesIO(data), "a", True, strict=False))
        assert [r["error"] is None for r in rows] == [True, False, True] and what in rows[1]["error"], (what, rows[1]["error"])
        with pytest.raises(ArchiveProblem, match=f"a at {len(gzip.compress(good))}"):
            list(read_archive(io.BytesIO(data), "a"))


def test_what_cannot_be_unpacked_ends_an_archive():
    data, at = archive(page(1), page(2), page(3))
    broken = data[: at[1] + 30] + bytes(255 - b for b in data[at[1] + 30 : at[1] + 60]) + data[at[1] + 60 :]
    for odd in (data[: at[2] - 4], data[: at[1]] + b"no gzip at all", broken):
        rows = list(read_archive(io.BytesIO(odd), "a", strict=False))
        assert [r["error"] is None for r in rows] == [True, False] and rows[1]["offset"] == at[1]
    assert list(read_archive(io.BytesIO(b""), "a")) == []


def test_reader_keeps_a_chunk_not_a_record():
    big = page(1, payload=b"a" * 30_000_000)
    data, _ = archive(big)
    seen = []

    class Stream(io.BytesIO):
        def read(self, n=-1):
            seen.append(n)
            return super().read(n)

    import tracemalloc

    tracemalloc.start()
    (row,) = read_archive(Stream(data), "a")
    assert tracemalloc.get_traced_memory()[1] < 4_000_000 and row["payload_bytes"] == 30_000_000 and row["payload"] is None and max(seen) <= 1 << 18
    tracemalloc.stop()


def test_digests():
    sha = hashlib.sha1(b"x")
    assert bare_digest(f"SHA1:{sha.hexdigest().upper()}") == sha.hexdigest() == bare_digest("sha1:" + __import__("base64").b32encode(sha.digest()).decode())
    assert bare_digest(None) is bare_digest("md5:00") is bare_digest("sha1:zz") is None


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    bad = records_of(pages(spark)).withColumn("date", F.when(F.col("record_id") == "urn:loam:page:5", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("date")))
    write_archives(records_of(pages(spark)).where("record_id = 'urn:loam:page:9'"), str(tmp_path))
    before = sorted(os.listdir(tmp_path))
    with pytest.raises(Exception, match="lost"):
        write_archives(bad.repartition(3), str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == before and read_archives(spark, str(tmp_path)).count() == 1
    (tmp_path / "left-by-a-lost-task.warc.gz").write_bytes(b"half")
    assert read_archives(spark, str(tmp_path)).count() == 1
    write_archives(records_of(pages(spark)), str(tmp_path), mode="overwrite")
    assert read_archives(spark, str(tmp_path)).count() == 13 and len([n for n in os.listdir(tmp_path) if n.endswith(".json")]) == 1


def test_folder_without_a_list_and_empty_table(spark, tmp_path):
    (tmp_path / "other.warc.gz").write_bytes(archive(page(1), page(2, record_type="warcinfo"))[0])
    assert sorted(r.record_type for r in read_archives(spark, str(tmp_path)).collect()) == ["response", "warcinfo"]
    write_archives(records_of(pages(spark).limit(0)), f"{tmp_path}/none")
    assert read_archives(spark, f"{tmp_path}/none").collect() == []
