"""WARC archives: a data source whose writer makes one gzip member for each record, and whose reader goes through an
archive once, member by member, with bounded memory.

    write_archives(pages, path)                     # or df.write.format("warc").mode("append").save(path)
    read_archives(spark, path, payload=True)        # or spark.read.format("warc").option("payload", True).load(path)
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from loam.functions.spread import spread
from loam.llm.common import bounded_batches, held_folder, materialize, table

#: What the writer takes and the reader gives.
RECORDS = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_bytes long, payload_digest string, payload binary"
ROWS = f"archive string, offset long, {RECORDS}, error string"
_ROWS = pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in ROWS.split(", ")])

#: Bytes read or unpacked at once; bytes of a record's head; bytes and rows of a batch that the reader passes on.
CHUNK, HEAD_BYTES, BATCH_BYTES, BATCH_ROWS = 1 << 18, 1 << 20, 8 << 20, 4096

#: The format's version, the profile of revisits, the head of a page's response.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {}\r\n\r\n"


class ArchiveProblem(ValueError):
    """What is wrong with an archive, and whether its next member can still be read."""

    def __init__(self, what: str, goes_on: bool = True):
        super().__init__(what)
        self.goes_on = goes_on


def _base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def bare_digest(said: str | None) -> str | None:
    """Lowercase hex of a labelled sha1, which stands in base 32 or in hex; None for others."""
    label, _, value = (said or "").partition(":")
    if label.lower() != "sha1":
        return None
    if re.fullmatch(r"[0-9a-fA-F]{40}", value):
        return value.lower()
    return base64.b32decode(value.upper()).hex() if re.fullmatch(r"[A-Z2-7a-z]{32}", value) else None


def _in_line(value: str) -> str:
    """A value for a head: white space and control characters as percent codes, so that it can't end its line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_parts(row: dict) -> tuple[bytes, bytes, bytes]:
    """Head, block's own head and payload of a record; a revisit has no payload but the length and digest of it."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    # A revisit whose payload isn't at hand says what is known of it.
    size = len(payload) if row["payload"] is not None or row.get("payload_bytes") is None else row["payload_bytes"]
    sha1 = bytes.fromhex(row["payload_digest"]) if row["payload"] is None and row.get("payload_digest") else hashlib.sha1(payload).digest()
    http = HTTP.format(size).encode()
    block = hashlib.sha1(http)
    if revisit:
        payload = b""
    block.update(payload)
    head = [VERSION, f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{_in_line(row['record_id'])}>", f"WARC-Date: {_in_line(row['date'])}"]
    if row["target_uri"] is not None:
        head.append(f"WARC-Target-URI: {_in_line(row['target_uri'])}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_in_line(row['refers_to'])}>"]
    head += [f"WARC-Payload-Digest: {_base32(sha1)}", f"WARC-Block-Digest: {_base32(block.digest())}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode(), http, payload


# ---------------------------------------------------------------- sequential reader


class Member:
    """One gzip member of a stream, unpacked a chunk at a time."""

    def __init__(self, source: Members):
        self.source, self.unpack, self.ready = source, zlib.decompressobj(31), b""

    def more(self) -> bool:
        """Unpacks up to CHUNK bytes; False at the member's end."""
        while not self.unpack.eof:
            packed = self.unpack.unconsumed_tail or self.source.take()
            try:
                got = self.unpack.decompress(packed, CHUNK)
            except zlib.error as e:
                raise ArchiveProblem(f"member can't be unpacked: {e}", False) from e
            if self.unpack.eof:
                self.source.rest = self.unpack.unused_data
            if got:
                self.ready += got
                return True
            if not packed and not self.unpack.eof:
                raise ArchiveProblem("archive ends inside a member", False)
        return False

    def head(self) -> dict[str, str]:
        """The fields of a head up to its empty line, names in lower case, the first line under ''."""
        while (end := self.ready.find(b"\r\n\r\n")) < 0:
            if len(self.ready) > HEAD_BYTES or not self.more():
                raise ArchiveProblem("head has no end")
        lines, self.ready = self.ready[:end].decode("utf-8", "replace").split("\r\n"), self.ready[end + 4 :]
        fields = {"": lines[0]}
        for line in lines[1:]:
            name, colon, value = line.partition(":")
            if not colon:
                raise ArchiveProblem(f"line without a name: {line[:80]!r}")
            fields.setdefault(name.strip().lower(), value.strip())
        return fields

    def bytes(self, n: int) -> Iterator[bytes]:
        """The next n bytes in chunks."""
        while n:
            if not self.ready and not self.more():
                raise ArchiveProblem(f"block ends {n} bytes short of its length")
            piece, self.ready = self.ready[:n], self.ready[n:]
            n -= len(piece)
            yield piece

    def close(self, quietly: bool = False) -> None:
        """Goes to the member's end, where two empty lines have to stand and nothing else."""
        left = b""
        while self.ready or self.more():
            left, self.ready = (left + self.ready)[:8], b""
        if left != b"\r\n\r\n" and not quietly:
            raise ArchiveProblem("record doesn't end where its length says")


class Members:
    """The members of a stream one after the other; no more than a chunk of it is held."""

    def __init__(self, stream):
        self.stream, self.read, self.rest = stream, 0, b""

    def take(self) -> bytes:
        if self.rest:
            out, self.rest = self.rest, b""
            return out
        out = self.stream.read(CHUNK)
        self.read += len(out)
        return out

    def __iter__(self) -> Iterator[tuple[int, Member]]:
        while self.rest or self._fill():
            at, member = self.read - len(self.rest), Member(self)
            yield at, member
            member.close(quietly=True)  # whatever was left of it

    def _fill(self) -> bool:
        self.rest = self.take()
        return bool(self.rest)


def read_record(member: Member, with_payload: bool) -> dict:
    """One record: framed by its length, held against its digests. Payload bytes are only kept if asked for."""
    head = member.head()
    if not head[""].startswith("WARC/"):
        raise ArchiveProblem(f"no record begins here: {head[''][:40]!r}")
    if not re.fullmatch(r"\d+", head.get("content-length", "")):
        raise ArchiveProblem("record has no length")
    bare = lambda v: None if v is None else v.removeprefix("<").removesuffix(">")
    row = {"record_id": bare(head.get("warc-record-id")), "record_type": head.get("warc-type"), "target_uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "refers_to": bare(head.get("warc-refers-to"))}
    length = int(head["content-length"])
    block, payload, kept, inner, size = hashlib.sha1(), hashlib.sha1(), [], None, 0
    http = head.get("content-type", "").startswith("application/http")
    start = b""
    for piece in member.bytes(length):
        block.update(piece)
        if http and inner is None:
            start += piece
            end = start.find(b"\r\n\r\n")
            if end < 0:
                if len(start) > HEAD_BYTES:
                    raise ArchiveProblem("head of the block has no end")
                continue
            inner, piece = start[:end].decode("utf-8", "replace"), start[end + 4 :]
        payload.update(piece)
        size += len(piece)
        if with_payload:
            kept.append(piece)
    member.close()
    said = bare_digest(head.get("warc-block-digest"))
    if said and said != block.hexdigest():
        raise ArchiveProblem(f"block digest is {block.hexdigest()}, not {said}")
    said = bare_digest(head.get("warc-payload-digest"))
    m = re.search(r"(?im)^content-length:\s*(\d+)\s*$", inner or "")
    if row["record_type"] == "revisit":
        if not said or not m:
            raise ArchiveProblem("revisit without the digest or the length of its payload")
        return row | {"payload_bytes": int(m[1]), "payload_digest": said, "payload": None}
    if said and said != payload.hexdigest():
        raise ArchiveProblem(f"payload digest is {payload.hexdigest()}, not {said}")
    if m and int(m[1]) != size:
        raise ArchiveProblem(f"payload has {size} bytes, not {m[1]}")
    return row | {"payload_bytes": size, "payload_digest": payload.hexdigest(), "payload": b"".join(kept) if with_payload else None}


def read_archive(stream, archive: str, with_payload: bool = False, strict: bool = True) -> Iterator[dict]:
    """The records of one archive in turn.

    strict: what is wrong fails with the archive and the offset. Else it is a row with `error`; the next member goes on,
    unless this one can't be unpacked to its end: then the archive ends with that row. An empty archive has no record.
    """
    for at, member in Members(stream):
        row = {"archive": archive, "offset": at, "error": None}
        try:
            row |= read_record(member, with_payload)
        except ArchiveProblem as e:
            if strict:
                raise ArchiveProblem(f"{archive} at {at}: {e}") from e
            row["error"] = str(e)
            try:
                member.close(quietly=True)
            except ArchiveProblem:
                e.goes_on = False
            yield row
            if not e.goes_on:
                return
        else:
            yield row


# ---------------------------------------------------------------- data source


@dataclass
class Archives(WriterCommitMessage):
    """What a task has written."""

    names: list[str] = field(default_factory=list)
    records: int = 0


@dataclass
class Archive(InputPartition):
    name: str


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


class WarcWriter(DataSourceArrowWriter):
    """A task writes archives of a name of its own; a list of them, written last and as one file, makes them all visible.
    So a set of archives is there whole or not at all, and what a lost or repeated task has left is never read."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.most, self.level = int(options.get("archive_bytes", 1 << 30)), int(options.get("level", 6))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Archives:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        out, done = None, Archives()
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or out.tell() >= self.most:
                        if out is not None:
                            out.close()
                        done.names.append(f"{uuid.uuid4().hex}.warc.gz")
                        out = store.open_output_stream(f"{root}/{done.names[-1]}", compression=None)
                    pack = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                    for part in (*record_parts(row), b"\r\n\r\n"):
                        out.write(pack.compress(part))
                    out.write(pack.flush())
                    done.records += 1
            if out is not None:
                out.close()
        except BaseException:
            self._remove(done.names)
            raise
        return done

    def _remove(self, names: list[str]) -> None:
        store, root = _store(self.path)
        for name in names:
            if store.get_file_info(f"{root}/{name}").type == pafs.FileType.File:
                store.delete_file(f"{root}/{name}")

    def commit(self, messages: list[Archives | None]) -> None:
        store, root = _store(self.path)
        before = _sets(store, root) if self.overwrite else {}
        store.create_dir(root, recursive=True)
        names = sorted(n for m in messages if m for n in m.names)
        with store.open_output_stream(f"{root}/archives-{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps({"archives": names, "records": sum(m.records for m in messages if m)}).encode())
        self._remove([*before, *(n for own in before.values() for n in own)])

    def abort(self, messages: list[Archives | None]) -> None:
        self._remove([n for m in messages if m for n in m.names])


def _sets(store: pafs.FileSystem, root: str) -> dict[str, list[str]]:
    """The lists of a folder, and the archives that each one names."""
    found = {}
    for info in store.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if re.fullmatch(r"archives-[0-9a-f]{32}\.json", info.base_name):
            with store.open_input_stream(info.path, compression=None) as f:
                found[info.base_name] = json.loads(f.read())["archives"]
    return found


class WarcReader(DataSourceReader):
    """A partition for each archive: those that lists name, or all of a folder that has no list."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload, self.strict = (str(options.get(k, d)).lower() == "true" for k, d in (("payload", False), ("strict", True)))

    def partitions(self) -> list[Archive]:
        store, root = _store(self.path)
        lists = _sets(store, root)
        if lists:
            return [Archive(n) for n in sorted({n for own in lists.values() for n in own})]
        return [Archive(i.base_name) for i in store.get_file_info(pafs.FileSelector(root)) if i.is_file and re.search(r"\.warc(\.gz)?$", i.base_name)]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Archive):  # a folder without archives
            return
        store, root = _store(self.path)
        rows, held = [], 0
        with store.open_input_stream(f"{root}/{partition.name}", compression=None) as stream:
            for row in read_archive(stream, partition.name, self.payload, self.strict):
                rows.append(row)
                held += len(row.get("payload") or b"")
                if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, _ROWS)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ROWS)


class WarcSource(DataSource):
    """Options: path; for reading payload (false) and strict (true); for writing archive_bytes (1 GiB) and level (6)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


# ---------------------------------------------------------------- operators


def page_uri(page_id: Column) -> Column:
    """The record id of a page; `-` stands for a null page_id."""
    return F.concat(F.lit("urn:loam:page:"), F.coalesce(page_id.cast("string"), F.lit("-")))


def page_of(uri: Column) -> Column:
    return F.regexp_extract(uri, r"^urn:loam:page:(-?\d+)$", 1).try_cast("long")


def records_of(pages: DataFrame, least: int = 1000, date: str = "1970-01-01T00:00:00Z", key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A record for each page: of equal payloads of `least` bytes or more that of the largest key is the response, and the
    others are revisits of it; all smaller ones are responses.

    Payloads are equal if their sha256 is. A null html is an empty payload. Rows of the largest key are all responses, if it
    stands twice; a null key is smaller than all others, and without any other key all are responses. Only keys and
    digests of payloads that stand several times are gathered; pages meet that table where they lie if it is small, else
    by digest, and a digest with many pages is split as Spark splits skewed joins. Other columns are not read.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    own = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("target_uri"), payload.alias("payload"))
    # Small payloads have keys of their own, so that many equal ones (empty pages) don't meet in one task.
    same = F.when(F.octet_length("payload") >= least, F.sha2("payload", 256)).otherwise(F.concat(F.lit("-"), F.xxhash64("key", "target_uri", "payload").cast("string")))
    groups = own.where(F.octet_length("payload") >= least).groupBy(F.sha2("payload", 256).alias("same")).agg(F.max("key").alias("latest"), F.count(F.lit(1)).alias("n"))
    repeated = materialize(groups.where("n > 1 and latest is not null").drop("n"), "revisits")
    met = spread(own).withColumn("same", same).join(repeated, "same", "left")
    revisit = F.col("latest").isNotNull() & ~F.col("key").eqNullSafe(F.col("latest"))
    return met.select(
        page_uri(F.col("key")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri", F.lit(date).alias("date"),
        F.when(revisit, page_uri(F.col("latest"))).alias("refers_to"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.lit(None).cast("string").alias("payload_digest"), "payload",
    )


def write_archives(records: DataFrame, path: str, archive_bytes: int = 1 << 30, level: int = 6, mode: str = "append") -> None:
    """Writes records (columns RECORDS) as archives of about `archive_bytes` each below `path`; an empty table writes a
    list of no archives."""
    spark = records.sparkSession
    bounded_batches(spark)
    spark.dataSource.register(WarcSource)
    rows = records.select(F.lit(None).cast("string").alias("archive"), F.lit(None).cast("long").alias("offset"), *(f.split()[0] for f in RECORDS.split(", ")), F.lit(None).cast("string").alias("error"))
    rows.write.format("warc").option("archive_bytes", archive_bytes).option("level", level).mode(mode).save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = False, strict: bool = True) -> DataFrame:
    """The records of all archives below `path` (columns ROWS); payloads are null unless asked for."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", payload).option("strict", strict).load(path)


def resolved(records: DataFrame) -> DataFrame:
    """Records with the payload of a revisit taken from its response; null if that is missing."""
    revisits = records.where("record_type = 'revisit'").drop("payload")
    responses = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("payload_digest").alias("_digest"), "payload").dropDuplicates(["refers_to", "_digest"])
    met = revisits.join(responses, ["refers_to"], "left").where("_digest is null or _digest = payload_digest").select(*records.columns)
    return records.where("record_type <> 'revisit' or record_type is null").unionByName(met)


def op13_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record, from the archives that were written of it."""
    path = held_folder(spark, "warc")
    write_archives(records_of(table(spark, sf_dir, "pages")), path)
    return read_archives(spark, path).select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))
