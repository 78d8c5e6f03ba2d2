"""SentencePiece encoding and decoding by a distinct-chunk table.

A model whose pieces never cross from a character into a whitespace marker segments every marked word (a run of
markers and the characters up to the next marker) by itself. So each block of documents is cut into marked words,
each distinct one goes through the library once, and ids and decoded text are joined back by position.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F

from loam.llm.common import bounded_batches, table, text_blocks, tokenizer_path

#: The whitespace marker; a plain space becomes one.
MARK = "▁"
_WORDS = re.compile(f"[ {MARK}]+[^ {MARK}]*")

#: Characters that a task keeps in its table of distinct words before it begins a new one.
TABLE_CHARS = 6_000_000


class ChunkTable:
    """Distinct marked words of one task: the ids of each, and its decoded text where that is not the word itself."""

    def __init__(self, model: str, table_chars: int = TABLE_CHARS):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.apart = self._apart()
        self.mark_id, self.end_id = self.sp.piece_to_id(MARK), self.sp.eos_id()
        self.limit, self.chars = table_chars, 0
        self.rows: dict[str, str] = {}
        self.odd: dict[str, str] = {}

    def _apart(self) -> bool:
        """Whether words can be segmented apart: the library keeps all characters, and no piece crosses into a marker."""
        probe = "  a  b\tc\u3000\ufb01 "
        pieces = map(self.sp.id_to_piece, range(self.sp.get_piece_size()))
        return self.sp.decode(self.sp.encode(probe)) == probe and not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)

    def segment(self, words: list[str]) -> None:
        """Adds marked words to the table. The library puts a marker ahead of what it gets, so a word's own first one
        goes; the marker that it drops when it decodes stands for a space anywhere but at the start of a text."""
        ids = self.sp.encode([w[1:] for w in words], num_threads=1)
        ids = [i if len(w) > 1 else [self.mark_id] for w, i in zip(words, ids, strict=True)]
        self.rows.update(zip(words, [" ".join(map(str, i)) for i in ids], strict=True))
        said = self.sp.decode(ids, num_threads=1)
        self.odd.update((w, f" {d}") for w, d in zip(words, said, strict=True) if d != w[1:].replace(MARK, " "))

    def words(self, text: str) -> list[str]:
        return _WORDS.findall(f" {text}") if text else []

    def fill(self, words: list[str]) -> None:
        if new := list(set(words).difference(self.rows)):
            self.chars += sum(map(len, new))
            self.segment(new)

    def encode_block(self, texts: list[str]) -> list[tuple[str, int, str]]:
        """For each text its ids with the end id as text, their number, and the text that they decode to."""
        if not self.apart:
            ids = [self.sp.encode(t) + [self.end_id] for t in texts]
            return [(" ".join(map(str, i)), len(i), self.sp.decode(i)) for i in ids]
        words = [self.words(t) for t in texts]
        self.fill([w for own in words for w in own])
        rows, odd, out, end = self.rows, self.odd, [], str(self.end_id)
        for text, own in zip(texts, words, strict=True):
            ids = " ".join([*map(rows.__getitem__, own), end])
            said = text.replace(MARK, " ") if not odd or odd.keys().isdisjoint(own) else "".join(odd.get(w) or w.replace(MARK, " ") for w in own)[1:]
            out.append((ids, ids.count(" ") + 1, said))
        if self.chars > self.limit:
            self.rows, self.odd, self.chars = {}, {}, 0
        return out

    def encode(self, text: str) -> tuple[str, int, str]:
        return self.encode_block([text])[0]


SCHEMA = "doc_id long, n_tokens long, ids string, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def round_trip(docs: DataFrame, model: str, digests: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (decimal, one space between, end id last) and decoded text of every whole text.

    With `digests`, sha256 of both in place of the values, made where the values are. A null text counts as an empty
    one: only the end id. Repeated rows each give a row, an empty table none; a null key stays null; other columns are
    not read. One pass without a shuffle; a task holds one block of text and a table of bounded size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = None
        for block in text_blocks(batches):
            chunks = chunks or ChunkTable(model)
            out = chunks.encode_block([t or "" for t in block.column("text").to_pylist()])
            cols = [block.column("doc_id"), pa.array([x[1] for x in out], pa.int64())]
            cols += [pa.array([_sha(x[k]) if digests else x[k] for x in out], pa.string()) for k in (0, 2)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, DIGESTS if digests else SCHEMA)


def op3_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), digests=True)
