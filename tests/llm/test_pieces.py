import hashlib

import sentencepiece
from hypothesis import given, settings, strategies as st

from loam.llm.common import tokenizer_path
from loam.llm.pieces import ChunkTable, round_trip
from tests.llm.tables import empty_docs, odd_docs

MODEL = tokenizer_path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)
TABLE = ChunkTable(MODEL, table_chars=2000)


def whole(text):
    ids = SP.encode(text) + [SP.eos_id()]
    return " ".join(map(str, ids)), len(ids), SP.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"ab zé▁.\n\t\x00　🔥日 ", "<s>", "</s>", "<0x41>"]), max_size=60))
def test_equals_the_library(parts):
    text = "".join(parts)
    assert TABLE.apart and TABLE.encode(text) == whole(text)


def test_whole_table(spark):
    docs = odd_docs(spark)
    want = sorted((str(r.doc_id), *whole(r.text or "")) for r in docs.collect())
    got = sorted((str(r.doc_id), r.ids, r.n_tokens, r.decoded) for r in round_trip(docs, MODEL).collect())
    assert got == want
    digests = sorted((str(r.doc_id), r.ids_sha256, r.decoded_sha256) for r in round_trip(docs, MODEL, digests=True).collect())
    assert digests == sorted((i, hashlib.sha256(a.encode()).hexdigest(), hashlib.sha256(d.encode()).hexdigest()) for i, a, _, d in want)
    assert round_trip(empty_docs(spark), MODEL).collect() == []
