import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from loam.llm.bytebpe import ByteEncoder
from loam.llm.common import tokenizer_path
from loam.llm.rans import BITS, Coder, scale_frequencies
from loam.llm.tokenfiles import read_token_files, write_token_files
from tests.llm.tables import empty_docs, odd_docs

FILE = tokenizer_path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(FILE)


@pytest.mark.parametrize("n", [1, 15, 16, 17, 4095, 4096, 4097, 70000])
def test_coder_round_trip(n):
    ids = np.minimum((np.random.default_rng(n).pareto(0.7, n) * 20).astype(np.int64), 50256)
    freq = scale_frequencies(np.bincount(ids, minlength=50257))
    assert freq.sum() == 1 << BITS and (freq[np.unique(ids)] > 0).all()
    coder = Coder(freq)
    block = coder.encode(ids)
    assert (coder.decode(block) == ids).all()
    if n > 4097:
        p = freq[ids] / (1 << BITS)
        assert len(block) < -np.log2(p).sum() / 8 * 1.05 + 500
        with pytest.raises(ValueError):
            coder.decode(block[:-8] + bytes(8))


def test_frequencies_of_extreme_counts():
    for counts in (np.ones(50257), np.concatenate(([10**12], np.ones(50256))), np.array([0, 5, 0]), np.zeros(4)):
        freq = scale_frequencies(counts)
        assert freq.sum() == (1 << BITS if counts.any() else 0) and ((freq > 0) == (counts > 0)).all()


def test_encoder_equals_the_library(spark):
    encoder = ByteEncoder(FILE)
    assert encoder.fast
    for r in odd_docs(spark, [(50, "a <|endoftext|> b"), (51, "It's  we'll\x1c\x85 x　\n\n")]).collect():
        assert encoder.encode(r.text or "").tolist() == LIBRARY.encode(r.text or "", add_special_tokens=False).ids


def test_files(spark, tmp_path):
    docs = odd_docs(spark)
    write_token_files(docs, f"file://{tmp_path}/t", FILE, block_ids=500)
    got = sorted(read_token_files(spark, f"file://{tmp_path}/t").collect(), key=lambda r: r.start)
    # Ascending keys, null keys first; equal keys in the order of a hash, so only their places as a group are known.
    keys = [r.doc_id for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    start = 0
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    want = sorted((str(r.doc_id), LIBRARY.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in docs.collect())
    assert sorted((str(r.doc_id), r.ids) for r in got) == want


def test_empty(spark, tmp_path):
    write_token_files(empty_docs(spark), f"file://{tmp_path}/e", FILE)
    assert read_token_files(spark, f"file://{tmp_path}/e").collect() == []
