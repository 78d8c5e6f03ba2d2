"""Byte-level BPE ids of whole texts, equal to those of the tokenizers library without added special tokens."""

from __future__ import annotations

import json

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Fixed value: how byte-level BPE files of this kind split a text, one alternative a line.
PATTERN = "|".join((
    r"'(?:[sdmt]|ll|ve|re)",
    r" ?\p{L}+",
    r" ?\p{N}+",
    r" ?[^\s\p{L}\p{N}]+",
    r"\s+(?!\S)",
    r"\s+",
))


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in such a file: printable ones for themselves, the others from 256 up."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


#: One text of so many of a task goes through the library as well.
CHECK_EVERY = 100


def plain(held: dict, symbols: dict[str, int]) -> bool:
    """Whether a file is byte-level BPE without any option that changes ids, each of whose merges makes the token of the
    next id: then the lowest rank that can be merged is the lowest id, which is all that the second engine goes by."""
    model, cut = held["model"], held.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback", "fuse_unk", "unk_token")):
        return False
    if held.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        return False
    vocab = model["vocab"]
    made = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    return sorted(vocab[c] for c in symbols if c in vocab) == list(range(256)) and made == list(range(256, 256 + len(made))) and len(vocab) - len(made) - 256 in (0, len(set(vocab) & {t["content"] for t in held.get("added_tokens", [])}))


class ByteEncoder:
    """Reads a tokenizer file of the tokenizers library.

    Where the file is plain byte-level BPE whose ids are the ranks of its merges, a second engine with the same
    vocabulary does the work several times faster: the file is read for that, merge by merge (`plain`), a probe at the
    start and one text in CHECK_EVERY are held against the library, and a text with the string of a special token goes to
    the library itself. Any other file is left to the library throughout.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.size = self.library.get_vocab_size()
        self.fast, self.seen = self._fast(path), 0

    def _fast(self, path: str) -> tiktoken.Encoding | None:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        symbols = byte_symbols()
        if not plain(held, symbols):
            return None
        try:
            ranks = {bytes(symbols[c] for c in token): i for token, i in held["model"]["vocab"].items() if token not in self.special}
            engine = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        except (KeyError, ValueError):
            return None
        probe = "It's 'LL we'll\t\tabc  12345 \n\n  x 　y\x1c\x85z!?.. \U0001f525日本AKIA  "
        return engine if engine.encode_ordinary(probe) == self.library.encode(probe, add_special_tokens=False).ids else None

    def encode(self, text: str) -> np.ndarray:
        """All ids of a text as unsigned 32-bit integers."""
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        ids = self.fast.encode_to_numpy(text, disallowed_special=())
        self.seen += 1
        if self.seen % CHECK_EVERY == 1 and ids.tolist() != self.library.encode(text, add_special_tokens=False).ids:
            raise RuntimeError("the second engine's ids differ from the library's: this file needs the library (fast = None)")
        return ids
