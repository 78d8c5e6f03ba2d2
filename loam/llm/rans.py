"""Static range asymmetric numeral system over token ids: shared frequencies, independent interleaved blocks.

A block of ids is dealt to LANES coders in turn; all write 32-bit words into one stream of the block. State is 64 bits
wide, so a coder puts out one word a symbol at most and many blocks advance together in numpy. Layout of a block
(little endian): magic, ids, words, crc32 of the ids as 32-bit integers (4 x u4); checkpoints (u4), ids a checkpoint
(u4); for each checkpoint the place of its first word (u4) and the states of all lanes (u8 x LANES); the words (u4).
A checkpoint is where a decoder can begin without what is before it.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Coders a block, ids of one checkpoint interval, bits of the frequency scale, and the least state of a coder.
LANES, INTERVAL, BITS, LOW = 16, 4096, 20, 1 << 31
MAGIC = 0x314E4152


def scale_frequencies(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Counts scaled to sum to 2**bits, each symbol that occurs at least 1; the same input gives the same table."""
    counts = np.asarray(counts, np.int64)
    out = np.zeros(len(counts), np.int64)
    seen = np.flatnonzero(counts)
    if not len(seen):
        return out
    if len(seen) > 1 << bits:
        raise ValueError("more symbols than the scale has slots")
    exact = counts[seen] / counts[seen].sum() * (1 << bits)
    got = np.maximum(1, np.floor(exact)).astype(np.int64)
    while (over := int(got.sum()) - (1 << bits)) > 0:  # symbols raised to 1 take slots from the frequent ones
        room = got - 1
        take = np.minimum(room, np.ceil(room * (over / max(1, room.sum()))).astype(np.int64))
        excess = np.cumsum(take) - over
        take = np.where(excess <= 0, take, np.maximum(0, take - excess))
        got -= take
    got[np.argmax(counts[seen])] += (1 << bits) - int(got.sum())
    out[seen] = got
    return out


class Coder:
    """Encodes and decodes with one frequency table."""

    def __init__(self, freq: np.ndarray, bits: int = BITS):
        self.bits = np.uint64(bits)
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.top = (self.freq << np.uint64(63 - bits))  # a state of this size or more puts out a word first

    def encode(self, ids: np.ndarray) -> bytes:
        """One block."""
        n = len(ids)
        rows = -(-n // LANES)
        per = INTERVAL // LANES
        points = max(1, -(-rows // per))
        # Each interval is coded from the least state, so all intervals of a block advance together.
        grid = np.zeros((points * per, LANES), np.int64)
        used = np.zeros((points * per, LANES), bool)
        grid.reshape(-1)[:n], used.reshape(-1)[:n] = ids, True
        grid, used = grid.reshape(points, per, LANES), used.reshape(points, per, LANES)
        state = np.full((points, LANES), LOW, np.uint64)
        words, put = np.zeros((points, per, LANES), np.uint32), np.zeros((points, per, LANES), bool)
        low, shift = np.uint64(0xFFFFFFFF), np.uint64(32)
        whole = bool(used.all())
        symbol = np.ascontiguousarray(grid.transpose(1, 0, 2))
        freq, start, top = self.freq, self.start, self.top
        for t in range(min(per, rows) - 1, -1, -1):
            s = symbol[t]
            f = freq[s]
            out = state >= top[s]
            if not whole:
                out &= used[:, t]
            words[:, t], put[:, t] = state & low, out
            before = np.where(out, state >> shift, state)
            q = before // f if whole else before // np.maximum(f, np.uint64(1))
            after = (q << self.bits) + (before - q * f) + start[s]
            state = after if whole else np.where(used[:, t], after, before)
        stream = words[put]
        first = np.concatenate(([0], np.cumsum(put.reshape(points, -1).sum(1))[:-1])).astype("<u4")
        head = np.array([MAGIC, n, len(stream), zlib.crc32(np.asarray(ids).astype("<u4").tobytes()), points, INTERVAL], "<u4")
        return head.tobytes() + first.tobytes() + state.astype("<u8").tobytes() + stream.astype("<u4").tobytes()

    def decode(self, block: bytes) -> np.ndarray:
        """The ids of one block; ValueError if they don't have the block's checksum."""
        magic, n, size, crc, points, interval = (int(x) for x in np.frombuffer(block, "<u4", 6))
        if magic != MAGIC or len(block) != 24 + points * (4 + 8 * LANES) + 4 * size:
            raise ValueError("not a block of this format")
        first = np.frombuffer(block, "<u4", points, 24).astype(np.int64)
        state = np.frombuffer(block, "<u8", points * LANES, 24 + 4 * points).reshape(points, LANES).astype(np.uint64)
        stream = np.append(np.frombuffer(block, "<u4", size, 24 + points * (4 + 8 * LANES)), np.uint32(0))
        per, rows = interval // LANES, -(-n // LANES)
        out = np.zeros((points, per, LANES), np.uint32)
        left = n - np.arange(points) * interval
        mask, lane = np.uint64((1 << int(self.bits)) - 1), np.arange(LANES)
        low, shift, whole = np.uint64(LOW), np.uint64(32), n == points * interval
        for t in range(min(per, rows)):
            slot = state & mask
            s = self.slots[slot.astype(np.int64)]
            out[:, t] = s
            after = self.freq[s] * (state >> self.bits) + slot - self.start[s]
            need = after < low
            if not whole:
                on = (t * LANES + lane)[None, :] < left[:, None]
                after = np.where(on, after, state)
                need &= on
            ahead = np.cumsum(need, 1)
            word = stream[np.where(need, first[:, None] + ahead - 1, size)]
            state = np.where(need, (after << shift) | word, after)
            first += ahead[:, -1]
        ids = out.reshape(-1)[:n]
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("checksum of a block differs")
        return ids
