"""Exact Jaccard join of word-shingle sets by a universe-partition pigeonhole.

Two sets of a and b shingles with similarity t differ in H = (1 - t) / (1 + t) * (a + b) shingles at most. By size
band, a hash deals the universe of shingles into segments; a set's part in a segment is its subset. Give each segment i
a number v_i of 0, 1 or 2 with a sum over H: then a similar set differs in fewer than v_i shingles in some segment. With
v = 1 it has the same subset; with v = 2 its subset, one-deletion neighbourhoods included, meets this one's.

The index holds every subset of every set, in small bands with its one-deletion neighbourhood. How long its lists are is
measured first. Then each set allocates: it takes units of v where the lists are shortest until their sum is over H, a
few more where that is nearly free, and looks up those lists alone; so one lookup pair is a candidate only if it shares
as many units as the sum is over H. Subsets that nobody else has cost nothing and give no pairs.

  level 0  subsets alone (large bands; each withstands no difference),
  level 1  subsets and one-deletion neighbourhoods (a subset of two or more shingles can be given v = 2),
  level 2  each shingle by itself (the smallest bands, and sets whose subsets are too few on the levels before).

Lists of more than `heavy` sets are not looked up. Sets that can't reach the sum without them (mostly in large groups of
near copies) meet in clusters: all sets of a cluster whose sizes allow it are compared, in blocks, and a block passes on
numbers of links and a spanning forest. So no link is lost and no group is paired out. A set whose subsets are too few on
a level goes on to the next; sets that stop there find it by their own allocation, or, if they can't reach their sum,
by its looking up all its lists of that level. No task holds a long list: a
batch that has over `heavy` sets on an entry sends a mark to the entry's place and deals the sets elsewhere. Candidates
are verified on whole sets. Sets go by their 64-bit hash (node) throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from loam.llm.common import bounded_batches, drop_table, join_keyed, materialize, release_shuffles, table, text_blocks
from loam.llm.components import components
from loam.llm.shingles import mix, shingle_sets

#: Mean shingles of a segment at the top of a band on levels 0 and 1; bands (powers of two) where each may begin.
FILL, BEGIN = (3, 4), (128, 16)
#: Sets on an index entry beyond which it is not looked up; the length of lists that are looked up beyond need.
HEAVY, CHEAP = 32, 3
#: Index entries of a bucket and of a batch, sets of a verification block, and shingles of its sets, about.
BUCKET_ROWS, BATCH_ROWS, BLOCK, BLOCK_SHINGLES = 600_000, 1_000_000, 1024, 1_000_000
#: Buckets of entries, and of entries of sets without a guarantee, at least.
BUCKETS, CLUSTER_BUCKETS = 64, 24
#: Slots by which shingles of sets without a guarantee are counted, as a power of two, at most; slots that are added up together.
MOST_SLOTS, COUNT_SLICE = 20, 1 << 16
#: Candidate sets up to which their ids are broadcast (8 bytes each); beyond, a shuffled join finds their texts.
BROADCAST_IDS = 500_000
_SEED = np.uint64(0xA0761D6478BD642F)

# Code of an entry: on a heavy list, a mark instead of a set, kind, scheme (band and level), and segment.
_HEAVY, _MARK, _SEGMENT = np.uint32(1 << 31), np.uint32(1 << 30), (1 << 21) - 1
#: Kinds of entries: a subset that can be given v = 1 at most; one that can be given 2; one of its deletions.
_ONE, _TWO, _LESS = 0, 1, 2
#: Cost of a heavy list.
_DEAR = 1 << 20

Scheme = tuple[int, int, np.ndarray | None, np.ndarray | None, np.ndarray | None]


def spread(size: int, num: int, den: int) -> int:
    """Most shingles in which a set of this size and a similar one (similarity num/den or more) can differ."""
    return size * (den - num) // num


def schemes(s: np.ndarray, num: int, den: int, fill: tuple[float, float] = FILL) -> list[Scheme]:
    """How one sorted set is indexed: scheme code (band * 4 + level), units of v that it can give, and for levels 0 and 1
    where each subset begins, its size, and its segment. For each band the last scheme has units enough, the ones before
    it have not: sets that stop there find this one by their own allocation."""
    size = len(s)
    need = spread(size, num, den) + 1
    band = size.bit_length() - 1
    # A smaller set of the band below may be similar: its scheme is used too.
    bands = (band, band - 1) if band and size * num < (1 << band) * den else (band,)
    out: list[Scheme] = []
    for k in bands:
        for level in range(0 if 1 << k >= BEGIN[0] else 1 if 1 << k >= BEGIN[1] else 2, 3):
            if level == 2:
                out.append((k * 4 + 2, size, None, None, None))
                break
            segment = ((s >> np.uint64(32)) * np.uint64(max(1, int((2 << k) // fill[level])))) >> np.uint64(32)
            first = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
            many = np.diff(np.append(first, size))
            units = len(first) if level == 0 else int(np.minimum(many, 2).sum())
            if level == 1 and len(first) > _SEGMENT:
                continue
            out.append((k * 4 + level, units, first, many, segment))
            if units >= need:
                break
    return out


def final_units(found: list[Scheme], need: int) -> list[int]:
    """scheme, units, ... of the schemes by which a set allocates."""
    return [x for code, units, *_ in found if units >= need for x in (code, units)]


def index_entries(s: np.ndarray, found: list[Scheme], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """All index entries of one sorted set and their codes."""
    keys, codes = [], []
    for code, _, first, many, segment in found:
        tag = mix(np.array([(seed << 16) + code], np.uint64))[0] ^ _SEED
        token, scheme = mix(s ^ tag), code << 21
        if first is None:
            keys.append(token)
            codes.append(np.full(len(s), scheme, np.uint32))
            continue
        subset = np.add.reduceat(token, first)
        keys.append(mix(subset ^ segment[first] ^ tag))
        if code % 4 == 0:
            codes.append(np.full(len(first), scheme, np.uint32))
            continue
        at = np.arange(len(first))
        codes.append((scheme | np.where(many > 1, _TWO << 28, _ONE) | at).astype(np.uint32))
        some = np.repeat(many > 1, many)
        keys.append(mix((np.repeat(subset, many) - token)[some] ^ segment[some] ^ tag))
        codes.append((scheme | (_LESS << 28) | np.repeat(at, many)[some]).astype(np.uint32))
    return np.concatenate(keys), np.concatenate(codes)


def identities(values: np.ndarray, bounds: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    n = np.diff(bounds)
    out = []
    for k in (1, 2):
        total = np.concatenate(([np.uint64(0)], np.cumsum(mix(values ^ mix(np.array([seed * 2 + k], np.uint64))[0]))))
        out.append(mix(total[bounds[1:]] - total[bounds[:-1]] + n.astype(np.uint64)))
    return out[0], out[1]


def size_code(n: np.ndarray) -> np.ndarray:
    return np.round(np.log(np.maximum(n, 1)) / np.log(1.01)).astype(np.uint16)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values begins, and its length."""
    at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
    return at, np.diff(np.append(at, len(x)))


def _packed(group: np.ndarray, groups: int, *columns: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Rows by group: each group that has some, and its columns' bytes one after the other."""
    order = np.argsort(group, kind="stable")
    cuts = np.searchsorted(group[order], np.arange(groups + 1)) if groups < len(group) else None
    if cuts is None:
        at, many = _runs(group[order])
        spans = [(int(group[order[a]]), a, a + n) for a, n in zip(at, many, strict=True)]
    else:
        spans = [(k, a, b) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
    columns = [c[order] for c in columns]
    return [k for k, _, _ in spans], [b"".join(c[a:b].tobytes() for c in columns) for _, a, b in spans]


def _opened(blobs: list, *kinds: str) -> list[np.ndarray]:
    """The columns of packed rows."""
    width = sum(np.dtype(k).itemsize for k in kinds)
    out: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in kinds]
    for blob in blobs:
        raw = blob.as_buffer()
        n, at = raw.size // width, 0
        for column, kind in zip(out, kinds, strict=True):
            column.append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(c) for c in out]


def _bucket_of(entry: np.ndarray, buckets: int) -> np.ndarray:
    return (((entry >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _nodes(docs: DataFrame, width: int, num: int, den: int, seed: int, fill: tuple[float, float]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            values, bounds = shingle_sets(block.column("text"), width)
            node, check = identities(values, bounds, seed)
            n = np.diff(bounds)
            told = [final_units(schemes(values[a:b], num, den, fill), spread(b - a, num, den) + 1) if b > a else [] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            cols = [block.column("doc_id"), pa.array(n), pa.array(node.view(np.int64)), pa.array(check.view(np.int64)), pa.array(told, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "node", "check", "units"])

    return docs.mapInArrow(run, "doc_id long, n long, node long, check long, units array<int>")


def _buckets(docs: DataFrame, width: int, num: int, den: int, seed: int, buckets: int, heavy: int, fill: tuple[float, float]) -> DataFrame:
    """Index entries as packed blobs, one row for a bucket and a batch of a task: entries, nodes, codes and size codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        done: set[int] = set()
        parts: list[tuple] = []
        held = flushes = 0

        def flush() -> pa.RecordBatch:
            many = [len(p[0]) for p in parts]
            entry, code = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            node, size = np.repeat(np.array([p[2] for p in parts], np.uint64), many), np.repeat(np.array([p[3] for p in parts], np.uint16), many)
            order = np.argsort(entry, kind="stable")
            entry, code, node, size = entry[order], code[order], node[order], size[order]
            home = _bucket_of(entry, buckets)
            at, count = _runs(entry)
            if (dear := count > heavy).any():
                # Sets on an entry that is heavy for certain: a mark goes to its bucket, they go to one of this batch.
                marks = entry[at[dear]]
                own = np.repeat(dear, count)
                salt = mix(np.array([(TaskContext.get().partitionId() << 24) + flushes], np.uint64))[0]
                home[own] = _bucket_of(mix(entry[own] ^ salt), buckets)
                code[own] |= _HEAVY
                home, entry = np.concatenate((home, _bucket_of(marks, buckets))), np.concatenate((entry, marks))
                code = np.concatenate((code, np.full(len(marks), _HEAVY | _MARK)))
                node, size = np.concatenate((node, np.zeros(len(marks), np.uint64))), np.concatenate((size, np.zeros(len(marks), np.uint16)))
            to, blobs = _packed(home, buckets, entry, node, code, size)
            return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        for block in text_blocks(batches):
            values, bounds = shingle_sets(block.column("text"), width)
            node, _ = identities(values, bounds, seed)
            codes = size_code(np.diff(bounds))
            for i in np.flatnonzero(np.diff(bounds)):
                if (own := int(node[i])) not in done:  # equal sets of a task are indexed once
                    done.add(own)
                    one = values[bounds[i] : bounds[i + 1]]
                    keys, code = index_entries(one, schemes(one, num, den, fill), seed)
                    parts.append((keys, code, own, codes[i]))
                    held += len(keys)
            if len(done) > 200_000:
                done.clear()
            if held >= BATCH_ROWS or len(parts) >= 50_000:
                yield flush()
                parts, held, flushes = [], 0, flushes + 1
        if parts:
            yield flush()

    return docs.mapInArrow(run, "bucket int, blob binary")


def _measure(blobs: DataFrame, heavy: int, node_buckets: int) -> DataFrame:
    """kind 0: the lists of a bucket that several sets share and that are not heavy (entry, node, code, size code); kind 1: by
    bucket of nodes, what each list costs each of its sets (node, entry, code, sets that v = 1 meets, sets that v = 2
    meets besides)."""

    def run(t: pa.Table) -> pa.Table:
        entry, node, code, size = _opened([b for c in t.column("blob").chunks for b in c], "<u8", "<u8", "<u4", "<u2")
        order = np.argsort(entry, kind="stable")
        at, many = _runs(entry[order])
        if len(at):  # what one set alone has costs nothing
            order = order[np.repeat((many > 1) | (np.bitwise_or.reduceat(code[order], at) >= _HEAVY), many)]
        order = order[np.lexsort((node[order], entry[order]))]
        entry, node, code, size = entry[order], node[order], code[order], size[order]
        at, many = _runs(entry)
        flag = np.repeat(np.bitwise_or.reduceat(code, at) >= _HEAVY, many) if len(at) else np.zeros(0, bool)
        keep = (code & _MARK) == 0
        keep[1:] &= (entry[1:] != entry[:-1]) | (node[1:] != node[:-1])  # equal sets of several tasks
        entry, node, code, size, flag = entry[keep], node[keep], code[keep] & ~_HEAVY, size[keep], flag[keep]
        kind = (code >> np.uint32(28)) & np.uint32(3)
        at, many = _runs(entry)
        whole = np.add.reduceat((kind != _LESS).astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
        dear = np.repeat(many > heavy, many) | flag
        whole, less = np.repeat(whole, many), np.repeat(many - whole, many)
        one = np.where(dear, _DEAR, whole - (kind != _LESS))
        two = np.where(dear, _DEAR, np.where(kind == _TWO, less, 0))
        told = (one > 0) | (two > 0)
        to, out = _packed((node[told].view(np.int64) % node_buckets).astype(np.int64), node_buckets, node[told], entry[told], code[told], one[told].astype(np.uint32), two[told].astype(np.uint32))
        live = ~dear & (np.repeat(many, many) > 1) & (whole > 0)
        kinds, at, out = [1] * len(to) + [0], [*to, t.column("bucket")[0].as_py()], [*out, b"".join(c[live].tobytes() for c in (entry, node, code, size))]
        return pa.table([pa.array(kinds, pa.int32()), pa.array(at, pa.int32()), pa.array(out, pa.binary())], names=["kind", "bucket", "blob"])

    return blobs.groupBy("bucket").applyInArrow(run, "kind int, bucket int, blob binary")


def allocate(node: np.ndarray, code: np.ndarray, one: np.ndarray, two: np.ndarray, facts: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Which lists each set looks up, from what they cost it.

    facts: group (place of the set times 128, and scheme), units and need of every allocation, by group; node: place of
    the set of each record. Gives for each record 0, or what it looks up (1: subsets, 2: subsets and deletions, from a
    subset; 3: subsets, from a deletion), for each allocation how many units a similar set shares at least, whether it
    would need a heavy list, and whether it looks up any; last, which sets have a heavy list on a level that they went
    beyond, where they look up all others.
    """
    scheme = (code >> np.uint32(21)).astype(np.int64) & 127
    kind, segment = (code >> np.uint32(28)) & np.uint32(3), code.astype(np.int64) & _SEGMENT
    group = np.searchsorted(facts["group"], node * 128 + scheme)
    own = (group < len(facts["group"])) & (facts["group"][np.minimum(group, len(facts["group"]) - 1)] == node * 128 + scheme)  # other schemes are there to be found
    groups, need = len(facts["group"]), facts["need"]
    plain, paired = np.flatnonzero(own & (kind == _ONE)), np.flatnonzero(own & (kind != _ONE))
    # A subset that can be given 2: its first unit costs its own list, its second the lists of deletions.
    pair, place = np.unique(group[paired] << 21 | segment[paired], return_inverse=True)
    first, second = np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64)
    subset = kind[paired] == _TWO
    np.add.at(first, place[subset], one[paired][subset])
    np.add.at(second, place, np.where(subset, two[paired], one[paired]))
    owner = pair >> 21
    free = facts["units"] - np.bincount(group[plain], minlength=groups) - 2 * np.bincount(owner, minlength=groups)
    more = need - free
    by = np.concatenate((group[plain], owner, owner))
    cost = np.concatenate((one[plain], first, np.maximum(first, second)))  # the second unit is never taken before the first
    unit = np.repeat(np.array([0, 0, 1]), (len(plain), len(pair), len(pair)))
    order = np.lexsort((unit, cost, by))
    at, many = _runs(by[order])
    rank = np.empty(len(by), np.int64)
    rank[order] = np.arange(len(by)) - np.repeat(at, many)
    must = rank < more[by]
    dense = np.bincount(by[must & (cost >= _DEAR)], minlength=groups) > 0
    take = (must | (cost <= CHEAP)) & (more[by] > 0) & ~dense[by]
    least = free + np.bincount(by[take], minlength=groups) - (need - 1)
    mode = np.zeros(len(node), np.int64)
    mode[plain[take[: len(plain)]]] = 1
    v = take[len(plain) : len(plain) + len(pair)].astype(np.int64) + take[len(plain) + len(pair) :]
    mode[paired] = np.where(subset, v[place], np.where(v[place] == 2, 3, 0))
    beyond, dear = ~own, one >= _DEAR
    mode[beyond & ~dear] = kind[beyond & ~dear] + 1
    return mode, least, dense, more > 0, np.unique(node[beyond & dear])


def _allocate(costs: DataFrame, facts: DataFrame, num: int, den: int, buckets: int) -> DataFrame:
    """kind 0: by bucket, lists that sets look up (entry, node, scheme, mode, size code); kind 1: how many units a similar set
    shares at least (node, scheme, units); kind 2: nodes that need heavy lists."""

    def run(told: pa.Table, known: pa.Table) -> pa.Table:
        names = ["kind", "bucket", "blob"]
        none = pa.table([pa.array([], k) for k in (pa.int32(), pa.int32(), pa.binary())], names=names)
        if not told.num_rows:
            return none
        node, entry, code, one, two = _opened([b for c in told.column("blob").chunks for b in c], "<i8", "<u8", "<u4", "<u4", "<u4")
        known = known.sort_by("node").combine_chunks()
        nodes, size = np.asarray(known.column("node")), np.asarray(known.column("n"))
        units = known.column("units").combine_chunks()
        flat, pairs = np.asarray(units.flatten()).astype(np.int64).reshape(-1, 2), np.asarray(units.value_lengths()) // 2
        place = np.repeat(np.arange(len(nodes)), pairs)
        group = place * 128 + flat[:, 0]
        order = np.argsort(group)
        facts = {"group": group[order], "units": flat[order, 1], "need": np.array([spread(int(x), num, den) + 1 for x in size], np.int64)[place[order]]}
        at = np.searchsorted(nodes, node)
        mode, least, dense, asks, past = allocate(at, code, one.astype(np.int64), two.astype(np.int64), facts)
        some = mode > 0
        to, blobs = _packed(_bucket_of(entry[some], buckets), buckets, entry[some], node[some], ((code[some] >> np.uint32(21)) & np.uint32(127)).astype(np.uint8), mode[some].astype(np.uint8), size_code(size[at[some]]))
        own, bare = asks & ~dense, np.union1d(facts["group"][dense] >> 7, past)
        least = b"".join(c.tobytes() for c in (nodes[facts["group"][own] >> 7], (facts["group"][own] & 127).astype(np.uint8), least[own].astype(np.int32)))
        return pa.table([pa.array([0] * len(to) + [1, 2], pa.int32()), pa.array([*to, 0, 0], pa.int32()), pa.array([*blobs, least, nodes[bare].tobytes()], pa.binary())], names=names)

    return costs.groupBy("bucket").cogroup(facts.groupBy("bucket")).applyInArrow(run, "kind int, bucket int, blob binary")


def _look_up(lists: DataFrame, asked: DataFrame, num: int, den: int) -> DataFrame:
    """x, y, scheme, n: set y shares n units with the lists of the bucket that set x looks up; sizes allow similarity."""
    reach = int(np.ceil(np.log(den / num) / np.log(1.01))) + 1

    def run(held: pa.Table, looked: pa.Table) -> pa.Table:
        entry, node, code, size = _opened([b for c in held.column("blob").chunks for b in c], "<u8", "<i8", "<u4", "<u2")
        key, own, scheme, mode, near = _opened([b for c in looked.column("blob").chunks for b in c], "<u8", "<i8", "<u1", "<u1", "<u2")
        lo, hi = np.searchsorted(entry, key), np.searchsorted(entry, key, side="right")
        out = []
        for a in range(0, len(key), 100_000):
            many = (hi - lo)[a : a + 100_000]
            who = np.repeat(np.arange(a, a + len(many)), many)
            at = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo[a : a + 100_000], many)
            less = (code[at] >> np.uint32(28)) & np.uint32(3) == _LESS
            share = np.where(less, (mode[who] == 2).astype(np.int64), np.where(mode[who] == 2, 2, 1))
            keep = (share > 0) & (node[at] != own[who]) & (np.abs(size[at].astype(np.int32) - near[who]) <= reach)
            out.append((own[who[keep]], node[at[keep]], scheme[who[keep]], share[keep]))
        x, y, k, n = (np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(4))
        order = np.lexsort((k, y, x))
        x, y, k, n = x[order], y[order], k[order], n[order]
        at = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (k[1:] != k[:-1])))) if len(x) else np.zeros(0, np.int64)
        n = np.add.reduceat(n, at) if len(at) else n
        return pa.table([pa.array(x[at]), pa.array(y[at]), pa.array(k[at].astype(np.int32)), pa.array(n.astype(np.int64))], names=["x", "y", "scheme", "n"])

    return lists.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(run, "x long, y long, scheme int, n long")


def _rows_of(blobs: DataFrame, names: list[str], *kinds: str) -> DataFrame:
    """Packed rows as rows; all columns become longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in _opened(list(batch.column("blob")), *kinds)], names=names)

    return blobs.select("blob").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _alike(a: bytes, b: bytes, num: int, den: int) -> bool:
    both = np.concatenate((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return den * shared >= num * (len(both) - shared)


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of pairs (a, b) whose whole sets are similar. One set of a pair travels to the other's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [_alike(x.as_buffer(), y.as_buffer(), num, den) for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _counts(sets: DataFrame, slots: int) -> np.ndarray:
    """How many of the sets' shingles fall in each of `slots` slots, a power of two; added up slice by slice."""
    part = min(slots, COUNT_SLICE)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(slots, np.int64)
        for batch in batches:
            for s in batch.column("shingles"):
                np.add.at(n, _slots(np.frombuffer(s.as_buffer(), np.uint64), slots), 1)
        some = np.flatnonzero(n.reshape(-1, part).any(1))
        blobs = [n[k * part : (k + 1) * part].tobytes() for k in some.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(blobs, pa.binary())], names=["slice", "blob"])

    def add(t: pa.Table) -> pa.Table:
        n = np.zeros(part, np.int64)
        for blob in (b for chunk in t.column("blob").chunks for b in chunk):
            n += np.frombuffer(blob.as_buffer(), np.int64)
        return pa.table([t.column("slice").slice(0, 1).combine_chunks(), pa.array([n.tobytes()], pa.binary())], names=["slice", "blob"])

    out = np.zeros(slots, np.int64)
    for row in sets.select("shingles").mapInArrow(count, "slice int, blob binary").groupBy("slice").applyInArrow(add, "slice int, blob binary").collect():
        out[row["slice"] * part : (row["slice"] + 1) * part] = np.frombuffer(row["blob"], np.int64)
    return out


def _slots(s: np.ndarray, slots: int) -> np.ndarray:
    return (mix(s ^ _SEED) & np.uint64(slots - 1)).astype(np.int64)


def rarest(s: np.ndarray, counts: np.ndarray, num: int, den: int) -> np.ndarray:
    """So many of a set's shingles, the rarest ones by `counts`, that every similar set has one of them among its own.

    Similar sets share num/den of the larger one at least, and shingles have one order for all sets; what `counts` says
    decides how large clusters become, not what is found.
    """
    most = len(s) + (-num * len(s)) // den + 1
    return s[np.lexsort((s, counts[_slots(s, len(counts))]))[:most]]


def _clusters(sets: DataFrame, num: int, den: int, buckets: int, slots: int) -> DataFrame:
    """node, component: connected components of sets that have one of their rarest shingles in common.

    What many sets have beside other things, as a common passage, joins none of them. A batch joins its own sets by
    itself and gives an edge a set; only one set for each of its shingles goes on, packed, to the shingle's bucket. So
    what meets there of the most frequent one are as many sets as there are batches.
    """
    counts = sets.sparkSession.sparkContext.broadcast(_counts(sets, slots))

    def joined(a: np.ndarray, b: np.ndarray) -> dict[int, int]:
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        for x, y in np.unique(np.stack((a, b), 1)[a != b], axis=0).tolist():
            x, y = top(x), top(y)
            if x != y:
                root[max(x, y)] = min(x, y)
        return {x: top(x) for x in root}

    def hubs(entry: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
        """The distinct entries, the first set of each, and the sets' roots when sets of one entry are joined."""
        order = np.lexsort((rep, entry))
        at, many = _runs(entry[order])
        return entry[order][at], rep[order][at], joined(rep[order], np.repeat(rep[order][at], many))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "bucket", "blob"]
        for batch in batches:
            own = [np.frombuffer(s.as_buffer(), np.uint64) for s in batch.column("shingles")]
            if not own:
                continue
            own = [rarest(s, counts.value, num, den) for s in own]
            entry, first, root = hubs(np.concatenate(own), np.repeat(np.array(batch.column("node").to_pylist(), np.int64), [len(o) for o in own]))
            if root:
                ends = np.array(list(root.items()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1]), pa.nulls(len(ends), pa.int32()), pa.nulls(len(ends), pa.binary())], names=names)
            first = np.array([root.get(x, x) for x in first.tolist()], np.int64)
            to, blobs = _packed((entry % np.uint64(buckets)).astype(np.int64), buckets, entry, first)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(to), pa.int64()), pa.nulls(len(to), pa.int64()), pa.array(to, pa.int32()), pa.array(blobs, pa.binary())], names=names)

    def join(t: pa.Table) -> pa.Table:
        root = hubs(*_opened([b for c in t.column("blob").chunks for b in c], "<u8", "<i8"))[2]
        return pa.table([pa.array(list(root), pa.int64()), pa.array(list(root.values()), pa.int64())], names=["a", "b"])

    dealt = materialize(sets.select("node", "shingles").mapInArrow(deal, "a long, b long, bucket int, blob binary"), "dealt")
    edges = dealt.where("bucket is not null").select("bucket", "blob").groupBy("bucket").applyInArrow(join, "a long, b long").unionByName(dealt.where("bucket is null").select("a", "b"))
    out = components(edges)
    drop_table(dealt)
    return out


def _similar(sets: list[np.ndarray], k: int, num: int, den: int) -> np.ndarray:
    """Which of the first k sets (rows) and of the others (columns; of the same ones if there are no others) are similar, by products of incidence matrices."""
    o = k if k < len(sets) else 0
    flat = np.concatenate(sets)
    who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    size = np.array([len(s) for s in sets])
    inter = np.zeros((k, len(sets) - o), np.float32)
    col = np.cumsum(count > 1) - 1
    live = count[at] > 1
    who, at = who[live], col[at[live]]
    order = np.argsort(at, kind="stable")
    who, at = who[order], at[order]
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
        a, b = np.searchsorted(at, (lo, lo + 4096))
        m = np.zeros((len(sets), min(4096, int(at[-1]) + 1 - lo)), np.float32)
        m[who[a:b], at[a:b] - lo] = 1
        inter += m[:k] @ m[o:].T
    both = inter.astype(np.int64)
    return den * both >= num * (size[:k, None] + size[None, o:] - both)


def _forest(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column of a bipartite graph a row of its component; -1 for a column without an edge."""
    rows, cols = np.full(hit.shape[0], -1), np.full(hit.shape[1], -1)
    for i in range(len(rows)):
        if rows[i] < 0:
            rows[i] = i
            new = np.array([i])
            while len(new):
                reached = np.flatnonzero(hit[new].any(0) & (cols < 0))
                cols[reached] = i
                new = np.flatnonzero(hit[:, reached].any(1) & (rows < 0))
                rows[new] = i
    return rows, cols


def _cluster_links(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """node, hub, links: for each block the documents that a set is linked with there, and a set that its links lead to.

    members: cluster, node, n, docs. Sets are banded by size so that similar ones are in one band or in two side by
    side; a band of a cluster is cut into parts of about BLOCK sets and BLOCK_SHINGLES shingles, and each pair of parts
    that can hold a link is a group of its own.
    """
    step = max(float(np.log(den / num)), 0.01) * (1 + 1e-9)
    rows = members.withColumn("band", F.floor(F.log("n") / step).cast("int"))
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    cells = rows.groupBy("cluster", "band").agg(parts.alias("_parts"), F.count(F.lit(1)).alias("_many"))
    beside = lambda by, name: cells.select("cluster", (F.col("band") + by).alias("band"), F.col("_parts").alias(name))
    cells = materialize(cells.join(beside(1, "_below"), ["cluster", "band"], "left").join(beside(-1, "_above"), ["cluster", "band"], "left"), "cells")
    rows = join_keyed(rows, cells, ["cluster", "band"], "_many", F.col("node"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), "_parts").cast("int"))
    groups = """concat(
        if(_many > 1, transform(sequence(0, _parts - 1), q -> struct(band as lo, least(part, q) as i, band as hi, greatest(part, q) as j)), array()),
        if(_above is null, array(), transform(sequence(0, _above - 1), q -> struct(band as lo, part as i, band + 1 as hi, q as j))),
        if(_below is null, array(), transform(sequence(0, _below - 1), q -> struct(band - 1 as lo, q as i, band as hi, part as j))))"""
    dealt = rows.withColumn("_g", F.explode(F.expr(groups))).select("cluster", "_g.*", "node", "docs", F.expr("band = _g.lo and part = _g.i").alias("is_row"))
    dealt = dealt.join(sets.select("node", "shingles"), "node")

    def run(t: pa.Table) -> pa.Table:
        is_row = np.array(t.column("is_row").to_pylist(), bool)
        order = np.argsort(~is_row, kind="stable")
        k = int(is_row.sum())
        blobs = [b.as_buffer() for chunk in t.column("shingles").chunks for b in chunk]
        node, docs = (np.array(t.column(c).to_pylist(), np.int64)[order] for c in ("node", "docs"))
        alone = t.column("lo")[0] == t.column("hi")[0] and t.column("i")[0] == t.column("j")[0]
        if not k or not alone and k == len(node):
            node = node[:0]
            hub, links = node, node
        else:
            hit = _similar([np.frombuffer(blobs[x], np.uint64) for x in order], k, num, den)
            if alone:
                np.fill_diagonal(hit, True)  # shingles that one set alone has are not counted, so its own place may be unset
            up, down = _forest(hit)
            if alone:
                hub, links = node[up], hit @ docs - docs
            else:
                hub, links = node[np.concatenate((up, down))], np.concatenate((hit @ docs[k:], docs[:k] @ hit))
            some = links > 0
            node, hub, links = node[some], hub[some], links[some]
        return pa.table([pa.array(node), pa.array(hub), pa.array(links, pa.int64())], names=["node", "hub", "links"])

    return dealt.groupBy("cluster", "lo", "i", "hi", "j").applyInArrow(run, "node long, hub long, links long")


def _linked(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, heavy: int | None = HEAVY, key: str = "doc_id", text: str = "text", cleanup: bool = True, fill: tuple[float, float] = FILL) -> tuple[DataFrame, int]:
    """The columns of near_duplicates with node (null for the empty set) and root (a component's least node) beside
    them, and the seed of the nodes. heavy: None for no limit; fill: mean shingles of a segment on levels 0 and 1."""
    bounded_batches(docs.sparkSession)
    heavy = heavy or 1 << 40
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    for seed in range(8):
        nodes = materialize(_nodes(docs, width, num, den, seed, fill), "nodes")
        classes = nodes.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("docs"), F.first("n").alias("n"), F.first("units").alias("units"), (F.min("check") != F.max("check")).alias("clash"))
        classes = materialize(classes, "classes")
        told = classes.agg(F.count(F.lit(1)).alias("sets"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("clash"), F.lit(False)).alias("clash")).first()
        if not told["clash"]:  # two sets with one 64-bit hash, told apart by another: hash anew
            break
        drop_table(nodes), drop_table(classes)
    info = classes.select("node", "doc_id", "docs", "n")
    buckets = max(BUCKETS, -(-int(0.6 * told["n"]) // BUCKET_ROWS))
    met = materialize(_measure(_buckets(docs, width, num, den, seed, buckets, heavy, fill), heavy, buckets), "met")
    release_shuffles(docs.sparkSession)
    facts = classes.select(F.pmod("node", F.lit(buckets)).cast("int").alias("bucket"), "node", "n", "units")
    chosen = materialize(_allocate(met.where("kind = 1").select("bucket", "blob"), facts, num, den, buckets), "chosen")
    found = _look_up(met.where("kind = 0").select("bucket", "blob"), chosen.where("kind = 0").select("bucket", "blob"), num, den)
    enough = _rows_of(chosen.where("kind = 1"), ["x", "scheme", "least"], "<i8", "<u1", "<i4")
    found = found.groupBy("x", "y", "scheme").agg(F.sum("n").alias("n")).join(enough, ["x", "scheme"], "left").where("least is null or n >= least")
    found = materialize(found.select("x", "y", F.col("least").isNull().alias("beyond")), "found")
    looked = found
    # Sets that need heavy lists.
    bare = materialize(_rows_of(chosen.where("kind = 2"), ["node"], "<i8").distinct().join(info, "node").select("node", "n", "docs"), "bare")
    # On a level that a set went beyond it has to find only those that can't find it.
    found = found.where("not beyond").unionByName(found.where("beyond").join(bare.select(F.col("node").alias("y")), "y", "left_semi").select("x", "y", "beyond"))
    pairs = materialize(found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")
    spare = [classes, pairs, bare]
    drop_table(looked)
    drop_table(met)
    drop_table(chosen)
    release_shuffles(docs.sparkSession)

    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(bare.select("node")).distinct()
    wanted = materialize(wanted.join(info.select("node", "doc_id"), "node"), "wanted")
    spare.append(wanted)
    ids = wanted.where("doc_id is not null").select("doc_id").distinct()
    named = docs.join(F.broadcast(ids) if wanted.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    if wanted.where("doc_id is null").limit(1).count():
        named = named.unionByName(docs.where("doc_id is null"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            values, bounds = shingle_sets(block.column("text"), width)
            node, _ = identities(values, bounds, seed)
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array([values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["node", "shingles"])

    own = named.mapInArrow(take, "node long, shingles binary")
    # A doc_id that stands on several texts brings other sets along; the node tells whose set it is.
    sets = materialize(own.join(wanted.select("node"), "node").groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
    spare.append(sets)
    bulk = bare.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    more = None
    if bulk:
        slots = 1 << min(MOST_SLOTS, max(8, int(bulk).bit_length()))
        clustered = _clusters(sets.join(bare.select("node"), "node", "left_semi"), num, den, max(CLUSTER_BUCKETS, -(-int(0.6 * bulk) // BUCKET_ROWS)), slots)
        spare.append(clustered)
        release_shuffles(docs.sparkSession)
        more = materialize(_cluster_links(clustered.withColumnRenamed("component", "cluster").join(bare, "node"), sets, num, den), "links")
        spare.append(more)
        # Pairs of one cluster have met there.
        of = lambda p: clustered.select(F.col("node").alias(p), F.col("component").alias(f"_{p}"))
        pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where("not (_a <=> _b) or _a is null").select("a", "b")
    release_shuffles(docs.sparkSession)
    links = materialize(_verify(pairs, sets, num, den), "links")
    release_shuffles(docs.sparkSession)
    spare.append(links)
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    told = both.join(info.select(F.col("node").alias("other"), F.col("docs").alias("links")), "other").select("node", "links")
    edges = links
    if more is not None:
        told = told.unionByName(more.select("node", "links"))
        edges = edges.unionByName(more.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    found = components(edges)
    spare.append(found)
    label = info.join(found.select("node", F.col("component").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    label = label.join(told.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
    label = label.select("node", "root", "doc_id", "docs", (F.coalesce("links", F.lit(0)) + F.col("docs") - 1).alias("n_links"))
    label = materialize(label, "label")
    least = materialize(label.groupBy("root").agg(F.count(F.lit(1)).alias("_sets"), F.min("doc_id").alias("least")).where("_sets > 1"), "least")
    if cleanup:
        for t in spare:
            drop_table(t)
    # A component of one set has that set's doc_id; only the others are looked up.
    label = materialize(join_keyed(label, least, ["root"], "_sets", F.col("node")).select("node", "root", "n_links", "docs", F.coalesce("least", "doc_id").alias("component_id")), "labels")
    out = join_keyed(nodes.select("doc_id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")), label, ["node"], "docs", F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "node", "root")
    return out, seed


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that can be reached by links, itself included), n_links.

    Sets of `width`-word shingles are linked at a Jaccard similarity of num/den or more; links are exact up to 64-bit
    hashes of shingles. n_links is the number of other rows that a row is linked with. Null texts and texts without
    words have the empty set and are linked with nothing, not even each other. Repeated rows have the same set and are
    linked. Rows with a null key take part; a component of only such rows has a null id. Rows of one key with different
    texts are told apart by their sets. An empty table gives none. Other columns are not read. `how`: as of _linked.
    """
    return _linked(docs, **how)[0].drop("node", "root")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs with all their columns, but of each component only the row of the smallest doc_id.

    Of several rows of a component with that doc_id one stays; texts of one doc_id in different components all stay.
    Rows without a doc_id can't be told apart by it and all stay, and so do rows with the empty set.
    """
    found, seed = _linked(docs, **how)
    # Rows travel as one struct, so no name of theirs meets a name of this function.
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), docs["doc_id"].cast("long").alias("_key"))
    again = materialize(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_key")), "again")
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("_key")).distinct()
    gone = materialize(gone.unionByName(again).distinct(), "gone")
    out = rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "_key", "left_anti").select("_row")
    if again.limit(1).count():  # rows of a repeated doc_id are told apart by their sets
        width = how.get("width", 5)

        def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in text_blocks(batches, "_text"):
                values, bounds = shingle_sets(block.column(2), width)
                node = pa.array(identities(values, bounds, seed)[0].view(np.int64), mask=np.diff(bounds) == 0)
                yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), node], names=["_row", "_key", "_set"])

        same = rows.join(again, "_key", "left_semi").select("_row", "_key", F.col("_row.text").alias("_text"))
        sets = same.mapInArrow(tell, StructType([*same.schema.fields[:2], StructField("_set", LongType())]))
        kept = found.where("n_shingles > 0").select(F.col("doc_id").alias("_key"), F.col("node").alias("_set"), F.col("root").alias("_root"), F.col("component_id").alias("_least")).distinct()
        sets = sets.join(kept, ["_key", "_set"], "left").where("_root is null or _least = _key")
        first = F.row_number().over(Window.partitionBy("_key", "_root").orderBy(F.xxhash64("_row.text"), "_row.text"))
        sole = sets.where("_root is not null").withColumn("_nth", first).where("_nth = 1")
        out = out.unionByName(sole.select("_row")).unionByName(sets.where("_root is null").select("_row"))
    return out.select("_row.*")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
