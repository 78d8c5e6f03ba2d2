"""Secret scans: patterns of keys and assignments, and a guess-cost model for values in credential context.

A value that follows a credential word and a separator is cut into words, dates, repeats, walks and brute-force spans so
that the sum of their guess costs (log10 of guesses) is least; a value that is still dear is a secret, whatever
characters it has. Words come from a fixed list of passwords, from the whole words of two public vocabularies, whose ids
rank them, and from the running text of the corpus itself, but for words that are a credential's value somewhere.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from loam.llm.common import bounded_batches, drop_table, materialize, table, text_blocks, tokenizer_path

#: Kinds in their order; `guess` is the method's own.
KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CREDENTIAL = re.compile(
    r"""(?ai)(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth(?:orization)?|bearer|(?:api|access|private)[_-]?key)["']?[ \t]*+(?::=|=>|[:=])[ \t]*+["']?"""
    r"""(?:(?:basic|bearer|token|digest|negotiate|api-?key)[ \t]++)?["']?([^\s"'<>,;]+)"""
)
#: Characters of the longest credential word with its separator, or more.
_WORD_LENGTH = 16
#: What RE2 looks for before Python's patterns run: superset of all texts with a match.
_MAYBE_ASSIGN = r"(?i)(pass|pwd|secret|token|credential|auth|bearer|key)[a-z_-]*[\"']?[ \t]*[:=]"
_MAYBE_HEX = "[0-9a-f]{16}"

#: log10 of the guesses from which a value counts as a secret, and the least length of a value.
LEAST_COST, LEAST_LENGTH = 10.0, 8

# ---------------------------------------------------------------- words

#: Frequent passwords and words of passwords, the commonest first.
WORDS = """password qwerty admin welcome login letmein monkey dragon master iloveyou sunshine princess football baseball
shadow superman michael jordan secret hello charlie trustno whatever freedom hunter summer winter spring autumn
flower cookie pepper ginger banana orange cheese coffee computer internet samsung google apple default changeme test
guest root user pass word temp demo example sample public private access system server network database manager
service account online mobile office money love baby angel lucky happy star tiger lion eagle wolf bear horse correct
battery staple black white green blue yellow purple silver golden january february march april june july august
september october november december monday tuesday friday sunday the and you your this that from with none null true
false string value token key""".split()
#: Words that the corpus gives at most, how often one stands there at least, and letters of a word of either vocabulary.
CORPUS_WORDS, LEAST_COUNT, LETTERS = 20_000, 3, (4, 24)
#: What the last word of a list costs, those before it less by the logarithm of their ranks, and what a separator between
#: two letters costs: a value of four words or fewer counts as text, not as a secret, run together or not.
WORD_COST, SEPARATOR, SEPARATORS = 2.4, 0.1, "-_.+/,"
#: Words in running text, between two others: what stands behind a colon or an equals sign is no word of a vocabulary.
_GIVEN = r"""(?i)(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth(?:orization)?|bearer|key)["']?[ \t]*(?::=|=>|[:=])[ \t]*["']?([A-Za-z]+)"""
_RUNNING = rf"(?<=\p{{L}} )\p{{Ll}}{{{LETTERS[0]},{LETTERS[1]}}}(?= \p{{L}})"


def vocabulary(path: str) -> list[str]:
    """The words of a tokenizer file in the order of their ids, lower-cased: what begins with a space in a byte-level one,
    and what ends a word in one with word ends."""
    with open(path, encoding="utf-8") as f:
        ranks = json.load(f)["model"]["vocab"]
    ends = any(t.endswith("</w>") for t in ranks)
    bare = lambda t: (t[:-4] if t.endswith("</w>") else "") if ends else (t[1:] if t[:1] == "\u0120" else "")
    words = ((i, w.lower()) for t, i in ranks.items() if (w := bare(t)).isascii() and w.isalpha())
    return list(dict.fromkeys(w for _, w in sorted(words) if LETTERS[0] <= len(w) <= LETTERS[1]))


def corpus_words(docs: DataFrame, most: int = CORPUS_WORDS, least: int = LEAST_COUNT) -> list[str]:
    """The most frequent words of running text in all documents, the commonest first: at most `most`. A word that is the
    value of a credential in any text is none of them, however often it stands elsewhere.

    Counts are classed (eight classes for each doubling) and the classes counted; whole classes are taken from the top as
    long as they fit, so nothing but the words themselves comes to the driver.
    """
    every = docs.select(F.explode(F.regexp_extract_all("text", F.lit(_RUNNING), F.lit(0))).alias("word"))
    given = docs.where(F.col("text").rlike(_MAYBE_ASSIGN)).select(F.explode(F.regexp_extract_all("text", F.lit(_GIVEN), F.lit(1))).alias("word"))
    counts = every.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    counts = counts.join(given.select(F.lower("word").alias("word")).distinct(), "word", "left_anti")
    counts = materialize(counts.withColumn("class", F.floor(F.log2("n") * 8).cast("int")), "words")
    floor, left = None, most
    for r in sorted(counts.groupBy("class").count().collect(), key=lambda r: -r["class"]):  # eight rows a doubling
        if r["count"] > left:
            break
        floor, left = r["class"], left - r["count"]
    found = counts.where(F.col("class") >= floor).select("word", "n").collect() if floor is not None else []
    drop_table(counts)
    return [r["word"] for r in sorted(found, key=lambda r: (-r["n"], r["word"]))]


class Lexicon:
    """Costs of words: log10 of the rank in the list where it is cheapest; a long list's are scaled to end at WORD_COST."""

    def __init__(self, *lists: list[str]):
        self.costs: dict[str, float] = {}
        for words in lists:
            scale = min(1.0, WORD_COST / math.log10(len(words) + 1)) if words else 1.0
            for rank, w in enumerate(words, 1):
                cost = scale * math.log10(rank + 1)
                if cost < self.costs.get(w, math.inf):
                    self.costs[w] = cost
        self._finder = None

    def __getstate__(self) -> dict:
        return {"costs": self.costs, "_finder": None}  # the automaton is built where it is used

    def found(self, text: str) -> list[tuple[int, int, float]]:
        """end, begin, cost of every word that stands in a text, by end; one reading of the text."""
        if self._finder is None:
            self._finder = ahocorasick.Automaton()
            for w, cost in self.costs.items():
                self._finder.add_word(w, (len(w), cost))
            self._finder.make_automaton()
        return [(end + 1, end + 1 - n, cost) for end, (n, cost) in self._finder.iter(text)] if self.costs else []


#: Files of the two vocabularies.
VOCABULARIES = ("byte_bpe_50k.json", "word_bpe_49k.json")


#: Letters up to which a word has to stand in every vocabulary: short entries of one alone are mostly pieces of words.
SHORT = 4


@functools.lru_cache(4)
def _fixed(paths: tuple[str, ...]) -> list[list[str]]:
    found = list(map(vocabulary, paths or map(tokenizer_path, VOCABULARIES)))
    every = set.intersection(*map(set, found))
    return [WORDS, *([w for w in words if len(w) > SHORT or w in every] for words in found)]


@functools.lru_cache(4)
def common_words(*paths: str) -> Lexicon:
    """The lexicon of the fixed list and of tokenizers' vocabularies (VOCABULARIES if none is named)."""
    return Lexicon(*_fixed(paths))


def lexicon(docs: DataFrame, *paths: str) -> Lexicon:
    """The lexicon of the fixed list, the vocabularies, and the running text of all documents."""
    return Lexicon(*_fixed(paths), corpus_words(docs))


# ---------------------------------------------------------------- guess costs

#: Characters that are written for letters.
_LETTER = str.maketrans("@43105$7!", "aaeiossti")
#: Rows of a keyboard; a walk goes to a key beside, above or below, or up and down the alphabet.
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_PLACE = np.full((128, 2), -9.0)
for _r, _row in enumerate(ROWS):
    for _x, _c in enumerate(_row):
        _PLACE[ord(_c)] = _r, _x + 0.5 * (_r > 1) + 0.5 * (_r > 0)
_DATE = re.compile(r"(?=((?:19|20)\d\d([-/.]?)(?:0[1-9]|1[0-2])\2(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/.]?)(?:0[1-9]|1[0-2])\3(?:19|20)?\d\d|(?:19|20)\d\d))")
_SEPARATES = np.array([ord(c) for c in SEPARATORS])
#: Characters of the longest part that a repeat is made of.
LONGEST_PART = 16
#: Where a walk begins, a step that goes on as the one before or turns, a change of case, letters written over, the year alone and a whole date.
START, STRAIGHT, TURN, CASE, OVER, YEAR, DATE = 1.7, 0.1, 0.6, 0.3, 0.5, 2.1, 4.5


def _steps(code: np.ndarray) -> np.ndarray:
    """What a walk pays for going from each character to the next; inf where it can't."""
    out = np.full(max(len(code) - 1, 0), np.inf)
    if len(code) < 2:
        return out
    known = code < 128
    place = _PLACE[np.where(known, code, 0)]
    ok = known & (place[:, 0] >= 0)
    move = np.diff(place, axis=0)
    near = ok[1:] & ok[:-1] & (np.abs(move) <= 1).all(1) & (move != 0).any(1)
    up = np.diff(code)
    run = (np.abs(up) == 1) & ((code[1:] < 128) & (code[:-1] < 128))
    same = np.zeros(len(out), bool)
    same[1:] = (move[1:] == move[:-1]).all(1)
    out[near] = np.where(same[near], STRAIGHT, TURN)
    alike = np.zeros(len(out), bool)
    alike[1:] = up[1:] == up[:-1]
    out[run] = np.minimum(out[run], np.where(alike[run], STRAIGHT, TURN))
    return out


def _repeats(code: np.ndarray, before: np.ndarray) -> list[tuple[int, int, float]]:
    """end, begin, cost of repeats of parts of up to LONGEST_PART characters.

    A run of a period is as long as its characters equal those one period on; a repeat begins in the run's first period
    and takes as many whole parts as fit. So there are a few for each run, and all of them are found in linear time.
    """
    out = []
    for p in range(1, min(LONGEST_PART, len(code) // 2) + 1):
        same = np.concatenate(([False], code[p:] == code[:-p], [False]))
        edge = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            end = b + p  # the run holds a..end - 1
            for i in range(a, min(a + p, end - 2 * p + 1)):
                times = (end - i) // p
                if times * p >= 3:
                    out.append((i + times * p, i, float(before[i + p] - before[i]) + math.log10(times)))
    return out


def guess_cost(value: str, words: Lexicon | None = None) -> float:
    """log10 of the guesses that the cheapest segmentation takes; 0 for an empty value.

    best[j] = min over segments i..j of best[i] + cost: a word (its rank, more for capitals and for letters written
    over), a separator between letters, a date, a repeat (cost of the part, times how often), a walk of three keys or more (where it begins, and each
    step), or one character by brute force. Time and memory are linear in the value, whatever it holds.
    """
    n = len(value)
    if not n:
        return 0.0
    words = words or common_words()
    low = value.lower()
    if len(low) != n:
        low = "".join(c if len(d := c.lower()) != 1 else d for c in value)
    plain = low.translate(_LETTER)
    code, small, read = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for t in (value, low, plain))
    capital, written = (np.concatenate(([0], np.cumsum(x))).tolist() for x in (code != small, small != read))
    digit, letter = (code >= 48) & (code <= 57), (small >= 97) & (small <= 122)
    brute = np.where(digit, 1.0, np.where(letter, math.log10(26), np.where(code < 128, math.log10(33), 2.0)))
    if n > 2:  # between two letters
        brute[1:-1][np.isin(code[1:-1], _SEPARATES) & letter[:-2] & letter[2:]] = SEPARATOR
    step = _steps(small)
    turned = (code != small)[1:] != (code != small)[:-1]
    step = (step + CASE * turned).tolist()
    ends: dict[int, list[tuple[int, float]]] = {}
    for end, begin, cost in words.found(plain):
        cost += (CASE if capital[end] > capital[begin] else 0) + (OVER if written[end] > written[begin] else 0)
        ends.setdefault(end, []).append((begin, cost))
    for end, begin, cost in _repeats(code, np.concatenate(([0], np.cumsum(brute)))):
        ends.setdefault(end, []).append((begin, cost))
    if digit.any():
        for m in _DATE.finditer(value):
            ends.setdefault(m.end(1), []).append((m.start(1), YEAR if m.end(1) - m.start(1) == 4 else DATE))
    best, inf, brute = [0.0] * (n + 1), math.inf, brute.tolist()
    one = two = more = inf  # the cheapest walk of one, of two, and of more characters that ends here
    for j in range(1, n + 1):
        at = j - 1
        go = step[at - 1] if at else inf
        more = (two if two < more else more) + go
        two = one + go
        one = best[at] + START
        cost = best[at] + brute[at]
        if more < cost:
            cost = more
        if j in ends:
            for begin, c in ends[j]:
                if best[begin] + c < cost:
                    cost = best[begin] + c
        best[j] = cost
    return best[n]


Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str, assign: bool = True, hexes: bool = True) -> list[Span]:
    """Matches of the base patterns, leftmost and non-overlapping for each kind; a span is the whole match."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12] if assign else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if hexes:
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _merged(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Begins and ends of what sorted spans cover together."""
    begins, ends = [], []
    for s, _, e in spans:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            begins.append(s)
            ends.append(e)
    return begins, ends


def guess_spans(text: str, known: list[Span], words: Lexicon | None = None, least: float = LEAST_COST) -> list[Span]:
    """Whole values in credential context that are dear to guess and not covered by base spans.

    A value that ends in a credential word may have one behind it: the search goes on before that word. Values inside
    another are not scored by themselves, and a credential word in front of its own value is no value.
    """
    out, at, done = [], 0, 0
    begins, ends = _merged(known)
    while m := _CREDENTIAL.search(text, at):
        a, end = m.span(1)
        at = max(a, end - _WORD_LENGTH)
        if end <= done:
            continue
        done = end
        if end - a <= _WORD_LENGTH and (own := _CREDENTIAL.match(text, a)) and own.start(1) >= end:
            continue
        b = end - len(m[1]) + len(m[1].rstrip(".!?:)]}|"))
        k = bisect_right(begins, a) - 1
        covered = k >= 0 and ends[k] >= b
        if b - a >= LEAST_LENGTH and not covered and guess_cost(text[a:b], words) >= least:
            out.append((a, 3, b))
    return out


def _spans_of(block: pa.RecordBatch, words: Lexicon) -> Iterator[tuple[str, list[Span], list[Span]]]:
    texts = block.column("text")
    assign = pc.fill_null(pc.match_substring_regex(texts, _MAYBE_ASSIGN), False).to_pylist()
    hexes = pc.fill_null(pc.match_substring_regex(texts, _MAYBE_HEX), False).to_pylist()
    access = pc.fill_null(pc.match_substring(texts, "AKIA"), False).to_pylist()
    for i in range(len(texts)):
        if not (assign[i] or hexes[i] or access[i]):
            yield "", [], []
            continue
        text = texts[i].as_py()
        base = base_spans(text, assign[i], hexes[i])
        yield text, base, guess_spans(text, base, words) if assign[i] else []


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_EMPTY = hashlib.sha256(b"").hexdigest()


def scan(docs: DataFrame, words: Lexicon | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every whole text. words: else the lexicon of docs.

    Spans are kind:start:end in code points, end exclusive, by start and then kind, with a comma between; base_sha256
    is over the base kinds alone. A null text has no spans. Repeated rows each give a row, an empty table none; other
    columns are not read.
    """
    bounded_batches(docs.sparkSession)
    words = words or lexicon(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            rows = []
            for _, base, more in _spans_of(block, words):
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(_joined(base).encode()).hexdigest() if base else _EMPTY, _joined(sorted(base + more))))
            cols = [block.column("doc_id"), *(pa.array([r[k] for r in rows], pa.int64() if k < 3 else pa.string()) for k in range(5))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


#: What stands for a secret in a cleaned text.
MASK = "[secret]"


def redact(docs: DataFrame, mask: str = MASK, words: Lexicon | None = None) -> DataFrame:
    """The same rows and columns with every span of a secret replaced; overlapping spans become one.

    Where a text changes and there is a column n_chars, it is counted anew. Texts without spans, null ones too, stay as
    they are.
    """
    bounded_batches(docs.sparkSession)
    words = words or lexicon(docs)
    at, count = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            changed: dict[int, str] = {}
            for i, (text, base, more) in enumerate(_spans_of(block, words)):
                if spans := sorted(base + more):
                    parts, done = [], 0
                    for k, (a, _, b) in enumerate(spans):
                        if not k or a >= done:
                            parts += [text[done:a], mask]
                        done = max(done, b)
                    changed[i] = "".join(parts) + text[done:]
            if changed:
                columns = list(block.columns)
                texts = columns[at].to_pylist()
                for i, text in changed.items():
                    texts[i] = text
                columns[at] = pa.array(texts, columns[at].type)
                if count is not None:
                    sizes = columns[count].to_pylist()
                    for i, text in changed.items():
                        sizes[i] = len(text)
                    columns[count] = pa.array(sizes, columns[count].type)
                block = pa.RecordBatch.from_arrays(columns, schema=block.schema)
            yield block

    return docs.mapInArrow(run, docs.schema)


def op7_guess_cost_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
