"""Small tables with every odd case: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, bucket int, score double, slot long, label int"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def odd_docs(spark, more=()):
    rng = random.Random(5)
    long = "\n".join(words(rng, 40, 5000) for _ in range(800))
    rows = [(1, "Hello  World ▁ a\tb\r\n é 🔥 日本"), (2, None), (3, ""), (4, " \n\t "), (5, "x"), (6, long), (7, long), (8, long + " tail"), (9, "a b c d"), (9, "a b c d"), (10, "A B c D"), (None, "no id here at all"), (None, None), (-7, "negative id"), (11, "x" * 70000)]
    rows += list(more)
    tail = ("en", None, None, 7, 3, 0.5, 1, 1)
    return spark.createDataFrame([(i, t, tail[0], tail[1], None if t is None else len(t), *tail[3:]) for i, t in rows], DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)
