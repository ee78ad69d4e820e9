"""Small tables of odd rows for every operator."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, id string, n int, spans string, leaks string, score string, slot int, row string, doc long, lost string"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(n))


def documents(spark, extra: list[tuple] | None = None):
    rng = random.Random(5)
    base = words(rng, 120)
    long = words(rng, 8000)
    line = "This very Line stands in many documents\n"
    rows = [
        (1, base), (2, base), (3, base + " tail"), (4, None), (5, ""), (6, "   \n\t "), (7, long), (8, long + " end"), (9, "one two"), (10, "One  TWO"), (11, "é ü 日本語 🙂 \x00 x"),
        (12, line + words(rng, 30)), (13, "  " + line.upper() + words(rng, 30)), (14, words(rng, 30) + "\n" + line + line), (15, words(rng, 5) + "\n" + base + "\n" + words(rng, 5)), (None, base), (None, None), (16, words(rng, 40)), (16, words(rng, 40)), (17, base), (17, base), (-3, "negative id " + words(rng, 20)),
        *(extra or []),
    ]
    return spark.createDataFrame([(i, t, "x", 1, None, "l", "s", 2, "r", 3, None) for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df) -> list[tuple]:
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
