"""Documents with what operators must bear: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use inside.
EXTRA = "key long, n long, slot int, component long, rep long, e int, c string, base int, votes string"


def words(n: int, seed: int, size: int = 400) -> str:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(size)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


LONG = words(20_000, 1)
ROWS = [
    (1, words(80, 2), "en", "a", 1),
    (2, words(80, 2), "en", "a", 1),
    (3, words(80, 3), None, None, None),
    (4, None, "en", "a", None),
    (5, "", "de", "b", 0),
    (6, " \n\t ", "de", "b", 0),
    (7, LONG, "en", "a", 9),
    (8, LONG + " tail", "en", "a", 9),
    (9, "x" * 100_000, "en", "b", 9),
    (9, "x" * 100_000, "en", "b", 9),
    (10, "1" * 50_000 + " +" + "1-" * 20_000, "fr", "c", 9),
    (None, words(80, 2), "en", "a", 1),
    (None, words(60, 5), "en", "c", 1),
    (11, "tie", "en", "b", 3),
    (12, "tie", "en", "b", 3),
    (13, "emoji \U0001f600 é 中文 a.b@c.example.com +1 (555) 123-4567", "es", "c", 3),
]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def wide(spark, rows=ROWS):
    """docs with extra columns of clashing names."""
    n = len(EXTRA.split(","))
    return spark.createDataFrame([(*r, *([None] * n)) for r in rows], f"{SCHEMA}, {EXTRA}")
