import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key long, score double, set_id string, text_hash string"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2 + k % 7)) for k in (r.randrange(vocabulary) for _ in range(n)))


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text[, lang, source]) rows, with extra columns whose names clash with inner ones."""

    def make(rows):
        full = [(r[0], r[1], (r[2] if len(r) > 2 else "en"), (r[3] if len(r) > 3 else "s"), None, 7, 7, 0.5, "x", None) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def nasty(frame):
    """Nulls in every column, empty and very long texts, repeated rows, ties, odd characters."""
    long = prose(1, 30_000)
    rows = [
        (1, prose(2, 120)), (2, None), (3, ""), (4, "   \n\t "), (5, long), (None, prose(3, 90)), (None, None), (6, prose(2, 120)), (1, prose(2, 120)), (7, prose(4, 80), None, None),
        (8, "wörter mit ümlauten \U0001f600 und   trennern İ ſ K"), (9, "one"), (10, "ONE"), (11, "a b"), (12, "\x00\x01\x7f"), (13, "$" * 500), (14, "ab" * 700), (15, "12 34 !!"),
    ]
    return frame(rows), rows
