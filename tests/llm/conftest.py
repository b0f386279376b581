import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, rid long, h long, at long, n long, gi int, k int, node binary"


def frame(spark, rows):
    """documents of (doc_id, text, source) with further columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None, 7, 0.5, 7, 7, 7, 7, 7, 7, b"x") for i, t, s in rows], SCHEMA)


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(n))


EDGE = [
    (1, "one two  three", "a"),
    (2, "one two\nthree", "a"),
    (3, None, "a"),
    (4, "", None),
    (5, " \t", "b"),
    (6, "!!! ???", "b"),
    (7, "x", ""),
    (None, "no id here", "b"),
    (None, None, None),
    (9, words(3000, 1), "c"),
    (9, words(3000, 1), "c"),
    (10, "İstanbul ﬁ 日本語 é \U0001f600 <|endoftext|> it's DON'T", "c"),
    (11, "Ver " * 400, "a"),
]


@pytest.fixture(scope="session")
def edge(spark):
    return frame(spark, EDGE).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
