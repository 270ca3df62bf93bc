from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, mark string, h string, spans string, ids string, fp string, least string"
WORDS = "the of and river stone light under walks seven garden quiet morning paper glass winter salt road early bright field".split()


def prose(rng: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        w = rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "ing"]) + str(rng.choice(["", "", rng.randint(0, 99)]))
        out.append(w + ("\n" if i % 17 == 16 else " "))
    return "".join(out).strip()


def rows(texts, ids=None):
    """Documents with columns whose names clash with those that operators use inside."""
    return [(i if ids is None else ids[i], t, "en", "src", None if t is None else len(t), 7, "x", "x", "x", "x", "x", None) for i, t in enumerate(texts)]


def odd_texts() -> list:
    """Null, empty, blank, short, very long, repeated, nearly repeated and unusual texts."""
    rng = random.Random(3)
    base = [prose(rng, 140) for _ in range(12)]
    near = base[0].replace("river", "lake", 1)
    shared = prose(rng, 90)
    return [
        *base,
        base[0],
        base[0],
        near,
        base[1] + " " + shared,
        shared + "\n" + base[2],
        "before " + shared + " after",
        None,
        None,
        "",
        "",
        " \n\t ",
        "word",
        "two words",
        "a" * 700,
        "ab " * 400,
        prose(rng, 6000),
        "\u00e9t\u00e9 \u65e5\u672c\u8a9e \U0001f600 \u2581 x\u0301 \x00 NBSP\u00a0here \x1c y",
        shared,
    ]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(rows(odd_texts()), SCHEMA)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def make(spark):
    return lambda texts, ids=None: spark.createDataFrame(rows(texts, ids), SCHEMA)
