from __future__ import annotations

import random
import re

import pytest

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, row string, name string, size string, spans string"
WORD = re.compile(r"[^\x00-/:-@\[-`{-\x7f]+")


def words(t):
    return WORD.findall((t or "").lower())


def row(i, text, lang="en", source="s"):
    return (i, text, lang, source, None if text is None else len(text), "r", "n", "z", "s")


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{int(rng.paretovariate(0.6)) % vocabulary}" for _ in range(n))


@pytest.fixture(scope="session")
def table(spark):
    return lambda rows: spark.createDataFrame(rows, SHAPE)


@pytest.fixture(scope="session")
def odd(table):
    """Nulls, empties, ties, repeated rows, a very long text, odd characters, and columns with clashing names."""
    rng = random.Random(5)
    rows = [row(1, None), row(2, ""), row(3, " .,! "), row(None, "no id at all here"), row(4, "short"), row(5, "short"), row(5, "short"), row(6, "É" * 3 + " İstanbul K ﬀ"), row(7, prose(rng, 30_000)), row(8, "a b", None, None), row(9, "la " * 300)]
    return table(rows)


@pytest.fixture(scope="session")
def empty(table):
    return table([])
