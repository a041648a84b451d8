"""Texts, pages and conversations far longer than what is expanded at one time."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from conftest import row

from doclake.llm import budget, common, crf, cws, gam, jaccard, roles, rollup

N = 300_000


@pytest.fixture(scope="module")
def long(table):
    rng = random.Random(1)
    text = " ".join(rng.choices([f"w{k:07}" for k in range(20_000)], k=N))
    assert len(text) > 2 * common.MAX_BYTES
    return table([row(1, text), row(2, "short one"), row(3, text[: -9 * 20] + " w1 w2 w3"), row(4, None)])


def test_hashes_in_pieces(monkeypatch):
    """The same hashes in pieces of any size, also where one word is longer than a piece."""
    rng = random.Random(2)
    texts = pa.array([" ".join("ab" * rng.randrange(1, 40) for _ in range(50)), "x" * 500, "", "a b"])
    w = common.words(texts)
    want = [w.hashes().tolist(), w.hashes(other=True).tolist()]
    assert want[0] != want[1]
    monkeypatch.setattr(common, "MAX_BYTES", 64)
    assert [w.hashes().tolist(), w.hashes(other=True).tolist()] == want


def test_a_worker_keeps_short_tables():
    data = np.full(8 * common.MAX_BYTES, 97, np.uint8)
    data[::9] = 32
    w = common.words(pa.array([data.tobytes().decode()]))
    tracemalloc.start()
    assert len(w.hashes()) == len(w.starts)
    now, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(common._powers[0]) <= 2 * common.MAX_BYTES
    assert peak < 120e6


def test_language(long):
    model = crf.train([("a", "w1 one two three four five"), ("b", "uno dos tres cuatro cinco")])
    got = {r.doc_id: r.n_words for r in crf.identify(long, model).select("doc_id", "n_words").collect()}
    assert got == {1: N, 2: 2, 3: N - 17, 4: 0}


def test_quality_and_fingerprints(spark, long):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert gam.classify(long, labels).count() == 4
    s = {r.doc_id: (r.n_words, np.array(r.signature)) for r in cws.fingerprints(long).collect()}
    assert (s[1][0], s[2][0]) == (N, 2)
    assert (s[1][1] == s[3][1]).mean() > 0.9


def test_counts_and_mixing(long):
    assert {r.doc_id: r.n_tokens for r in rollup.pattern_tokens(long).where("tokenizer = 'words-1'").collect()} == {1: N, 2: 2, 3: N - 17, 4: 0}
    assert [(r.doc_id, r.n_tokens) for r in budget.fit(long, total=N).collect()] == [(1, N)]
    assert sorted(r.doc_id for r in budget.fit(long, total=N - 15).collect()) == [2, 3]


def test_similar_texts(long):
    (r,) = jaccard.join(long).collect()
    assert (r.doc_id_a, r.doc_id_b) == (1, 3)
    assert r.jaccard > 0.99


def test_conversation(spark):
    d = spark.createDataFrame([(1, k, "user" if k % 2 == 0 else "assistant", "x" * 300) for k in range(5000)], "conv_id long, turn long, role string, text string")
    (r,) = roles.format_chats(d).collect()
    assert (r.cost, r.n_turns, r.n_rendered) == (0, 5000, 5000)
