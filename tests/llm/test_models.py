"""Learned models, fingerprints, mixing, rollups, chats and pages."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import prose, row, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from doclake.llm import budget, crf, cws, gam, roles, rollup, sst

# Language ID


def test_posteriors_equal_plain_forward_backward():
    rng = np.random.default_rng(0)
    L, sizes = 3, [0, 1, 5, 200, 64, 65, 128]
    of = np.concatenate([[0], np.cumsum(sizes)])
    score, trans = rng.normal(size=(of[-1], L)) * 3, rng.normal(size=(L, L))
    got, pairs = crf.posteriors(score, of, trans)
    want_pairs = np.zeros((L, L))
    for a, b in itertools.pairwise(of):
        if a == b:
            continue
        x = score[a:b]
        fwd, bwd = np.zeros_like(x), np.zeros_like(x)
        fwd[0] = x[0] + np.logaddexp.reduce(trans, 0)
        for t in range(1, b - a):
            fwd[t] = x[t] + np.logaddexp.reduce(fwd[t - 1][:, None] + trans, 0)
        for t in range(b - a - 2, -1, -1):
            bwd[t] = np.logaddexp.reduce(trans + (x[t + 1] + bwd[t + 1])[None, :], 1)
        z = np.logaddexp.reduce(fwd[-1])
        assert np.allclose(got[a:b], np.exp(fwd + bwd - z))
        for t in range(1, b - a):
            want_pairs += np.exp(fwd[t - 1][:, None] + trans + (x[t] + bwd[t])[None, :] - z)
    assert np.allclose(pairs, want_pairs)


def test_languages_held_out(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    model = crf.fit(d.where("doc_id % 2 = 0"))
    got = {r.doc_id: r.lang for r in crf.identify(d.where("doc_id % 2 = 1"), model).collect()}
    gold = {r.doc_id: r.lang for r in d.select("doc_id", "lang").collect()}
    assert np.mean([got[i] == gold[i] for i in got]) > 0.97


def test_code_switching(spark, sf, table):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    model = crf.fit(d.where("doc_id % 2 = 0"))
    texts = {r.lang: r.text for r in d.where("doc_id % 2 = 1 and n_chars between 600 and 2000").collect()}
    en, es = (" ".join(texts[k].split()[:40]) for k in ("en", "es"))
    r = crf.identify(table([row(1, f"{en} {es}")]), model).first()
    gold = ["en"] * len(words(en)) + ["es"] * len(words(es))
    got = [s.lang for s in r.spans for _ in range(s.end - s.start)]
    assert len(got) == len(gold)
    assert np.mean([a == b for a, b in zip(got, gold, strict=True)]) > 0.9


def test_more_than_60_languages(table, monkeypatch):
    monkeypatch.setattr(crf, "TRAIN_WORDS", 12_000)
    rng = random.Random(3)
    own = {f"l{k:02}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(30)] for k in range(70)}
    model = crf.train([(k, " ".join(rng.choices(v, k=200))) for k, v in own.items()])
    assert model.labels == [*own, "und"]
    got = {r.doc_id: (r.lang, r.accepted) for r in crf.identify(table([row(k, " ".join(rng.choices(own[f"l{k:02}"], k=40))) for k in range(70)]), model).collect()}
    assert got == {k: (f"l{k:02}", True) for k in range(70)}
    both = crf.train([("a", "one two one two"), ("b", "two three two three")])  # a word of two lexicons counts for both
    assert sorted(both.member) == [0, 0, 1, 1]
    assert len(set(both.lexicon.tolist())) == 3


def test_language_odd_rows(odd, empty):
    got = crf.identify(odd)
    rows = got.collect()
    assert len(rows) == odd.count()
    assert {r.doc_id for r in rows if not r.accepted} >= {1, 2, 3}
    assert all(r.lang is None and r.spans == [] for r in rows if r.doc_id in (1, 2, 3))
    assert crf.accepted(odd).columns == odd.columns
    assert crf.identify(empty).count() == 0
    nothing = crf.identify(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r.accepted for r in nothing.collect() if r.n_words} == {True}


# Quality


def test_quality_held_out(spark, sf):
    folder = sf.replace("sf0.001", "sf0.01")
    d, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = gam.fit(d, labels.where("doc_id % 3 <> 0"))
    rows = gam.score(d, model).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    assert np.mean([r.keep == (r.quality == 1) for r in rows]) > 0.95


def test_interaction_is_learned():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = gam.train(x, y)
    assert (0, 1) in m.pairs
    x2 = rng.random((1000, 4))
    assert np.mean((m.score(x2) > 0) == ((x2[:, 0] > 0.5) ^ (x2[:, 1] > 0.5))) > 0.93


def test_score_is_a_sum_of_table_entries():
    rng = np.random.default_rng(1)
    x = rng.random((500, 3))
    m = gam.train(x, (x[:, 0] + 0.2 * rng.random(500) > 0.6).astype(float))
    for r in x[:20]:
        s = m.base + sum(t[sum(v >= e for e in edge)] for v, edge, t in zip(r, m.edges, m.tables, strict=True))
        s += sum(g[sum(r[i] >= e for e in m.coarse[i]), sum(r[j] >= e for e in m.coarse[j])] for (i, j), g in zip(m.pairs, m.grids, strict=True))
        assert math.isclose(s, m.score(r[None])[0])


def test_features():
    b = pa.record_batch([pa.array(["Abc 12, x\nAbc 12, x\n", "", None])], ["text"])
    f = dict(zip(gam.NAMES, gam.features(b)[0], strict=True))
    assert (f["log_words"], f["distinct"], f["line_repeats"], f["top_word"]) == (np.log1p(6), 0.5, 0.5, 2 / 6)
    assert f["upper"] == 2 / 20
    assert not gam.features(b)[1:].any()


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, "x"), (4, 0, "x"), (4, 1, "x"), (7, 1, "x"), (None, 1, "x"), (9, None, "x"), (5, 7, "x")], "doc_id long, quality int, text string")
    assert gam.classify(odd, labels).count() == odd.count()
    assert gam.classify(empty, labels).count() == 0
    assert {(r.score, r.keep) for r in gam.classify(odd, labels.where("false")).collect()} == {(0.5, True)}


# Fingerprints


def test_collisions_estimate_generalised_jaccard():
    rng = np.random.default_rng(0)
    pool = rng.integers(1, 2**63, 300, dtype=np.uint64)
    for _ in range(4):
        a = rng.choice(pool[:200], 300)
        b = np.concatenate([rng.choice(a, 200), rng.choice(pool, 80)])
        wa, wb = ({int(k): 1 + math.log(n) for k, n in Counter(x.tolist()).items()} for x in (a, b))
        both = wa.keys() | wb.keys()
        want = sum(min(wa.get(k, 0), wb.get(k, 0)) for k in both) / sum(max(wa.get(k, 0), wb.get(k, 0)) for k in both)
        n = 1500
        x, y = (cws.signatures(np.zeros(len(v), np.int64), v, 1, n)[0] for v in (a, b))
        assert abs((x == y).mean() - want) < 4 * math.sqrt(want * (1 - want) / n)


def test_fingerprint_odd_rows(odd, empty, table):
    got = {r.doc_id: r.signature for r in cws.fingerprints(odd).collect()}
    assert got[1] == got[2] == got[3] == []
    assert got[4] == got[5]
    assert len(got[7]) == cws.SAMPLES
    assert cws.fingerprints(empty).count() == 0
    s = cws.fingerprints(table([row(1, "b a c"), row(2, "C, a. B"), row(3, "")]))
    pairs = s.alias("x").crossJoin(s.alias("y")).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"), cws.estimate(F.col("x.signature"), F.col("y.signature")).alias("e"))
    assert {(r.a, r.b): r.e for r in pairs.collect()}[1, 2] == 1.0
    assert {(r.a, r.b): r.e for r in pairs.collect()}[1, 3] is None


# Mixing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), min_size=1, max_size=5), st.integers(0, 150), st.sampled_from([1, 20, 1 << 15]))
def test_take_is_the_best_sum(counts, room, window):
    length, count = np.array(sorted(counts)), np.array([counts[k] for k in sorted(counts)])
    got = budget.take(length, count, room, window)
    assert ((got >= 0) & (got <= count)).all()
    sums = {sum(k * n for k, n in zip(length, c, strict=True)) for c in itertools.product(*[range(n + 1) for n in count])}
    assert (length * got).sum() == max(s for s in sums if s <= room)


def test_mixing(table):
    rng = random.Random(1)
    rows = [row(i, prose(rng, rng.randint(1, 60)), "en", f"s{min(i % 7, 2)}") for i in range(400)]
    n = Counter()
    for r in rows:
        n[r[3]] += len(r[1].split())
    d = table(rows)
    got = budget.fit(d, {"s0": 1.0, "s1": 1.0, "s2": 2.0}, 2000, keep=d.columns).collect()
    used = Counter()
    for r in got:
        used[r.source] += r.n_tokens
        assert r.n_tokens == len(r.text.split())
    assert used == {"s0": 500, "s1": 500, "s2": 1000}
    assert len({r.doc_id for r in got}) == len(got)
    again = {r.doc_id for r in budget.fit(d, {"s0": 1.0, "s1": 1.0, "s2": 2.0}, 2000).collect()}
    assert again == {r.doc_id for r in got}
    assert again != {r.doc_id for r in budget.fit(d, {"s0": 1.0, "s1": 1.0, "s2": 2.0}, 2000, seed=99).collect()}
    assert {r.source for r in budget.fit(d, {"s1": 1.0}, 100).collect()} == {"s1"}


def test_mixing_odd_rows(odd, empty):
    got = budget.fit(odd, total=10**9).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 3, 4, 5, 5, 6, 7, 8, 9]
    assert budget.fit(odd, {}, 100).count() == 0
    assert budget.fit(empty).count() == 0
    assert budget.fit(odd, keep=odd.columns).columns == [*odd.columns, "n_tokens"]
    own = odd.withColumn("n_tokens", F.lit("mine")).withColumn("n", F.lit(1))
    got = budget.fit(own, total=10**9, keep=own.columns).collect()
    assert {(r.n_tokens, r.n) for r in got} == {("mine", 1)}
    assert {r.doc_id: (r.source, r.n_tokens_) for r in got}[8] == (None, 2)


def test_mixing_takes_least_hashes(table, monkeypatch):
    """Against a plain ranking, with buckets of many, few and no rows, nulls, and rows repeated more often than they are taken."""
    rng = random.Random(4)
    rows = [row(i, " ".join(f"a{rng.randrange(9**9)}" for _ in range(rng.choice([1, 2, 2, 3]))), "en", rng.choice(["x", "y", None])) for i in range(300)]
    rows += [row(None, "q r", "en", "x") for _ in range(40)] + [row(7, "twice", "en", "y") for _ in range(30)]
    d = table(rows)
    for bits in (12, 2):
        monkeypatch.setattr(budget, "BUCKET_BITS", bits)
        for total in (150, 333, 0.3, 0.99):
            got = budget.fit(d, total=total, keep=["doc_id", "source", "text"]).collect()
            h = {(r.doc_id, r.text): r.h % 2**64 for r in d.select("doc_id", "text", F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(budget.SEED)).alias("h")).collect()}
            left = Counter((r[0], r[1], r[3]) for r in rows) - Counter((r.doc_id, r.text, r.source) for r in got)
            assert sum(left.values()) == len(rows) - len(got)
            most, least = {}, {}
            for r in got:
                k = (r.source or "", r.n_tokens)
                most[k] = max(most.get(k, 0), h[r.doc_id, r.text])
            for i, t, s in left:
                k = (s or "", len(t.split()))
                least[k] = min(least.get(k, 2**64), h[i, t])
            assert all(v <= least.get(k, 2**64) for k, v in most.items())
            whole = sum(len(r[1].split()) for r in rows)
            assert sum(r.n_tokens for r in got) <= (total if total > 1 else total * whole)


# Rollups


def test_rollup(spark, tmp_path):
    store = rollup.Rollup(spark, f"file://{tmp_path}/r")
    shape = "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long, doc_id long"
    delta = lambda *rows: spark.createDataFrame([(*r, 1) for r in rows], shape)
    totals = lambda: {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in store.totals().collect()}
    assert totals() == {}
    first = delta(("insert", "a", "en", "v1", 10, None), ("insert", "a", "en", "v1", 10, None), ("insert", None, None, "v1", None, None))
    assert store.commit("1", first)
    assert not store.commit("1", first)
    assert totals() == {("a", "en", "v1"): (2, 20), (None, None, "v1"): (1, 0)}
    assert store.commit("2", delta(("delete", "a", "en", "v1", 10, None), ("revise", "a", "en", "v1", 7, 10)))
    assert totals()["a", "en", "v1"] == (1, 7)
    store.compact()
    store.compact()
    assert totals()["a", "en", "v1"] == (1, 7)
    assert not store.commit("2", first)
    assert store.commit("3", delta(("delete", "a", "en", "v1", 7, None), ("delete", None, None, "v1", None, None)))
    assert totals() == {}
    assert store.commit("4", delta())
    store.compact()
    store.vacuum()
    assert totals() == {}
    assert not store.commit("1", first)
    with pytest.raises(ValueError, match="no insert"):
        store.commit("5", delta(("upsert", "a", "en", "v1", 1, None)))


def test_compaction_sums_what_it_listed(spark, tmp_path):
    shape = "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long"
    one = lambda n: spark.createDataFrame([("insert", "a", "en", "v1", n, None)], shape)
    other = rollup.Rollup(spark, f"file://{tmp_path}/r")

    class Late(rollup.Rollup):
        def _sum(self, paths):
            other.commit("late", one(100))  # between listing and summing
            return super()._sum(paths)

    store = Late(spark, f"file://{tmp_path}/r")
    other.commit("1", one(10))
    other.commit("2", one(20))
    store.compact()
    assert [(r.n_docs, r.n_tokens) for r in other.totals().collect()] == [(3, 130)]
    assert not other.commit("late", one(100))


def test_a_smaller_snapshot_that_comes_late_is_not_read(spark, tmp_path):
    shape = "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long"
    one = lambda n: spark.createDataFrame([("insert", "a", "en", "v1", n, None)], shape)
    store, slow = rollup.Rollup(spark, f"file://{tmp_path}/r"), rollup.Rollup(spark, f"file://{tmp_path}/r")
    store.commit("1", one(10))
    store.commit("2", one(20))
    listed = slow._parts()
    slow._parts = lambda: listed
    store.commit("3", one(1000))
    store.compact()
    slow.compact()
    assert [(r.n_docs, r.n_tokens) for r in store.totals().collect()] == [(3, 1030)]
    store.vacuum()
    assert [(r.n_docs, r.n_tokens) for r in store.totals().collect()] == [(3, 1030)]


def test_broken_batch_is_written_anew(spark, tmp_path):
    store = rollup.Rollup(spark, f"file://{tmp_path}/r")
    d = spark.createDataFrame([("insert", "a", "en", "v1", 3, None)], "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long")
    store.commit("x", d)
    (tmp_path / "r" / store._folder("x").rpartition("/")[2] / "_SUCCESS").unlink()
    assert store.totals().count() == 0
    assert store.commit("x", d)
    assert [r.n_tokens for r in store.totals().collect()] == [3]


def test_public_vocabulary(odd):
    P = pytest.importorskip("public_tokenizers")
    got = {r.doc_id: r.n_tokens for r in rollup.bpe_tokens(odd, P.path("byte_bpe_50k.tiktoken"), "bpe-50k").collect()}
    assert (got[1], got[2]) == (0, 0)
    assert got[9] >= 300
    counts = {(r.doc_id, r.tokenizer): r.n_tokens for r in rollup.pattern_tokens(odd).collect()}
    assert (counts[9, "words-1"], counts[8, "pieces-1"], counts[1, "words-1"]) == (300, 2, 0)


# Chats


def cheapest(given):
    """Least cost by search over all states, Dijkstra's way."""
    import heapq

    todo, done = [(0, 0, "")], set()
    while todo:
        c, k, s = heapq.heappop(todo)
        if (k, s) in done:
            continue
        done.add((k, s))
        if k == len(given) and s in roles.END:
            return c
        for r in roles.NEXT[s]:
            heapq.heappush(todo, (c + roles.INSERT, k, r))
            if k < len(given):
                heapq.heappush(todo, (c + roles._cost(given[k], r), k + 1, r))
        if s and k < len(given):
            heapq.heappush(todo, (c + roles.MERGE + roles._cost(given[k], s), k + 1, s))
    return None


@pytest.mark.parametrize("n", range(1, 6))
def test_repair_is_cheapest(n):
    for given_roles in itertools.product(["user", "assistant", "system", "bot"], repeat=n):
        cost, steps = roles.repair(given_roles)
        assert cost == cheapest(given_roles)
        assert sum(x != "i" for x, _ in steps) == n
        turns = [r for x, r in steps if x != "m"]
        assert turns[-1] == "assistant"
        assert all(b in roles.NEXT[a] for a, b in itertools.pairwise(["", *turns]))


def test_rendering():
    body, cost, n, ops = roles.render([("user", "hi"), ("user", "<|x|>")])
    assert (body, cost, n, ops) == ("<|user|>\nhi\n<\\|x|><|end|>\n<|assistant|>\n<|end|>\n", 3, 2, "kmi")


def test_chats_odd_rows(spark):
    shape = "conv_id long, turn long, role string, text string, turns string"
    d = spark.createDataFrame([(1, 1, "assistant", "b", ""), (1, 0, " User", "a", ""), (2, None, None, None, ""), (None, 0, "user", "x", ""), (3, 0, "user", "a", ""), (3, 0, "user", "a", "")], shape)
    got = {r.conv_id: r for r in roles.format_chats(d).collect()}
    assert (got[1].cost, got[1].ops) == (0, "kk")
    assert (got[2].cost, got[2].n_rendered) == (4, 2)
    assert (got[3].ops, got[None].ops) == ("kmi", "ki")
    assert roles.format_chats(d.where("false")).count() == 0


# Pages


def page(i, body, host="h.example"):
    return (i, f"https://{host}/p{i}" if host else None, body, "h", "s")


PAGES = "page_id long, url string, html string, host string, site string"


def test_site_style_tree(spark):
    html = lambda k: f"<html><head><title>t</title></head><body><div class=nav><a href=/>Home</a> <a href=/x>About us</a></div><p>Story number {k} about things &amp; more</p><footer>All rights reserved</footer></body></html>"
    d = spark.createDataFrame([page(k, html(k)) for k in range(12)] + [page(90, html(90), "other.example"), page(91, None), page(92, ""), page(93, html(93), None)], PAGES)
    got = {r.page_id: r for r in sst.extract(d).collect()}
    assert got[3].text == "Story number 3 about things & more"
    assert got[90].text.splitlines() == ["Home About us", "Story number 90 about things & more", "All rights reserved"]
    assert got[93].host is None
    assert got[93].n_removed == 0
    assert (got[91].text, got[92].text) == ("", "")
    assert sst.extract(d.where("false")).count() == 0


def test_rotating_boilerplate(spark):
    story = lambda k: f"Story number {k} about things"
    html = lambda k, j: f"<body><nav><ul><li><a href=/>To {j}</a></li><li><a href=/x>About {j % 3}</a></li></ul></nav><div class=ad>Buy {j} now</div><article><h1>{story(k)}</h1>{'<p>More</p>' * (k % 4)}</article><footer>Company {j}</footer></body>"
    few = [page(k, html(k, k % 25), "few.example") for k in range(30)]  # 5 of 25 blocks are met twice
    many = [page(1000 + k, html(k, k % 60), "many.example") for k in range(320)]
    copies = [page(2000 + k, html(k // 2 if k < 40 else k, k % 60), "copies.example") for k in range(320)]  # 20 stories have a copy
    never = [page(3000 + k, html(k, k), "never.example") for k in range(40)]
    twice = [page(4000 + k, html(k // 2, k // 2), "twice.example") for k in range(40)]  # whole pages recur, no branch more than another
    got = {r.page_id: r.text for r in sst.extract(spark.createDataFrame(few + many + copies + never + twice, PAGES)).collect()}
    for pages in (few, many, copies):
        assert all("Story" in got[p[0]] and not any(x in got[p[0]] for x in ("To ", "About", "Buy", "Company")) for p in pages)
    for pages in (never, twice):
        assert all(all(x in got[p[0]] for x in ("Buy", "Company", "To ")) for p in pages)


class Brute:
    """The docstring's tree of one host, built of the pages' own nodes, without keys or counts by them."""

    def __init__(self, pages):
        self.gone = set()  # ids of page nodes to leave out
        self.pages = len(pages)
        roots = [sst.parse(h) for h in pages]
        self.root = self.element(roots)
        self.drop_quiet(self.root)
        self.drop_recurring(self.root)
        self.texts = [self.text(r) for r in roots]

    def content(self, x):
        return x.text if not x.tag or x.tag == "img" else (x.label, tuple(self.content(c) if c.tag and c.tag != "img" else (c.label, c.text) for c in x.children))

    def element(self, met):
        m, leaf = len(met), not met[0].tag or met[0].tag == "img"
        e = {"met": met, "m": m, "leaf": leaf, "styles": []}
        kinds = Counter(self.content(x) for x in met)
        e["repeat"] = sum(math.log(n) for n in kinds.values()) / math.log(m) / len(kinds) if m > 1 else 0.0
        e["again"] = sum(n for n in kinds.values() if n > 1) / m
        if leaf:
            e["value"] = 1 - e["repeat"]
            e["quiet"] = m > 1 and e["value"] < sst.THRESHOLD
            return e
        groups = {}
        for x in met:
            groups.setdefault(tuple(c.label for c in x.children), []).append(x)
        for g in groups.values():
            e["styles"].append([self.element([x.children[k] for x in g]) for k in range(len(g[0].children))])
        sizes = [len(g) for g in groups.values()]
        if m == 1:
            e["value"], e["quiet"] = 1.0, False
            return e
        own = -sum(n / m * math.log(n / m) / math.log(m) for n in sizes)
        inner = sum(n / m * (1.0 if n == 1 else sum(c["value"] for c in s) / len(s) if s else 0.0) for n, s in zip(sizes, e["styles"], strict=True))
        damp = sst.DAMPING ** len(sizes)
        e["value"] = (1 - damp) * own + damp * inner
        e["quiet"] = 1 not in sizes and e["value"] < sst.THRESHOLD and all(c["quiet"] for s in e["styles"] for c in s)
        return e

    def drop(self, e):
        self.gone |= {id(x) for x in e["met"]}

    def drop_quiet(self, e):
        if e["quiet"]:
            self.drop(e)
            return
        for s in e["styles"]:
            for c in s:
                self.drop_quiet(c)

    def drop_recurring(self, e):
        sizes = [sum(1 for x in e["met"] if tuple(c.label for c in x.children) == tuple(c["met"][0].label for c in s)) for s in e["styles"]]
        for n, s in zip(sizes, e["styles"], strict=True):
            if 2 * n < self.pages or n < 2:
                continue
            floor = max(math.log(2) / math.log(n) / max(n - 1, 1), e["repeat"])
            some = [(max(c["repeat"], floor), c) for c in s if 1 - c["repeat"] >= sst.THRESHOLD]
            order = [floor, *sorted(r for r, _ in some)]
            wide, limit = max(((b / a, b) for a, b in itertools.pairwise(order)), default=(0.0, 0.0))
            for r, c in some:
                if wide >= sst.GAP and r >= limit and c["again"] >= sst.SHARE:
                    self.drop(c)
                else:
                    self.drop_recurring(c)

    def text(self, root):
        lines = [[]]

        def go(x):
            if id(x) in self.gone:
                return
            if not x.tag:
                lines[-1].append(x.text)
                return
            if x.tag not in sst.INLINE:
                lines.append([])
            for c in x.children:
                go(c)
            if x.tag not in sst.INLINE:
                lines.append([])

        go(root)
        return "\n".join(t for t in (" ".join(line) for line in lines) if t)


@pytest.mark.parametrize("seed", range(3))
def test_pages_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    hosts = {}
    for h in range(14):
        m, bundles = rng.choice([1, 2, 5, 12, 30]), rng.choice([1, 3, 25])
        layouts = [rng.sample(["nav", "ad", "side", "body", "foot"], rng.randint(2, 5)) for _ in range(rng.choice([1, 1, 2, 4]))]
        pages = []
        for _ in range(m):
            b, out = rng.randrange(bundles), []
            for part in rng.choice(layouts):
                if part == "body":
                    out.append("<article data-id=%d id=post-%d><h1>t%d</h1>%s</article>" % (rng.randrange(999), rng.randrange(999), rng.randrange(40), "".join(f"<p>{rng.choice(['same', 'x' + str(rng.randrange(300))])}</p>" for _ in range(rng.randint(0, 3)))))
                elif part == "side":
                    out.append(f"<div class=side><img src=i{rng.randrange(3)}.png><span>s{rng.choice([0, rng.randrange(50)])}</span></div>")
                else:
                    out.append(f"<div class={part}><a>{part} {b}</a> <b>{'all' if rng.random() < 0.9 else rng.random()}</b></div>")
            pages.append("".join(out))
        hosts[f"h{h}.example"] = pages
    rows = [page(1000 * h + k, p, host) for h, (host, pages) in enumerate(hosts.items()) for k, p in enumerate(pages)]
    got = sst.extract(spark.createDataFrame(rows, PAGES)).collect()
    want = {1000 * h + k: t for h, pages in enumerate(hosts.values()) for k, t in enumerate(Brute(pages).texts)}
    assert {r.page_id: r.text for r in got} == want
    assert 20 < sum(r.n_removed > 0 for r in got) < len(got)


def test_unique_attributes_hide_no_navigation(spark):
    html = lambda k: f"<body><div data-id={k} data-src=x{k} id=row-{k} class='menu item-{k}'><a href=/>Home</a></div><p title='class=c{k}'>Story {k} of its own</p></body>"
    got = sst.extract(spark.createDataFrame([page(k, html(k)) for k in range(12)], PAGES)).collect()
    assert {r.text for r in got} == {f"Story {k} of its own" for k in range(12)}


def test_a_very_long_page(spark):
    long = "<body><nav>Menu</nav>" + "<p>a few words</p>" * 100_000 + "</body>"
    got = {r.page_id: r for r in sst.extract(spark.createDataFrame([page(1, long), page(2, "<body><nav>Menu</nav><p>x</p></body>")], PAGES)).collect()}
    assert got[1].n_nodes == 3 + 200_000
    assert len(got[1].text) >= 100_000 * 12


def test_importance_by_hand():
    # root with one style for 4 pages: a leaf equal on all, one different on all; and a lone style of a fifth page
    nodes = {1: (0, 0, False, [(10, 4)], 5, 2.0), 2: (10, 1, True, [(77, 4)], 4, 1.0), 3: (10, 1, True, [], 4, 4.0)}
    assert sst.noise(nodes, 0.2) == [2]
    half = {1: (0, 0, False, [(10, 4)], 4, 1.0), 2: (10, 1, True, [(7, 2), (8, 2)], 4, 2.0)}
    assert sst.noise(half, 0.51) == [1]
    assert sst.noise(half, 0.4) == []


@pytest.mark.parametrize(
    ("source", "tags"),
    [("<p>a<p>b", ["p", "", "p", ""]), ("<ul><li>a<li>b</ul>c", ["ul", "li", "", "li", "", ""]), ("a < b <!-- x", ["", "", ""]), ("<b>a</i></b><br>c", ["b", "", "br", ""]), ('<a title=">">x</a>', ["a", ""]), ("<script>x</scr", []), ("<script>if(a<b)</script>y", [""])],
)
def test_parser(source, tags):
    assert [x.tag for x, _, _ in sst.keyed(sst.parse(source), "h")][1:] == tags
