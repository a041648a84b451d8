"""Near duplicates, repeated substrings and benchmark passages against brute force."""

from __future__ import annotations

import math
import random
import tracemalloc
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import prose, row, words  # noqa: F401

from doclake.llm import jaccard, recompress, spaced


def grams(t, n):
    w = words(t)
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def edited(rng, t, rate):
    return " ".join(f"new{rng.random()}" if rng.random() < rate else w for w in t.split())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    rows, boiler = [], prose(rng, 25)
    for i in range(60):
        base = prose(rng, rng.choice([2, 3, 5, 8, 12, 30, 120, 400, 1500]))
        rows.append(base)
        rows += [edited(rng, base, rng.choice([0, 0.01, 0.03, 0.06, 0.1])) for _ in range(rng.randint(0, 4))]
        if i % 5 == 0:
            rows.append(boiler + " " + prose(rng, 40))
    rng.shuffle(rows)
    return [row(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("n", "t"), [(3, 0.6), (2, 0.7), (1, 0.5), (3, 0.9)])
def test_join_finds_all_pairs(table, corpus, n, t):
    sets = {r[0]: grams(r[1], n) for r in corpus}
    first = {}
    for i, s in sorted(sets.items()):
        first.setdefault(s, i)
    want = {(first[s], i, 1.0) for i, s in sets.items() if s and first[s] != i}
    reps = [(i, s) for s, i in first.items() if s]
    for i, a in reps:
        for j, b in reps:
            if i < j and (x := len(a & b) / len(a | b)) >= t:
                want.add((i, j, x))
    got = {tuple(r) for r in jaccard.join(table(corpus), n, t).collect()}
    assert len(want) > 20
    assert got == want


def test_default_is_word_pairs_at_0_7(table):
    base = [f"w{k}" for k in range(60)]
    near, far = list(base), list(base)
    for k in (10, 20, 30, 40, 50):
        near[k] = "x"  # 49 of 69 pairs of words are shared, 43 of 73 triples
    for k in (5, 15, 25, 35, 45, 55):
        far[k] = "y"
    d = [row(i, " ".join(t)) for i, t in enumerate([base, near, far])]
    assert {tuple(r) for r in jaccard.join(table(d)).collect()} == {(0, 1, 49 / 69)}
    assert sorted(r.doc_id for r in jaccard.keep_one(table(d)).collect()) == [0, 2]


def test_default_agrees_with_sql(table, corpus):
    documents = pa.table({"doc_id": [r[0] for r in corpus], "text": [r[1] for r in corpus]})  # noqa: F841
    want = {tuple(r) for r in duckdb.sql(jaccard.PAIRS_SQL).fetchall()}
    assert want == {tuple(r) for r in jaccard.join(table(corpus), 2, 0.7).collect()}
    assert want == {tuple(r) for r in jaccard.join(table(corpus)).collect()}


def linked(rows, t=0.7):
    """(doc_id, class_id, n_links) by comparing all documents, copies too."""
    sets = {r[0]: grams(r[1], 2) for r in rows}
    near = {i: {j for j, b in sets.items() if j != i and a and b and min(len(a), len(b)) >= t * max(len(a), len(b)) and len(a & b) / len(a | b) >= t} for i, a in sets.items()}
    group = {}
    for i in sorted(near):
        todo = [i] if i not in group else []
        while todo:
            x = todo.pop()
            if x not in group:
                group[x] = i
                todo += near[x]
    return {(i, group[i], len(near[i])) for i in near}


def test_links_count_copies_and_texts_that_differ(table, corpus, odd, empty):
    """Equal sets of texts that differ have their links to all others each, not the least id alone."""
    again = [row(1000 + r[0], r[1].upper() + "!") for r in corpus[::5]] + [row(3000, ""), row(3001, "lone"), row(3002, None)]
    rows = corpus + again
    got = [tuple(r) for r in jaccard.links(table(rows)).collect()]
    assert len(got) == len(rows)
    assert set(got) == linked(rows)
    assert sum(n for *_, n in got) > 2 * len(jaccard.join(table(rows)).collect())
    documents = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})  # noqa: F841
    assert set(duckdb.sql(jaccard.LINKS_SQL).fetchall()) == set(got)
    assert {tuple(r) for r in jaccard.links(odd).collect()} == {(i, 4 if i == 5 else i, int(i in (4, 5))) for i in range(1, 10)}
    assert jaccard.links(empty).count() == 0


def test_a_group_of_alike_texts_makes_few_rows(table):
    """Rows follow the documents, not the similar pairs: neither the result's nor those that are written on the way."""
    rng = random.Random(7)
    base = prose(rng, 150)
    rows = [row(i, edited(rng, base, 0.03)) for i in range(300)]
    work, _ = jaccard.meetings(table(rows), 2, 0.7)
    assert work.where("grams is null").count() < 150
    assert work.where("grams is not null").count() < 3 * len(rows)
    got = {tuple(r) for r in jaccard.links(table(rows)).collect()}
    assert got == linked(rows)
    assert sum(n for *_, n in got) > 50_000  # 27,000 pairs


def test_near_duplicates_connect_a_group_without_its_pairs(table):
    """The pipeline's stage gets a row or two for each set, whatever the number of pairs, and keeps one document."""
    rng = random.Random(8)
    base = prose(rng, 200)
    docs = table([row(i, edited(rng, base, 0.02)) for i in range(200)])
    work, _ = jaccard.meetings(docs, 2, 0.7)
    assert work.mapInArrow(lambda bs: jaccard.linked(bs, 0.7), "a long, b long, n long").count() < 3 * 200
    assert [r.doc_id for r in jaccard.keep_one(docs).collect()] == [0]


def entries(rng, lists, size):
    """Sorted list entries of alike and of chance sets, some of subset lists, with sizes about DIGESTED."""
    key = np.sort(rng.integers(0, lists, size)).astype(np.int64)
    grams = rng.integers(200, 330, size)
    o = np.lexsort((grams, key))
    key, grams = key[o], grams[o]
    kind = np.where(key % 5 == 4, 0, rng.integers(1, 3, size))
    meta = grams << 32 | rng.integers(0, 150, size) << 6 | (key % 4) << 2 | kind
    flipped = rng.random((size, 4, 64)) < rng.choice([0.02, 0.15, 0.5], (size, 1, 1))
    base = rng.random((1, 4, 64)) < 0.5
    return key, meta, np.packbits(base ^ flipped, 2).view(np.int64).reshape(size, 4)


@pytest.mark.parametrize("tile", [7, 128])
def test_long_lists_have_the_partners_of_short_ones(monkeypatch, tile):
    key, meta, digest = entries(np.random.default_rng(tile), 9, 1500)
    monkeypatch.setattr(jaccard, "TILE", tile)

    def found():
        out = [(i, j) for i, j in jaccard.partners(key, meta, digest, 0.7)]
        out += [(r + x, c + y) for r, c, ok in jaccard.tiles(key, meta, digest, 0.7) for x, y in [np.nonzero(ok)]]
        got = sorted(p for i, j in out for p in zip(i.tolist(), j.tolist(), strict=True))
        assert len(set(got)) == len(got)
        return got, sum(len(i) for i, _ in out)

    monkeypatch.setattr(jaccard, "LISTED", 10**12)
    want, _ = found()
    assert len(want) > 10_000
    for listed in (0, 12_000):
        monkeypatch.setattr(jaccard, "LISTED", listed)
        assert found()[0] == want

    pairs = lambda: {(a, b) for x in jaccard.unit_pairs(iter([batch]), 0.7) for a, b in zip(*(c.to_pylist() for c in x.columns), strict=True)}
    batch = pa.record_batch([pa.array(key), pa.array(np.arange(len(key)) % 211), pa.array(meta), *[pa.array(np.ascontiguousarray(digest[:, k])) for k in range(4)]], ["key", "unit", "meta", *jaccard.DIGEST])
    got = pairs()
    monkeypatch.setattr(jaccard, "MARKED", 5)
    assert pairs() == got
    monkeypatch.setattr(jaccard, "LISTED", 10**12)
    assert pairs() == got and len(got) > 1000


def test_a_long_list_is_scanned_without_listing_its_pairs():
    """8000 entries that share a gram by chance, 32 million pairs: none is listed by index, and memory stays that of a tile."""
    rng, n = np.random.default_rng(3), 8000
    key, meta = np.zeros(n, np.int64), np.full(n, 300 << 32 | 2)
    digest = rng.integers(-(2**63), 2**63 - 1, (n, 4))
    digest[n // 2] = digest[5]
    tracemalloc.start()
    assert not sum(len(i) for i, _ in jaccard.partners(key, meta, digest, 0.7))
    pairs = {(r + x, c + y) for r, c, ok in jaccard.tiles(key, meta, digest, 0.7) for x, y in np.argwhere(ok).tolist()}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (5, n // 2) in pairs and len(pairs) < n
    assert peak < 16_000_000


def test_alike_sets_are_connected_by_few_comparisons(monkeypatch):
    """Groups are those of all pairs, though a set is compared with a few of its group only."""
    rng, compared, overlaps = np.random.default_rng(5), [], jaccard.overlaps
    base = [rng.integers(0, 2**40, 300) for _ in range(3)]
    sets = [np.unique(np.where(rng.random(300) < 0.06, rng.integers(0, 2**40, 300), base[0 if k < 380 else 1 + k % 2])) for k in range(400)]
    sets += [np.concatenate([base[1][:250], base[2][250:]]), rng.integers(0, 2**40, 290)]
    sets = [np.unique(x) for x in sets]
    a, b, x = np.arange(150), np.arange(150, len(sets)), [frozenset(s.tolist()) for s in sets]
    monkeypatch.setattr(jaccard, "overlaps", lambda p, q: compared.append(len(p) * len(q)) or overlaps(p, q))

    def groups(blocks, alike):
        root = np.arange(len(sets))
        for p, q in blocks:
            edges = [(i, j) for i in p for j in q if alike(i, j)]
            root = jaccard.merged(root, *np.array(edges, np.int64).reshape(-1, 2).T)
        return root.tolist()

    blocks = [(a, a), (a, b), (b, b)]
    want = groups(blocks, lambda i, j: i < j and len(x[i] & x[j]) >= 0.7 * len(x[i] | x[j]))
    assert 3 <= len(set(want)) < 10
    root = np.arange(len(sets))

    def each(i, j, _):
        nonlocal root
        root = jaccard.merged(root, i, j)

    for p, q in blocks:
        jaccard.connect(sets, p, q, 0.7, each, lambda: root)
    assert root.tolist() == want
    assert sum(compared) < len(sets) ** 2 / 4


def test_near_duplicates_compare_few_sets(table):
    """The pipeline's stage keeps the same documents as by all links."""
    rng = random.Random(9)
    bases = [prose(rng, 150) for _ in range(3)]
    docs = table([row(i, edited(rng, bases[i % 40 % 3], rng.choice([0.01, 0.05, 0.12]))) for i in range(240)])
    want = {r.class_id for r in jaccard.links(docs).collect()}
    assert {r.doc_id for r in jaccard.keep_one(docs).collect()} == want
    work, _ = jaccard.meetings(docs, 2, 0.7)
    assert work.mapInArrow(lambda bs: jaccard.connected(bs, 0.7), "a long, b long").count() < 240


@pytest.mark.parametrize("vocabulary", [40, 400, 100_000])
def test_overlaps(vocabulary):
    rng = np.random.default_rng(vocabulary)
    a, b = ([np.unique(rng.integers(0, vocabulary, rng.integers(1, 120))) for _ in range(k)] for k in (70, 31))
    want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
    got = np.zeros((70, 31), int)
    for at, n in jaccard.overlaps(a, b):
        got[at : at + len(n)] = n
    assert (got == want).all()


def test_groups(table, corpus):
    pairs = [(r[0], r[1]) for r in jaccard.join(table(corpus)).collect()]
    parent = {r[0]: r[0] for r in corpus}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    kept = {r.doc_id for r in jaccard.keep_one(table(corpus)).collect()}
    assert kept == {i for i in parent if find(i) == i}


def test_join_odd_rows(odd, empty):
    assert {tuple(r) for r in jaccard.join(odd).collect()} == {(4, 5, 1.0)}
    assert sorted((r.doc_id or 0) for r in jaccard.keep_one(odd).collect()) == [0, 1, 2, 3, 4, 6, 7, 8, 9]
    assert jaccard.keep_one(odd).columns == odd.columns
    assert jaccard.join(empty).count() == 0
    assert jaccard.keep_one(empty).count() == 0


def test_repeated_row_without_partner(table):
    d = table([row(1, "one text of its own"), row(1, "one text of its own"), row(2, "another text that differs")])
    assert sorted(r.doc_id for r in jaccard.keep_one(d).collect()) == [1, 2]


@pytest.mark.parametrize(("size", "rate"), [(40, 0), (300, 2), (5000, 4)])
def test_rates_are_sound(size, rate):
    j = jaccard.rate_of(size, 0.6)
    assert j >= rate
    assert jaccard.need_of(j) <= 0.6 * size
    assert (1 - 2.0**-j) ** jaccard.need_of(j) <= jaccard.MISS or j == 0


@pytest.mark.parametrize("sizes", [(24, 24), (60, 70), (150, 150), (255, 255), (200, 280), (256, 256), (300, 350), (700, 700), (3000, 3500)])
def test_digests_keep_similar_pairs(sizes):
    """Pairs just at the threshold agree as their likeness says and never fail; pairs that share nothing do."""
    rng = np.random.default_rng(0)
    least = int(jaccard.least_equal(0.7)[jaccard.BINS])
    assert 80 < least < 92
    n, m = sizes
    both = int(np.ceil(0.7 * (n + m) / 1.7 - 1e-9))
    agree, other = [], []
    for _ in range(150):
        x = rng.integers(0, 2**63, n + m - both, dtype=np.uint64)
        s = jaccard.Sets.__new__(jaccard.Sets)
        s.key, s.size = np.concatenate([np.sort(x[:n]), np.sort(np.concatenate([x[:both], x[n:]])), rng.integers(0, 2**62, m, dtype=np.uint64)]), np.array([n, m, m])
        s.row, s.start = np.repeat(np.arange(3), s.size), np.array([0, n, n + m])
        e = jaccard.digests(s, 0.7).view(np.uint64)
        two = n < jaccard.DIGESTED <= m
        same = lambda j, e=e, two=two: 128 - int(np.bitwise_count(e[0, :2] ^ e[j, 2 * two : 2 * two + 2]).sum())
        agree.append(same(1))
        other.append(same(2))
    assert min(agree) >= least
    want = 0.5 + both / (n + m - both) / 2
    assert abs(np.mean(agree) / 128 - want) < 0.015
    assert np.std(agree) < 1.15 * math.sqrt(128 * want * (1 - want)) + 0.3
    assert np.mean(np.array(other) < least) > 0.99


# Repeated substrings


def spans(d, n=50):
    return [tuple(r) for r in recompress.repeats(d, n).collect()]


def covered(rows, n=50):
    """Words of every window of n words that occurs before, by brute force."""
    text = {r[0]: words(r[1]) for r in rows}
    where = defaultdict(list)
    for i in sorted(text):
        for k in range(len(text[i]) - n + 1):
            where[tuple(text[i][k : k + n])].append((i, k))
    return text, {(i, p) for v in where.values() for i, k in v[1:] for p in range(k, k + n)}


def test_repeats_cover_brute_force(table):
    rng = random.Random(3)
    passages = [prose(rng, n) for n in (50, 55, 60, 80, 200)]
    rows = []
    for i in range(80):
        parts = [prose(rng, rng.randint(5, 150))]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(passages), prose(rng, rng.randint(0, 40))]
        rows.append(row(i, " ".join(parts)))
    rows += [row(100, prose(rng, 10) + " la" * 200), row(101, "la " * 90), row(102, " ".join(["one two three four"] * 60))]
    rows += [row(103, "la " * 40 + "to " * 30), row(104, "x " + "la " * 30 + "to " * 45 + "y"), row(105, prose(rng, 900)), row(106, rows[7][1])]
    rows += [row(107, rows[-2][1] + " " + prose(rng, 30)), row(108, prose(rng, 20) + " " + " ".join(rows[-2][1].split()[200:700]))]
    text, need = covered(rows)
    have = set()
    for i, s, n, j, o in spans(table(rows)):
        assert n >= 50
        assert text[i][s : s + n] == text[j][o : o + n]
        assert (j, o) < (i, s)
        have |= {(i, p) for p in range(s, s + n)}
    assert have == need


@pytest.mark.parametrize(("p", "q"), [(45, 12), (49, 49), (30, 21)])
def test_other_places_of_an_anchor_hide_nothing(table, p, q):
    rng = random.Random(p)
    a, b = prose(rng, p), prose(rng, q)
    d = [row(k, f"{prose(rng, n)} x{k} {t} y{k} {prose(rng, 30)}") for k, n, t in ((1, 30, a), (2, 20, f"{a} {b}"), (3, 25, f"{a} {b}"))]
    assert spans(table(d)) == [(3, 26, p + q, 2, 21)]


def test_a_long_repeat_is_one_span(table):
    rng = random.Random(8)
    a = prose(rng, 6000)
    d = [row(1, f"{prose(rng, 30)} x {a}"), row(2, f"{a} y {prose(rng, 30)}"), row(3, f"{prose(rng, 5)} z {a} u {prose(rng, 5)}")]
    got = sorted(spans(table(d)))
    assert got[0] == (2, 0, 6000, 1, 31)
    assert {p for i, s, n, *_ in got if i == 3 for p in range(s, s + n)} == set(range(6, 6006))


def test_ids_with_several_texts(table):
    rng = random.Random(9)
    p, other = prose(rng, 80), prose(rng, 200)
    d = table([row(1, p), row(2, f"{prose(rng, 10)} {p}"), row(2, other), row(2, other), row(None, p)])
    assert [(i, s, n) for i, s, n, *_ in spans(d)] == [(2, 10, 80)]
    got = sorted(recompress.without_repeats(d).collect(), key=lambda r: (r.doc_id or 0, len(r.text or "")))
    assert [(r.doc_id, len(words(r.text))) for r in got] == [(None, 80), (1, 80), (2, 10), (2, 200), (2, 200)]


def test_very_long_text(table):
    """Over MAX_BYTES, so that it is a slice by itself and is hashed in pieces."""
    rng = random.Random(10)
    long = " ".join(rng.choices([f"w{k:06}" for k in range(9000)], k=300_000))
    d = [row(1, long), row(2, "start " + long[: 8 * 100_000 - 1]), row(3, None)]
    assert spans(table(d)) == [(2, 1, 100_000, 1, 0)]
    got = {r.doc_id: r.text for r in recompress.without_repeats(table(d)).collect()}
    assert got == {1: long, 2: "start ", 3: None}


def test_equal_substrings_have_equal_symbols():
    rng = np.random.default_rng(1)
    x = rng.integers(1, 2**63, 60, dtype=np.uint64)
    h = np.concatenate([rng.integers(1, 2**63, 33, dtype=np.uint64), x, rng.integers(1, 2**63, 20, dtype=np.uint64), x])
    name, row_, start, *_ = recompress.anchors(h, np.array([0, len(h)]), 50)
    a = {(s - 33, n) for s, n in zip(start, name, strict=True)} & {(s - 113, n) for s, n in zip(start, name, strict=True)}
    assert len(a) >= 2


def test_cutting(table):
    rng = random.Random(4)
    p = prose(rng, 70)
    d = table([row(1, f"Start one. {p}. End."), row(2, f"Begin, two: {p}! Éné."), row(3, p), row(4, "left alone")])
    got = {r.doc_id: r for r in recompress.without_repeats(d).collect()}
    assert got[1].text == f"Start one. {p}. End."
    assert got[2].text == "Begin, two: Éné."
    assert got[2].n_chars == len(got[2].text)
    assert 3 not in got
    assert got[4].text == "left alone"


def test_repeats_odd_rows(odd, empty):
    assert {s[0] for s in spans(odd)} == {9}
    out = recompress.without_repeats(odd)
    assert out.columns == odd.columns
    assert out.count() == odd.count()
    assert spans(empty) == []
    assert recompress.without_repeats(empty).count() == 0


# Benchmark passages

BENCH = "item_id long, text string, doc_id string"


def brute(docs, bench, least, least_item):
    out = set()
    for i, t in docs:
        w = np.array(words(t), object)
        for j, q in bench:
            v = np.array(words(q), object)
            if len(v) < least_item:
                continue
            for shift in range(-len(v) + 1, len(w)):
                lo, hi = max(0, -shift), min(len(v), len(w) - shift)
                _, _, m = spaced.best((w[lo + shift : hi + shift] == v[lo:hi]).astype(bool))
                if spaced.enough(m, len(v), least):
                    out.add((i, j))
    return out


@pytest.mark.parametrize(("sizes", "least_item"), [((3, 5, 8, 12, 15, 25, 40, 60), spaced.LEAST_ITEM), (tuple(range(1, 21)), 1)])
def test_decontamination(spark, table, sizes, least_item):
    rng = random.Random(6)
    items = [(k, " ".join(f"v{rng.randrange(500)}" for _ in range(n))) for k, n in enumerate(sizes)]
    docs = [(i, " ".join(f"v{rng.randrange(500)}" for _ in range(60))) for i in range(6)]
    for i in range(70):
        k = i % len(items)
        w = items[k][1].split()
        for _ in range(rng.choice([0, 1, 1, 1 + len(w) // 10, 1 + len(w) // 6]) if len(w) > 1 else 0):
            w[rng.randrange(len(w))] = "xx"
        lo = rng.choice([0, 0, rng.randrange(len(w))])
        docs.append((100 + i, " ".join([prose(rng, rng.randint(0, 20)), *w[lo:], prose(rng, rng.randint(0, 20))])))
    d, b = table([row(*x) for x in docs]), spark.createDataFrame([(*x, "c") for x in items], BENCH)
    got = {(r.doc_id, r.item_id) for r in spaced.hits(d, b, least_item=least_item).collect()}
    want = brute(docs, items, spaced.LEAST_MATCHES, least_item)
    assert len(want) > 20
    assert got == want
    kept = {r.doc_id for r in spaced.without_hits(d, b, least_item=least_item).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in got}


def test_masks_are_complete():
    """All patterns up to the twelfth match of a stretch, and those of items of 10 to 12 words: each holds a hit."""
    masks = [[k for k, c in enumerate(m) if c == "1"] for m in spaced.MASKS]
    todo, patterns = [((True,), 1, 1)], [(True,) * 9, (True,) * 10, (True,) * 11]
    while todo:
        p, score, matches = todo.pop()
        if matches == spaced.LEAST_MATCHES:
            patterns.append(p)
            continue
        todo.append(((*p, True), score + 1, matches + 1))
        if score > spaced.SUBSTITUTION:
            todo.append(((*p, False), score - spaced.SUBSTITUTION, matches))
    for n in (10, 11, 12):
        patterns += [(True,) * k + (False,) + (True,) * (n - 1 - k) for k in range(3, n - 2)]
    assert len(patterns) > 700
    for p in patterns:
        assert any(all(p[at + k] for k in m) for m in masks for at in range(len(p) - m[-1]))


@pytest.mark.parametrize("at", [0, 3, 9])
def test_ten_words_with_one_replaced(spark, table, at):
    rng = random.Random(at)
    item = [f"u{k}" for k in range(10)]
    w = [*item[:at], "xx", *item[at + 1 :]]
    b = spark.createDataFrame([(1, " ".join(item), "c")], BENCH)
    assert [(r.doc_id, r.n_matches) for r in spaced.hits(table([row(5, f"{prose(rng, 9)} {' '.join(w)} {prose(rng, 9)}")]), b).collect()] == [(5, 9)]


def test_one_word_repeated_takes_bounded_memory():
    x = spaced.build(np.array([1]), np.full(2000, 7, np.uint64), np.array([0, 2000]))
    tracemalloc.start()
    found = spaced.findings(np.full(20_000, 7, np.uint64), np.array([0, 20_000]), x, spaced.LEAST_MATCHES)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == {(0, 0): (2000, 0, 0, 2000)}
    assert peak < 300e6


def test_decontamination_of_a_very_long_text(spark, table):
    rng = random.Random(12)
    item = " ".join(f"u{k}" for k in range(40))
    long = " ".join(rng.choices([f"w{k:06}" for k in range(9000)], k=200_000))
    b = spark.createDataFrame([(1, item, "c")], BENCH)
    got = spaced.hits(table([row(1, f"{long} {item} {long}"), row(2, long)]), b).collect()
    assert [(r.doc_id, r.doc_word, r.n_matches) for r in got] == [(1, 200_000, 40)]


def test_slices_add_up(spark, table, monkeypatch):
    rng = random.Random(7)
    items = [(k, prose(rng, 20)) for k in range(6)]
    d = table([row(k, f"x {t} y") for k, t in items])
    monkeypatch.setattr(spaced, "SLICE_WORDS", 30)
    b = spark.createDataFrame([(*x, "c") for x in items], BENCH)
    assert {(r.doc_id, r.item_id) for r in spaced.hits(d, b).collect()} == {(k, k) for k in range(6)}
    assert spaced.without_hits(d, b).count() == 0


def test_decontamination_odd_rows(spark, odd, empty):
    b = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (None, "la la la la la la", "c"), (3, "la la la la la la", "c"), (3, "la la la la la la", "c")], BENCH)
    assert [(r.doc_id, r.item_id, r.n_matches) for r in spaced.hits(odd, b).collect()] == [(9, 3, 6)]
    assert spaced.hits(empty, b).count() == 0
    assert spaced.hits(odd, b.where("false")).count() == 0
    assert spaced.without_hits(odd, b).count() == odd.count() - 1
