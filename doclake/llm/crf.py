"""Operator 1: word-level language identification by a linear-chain conditional random field.

A word's features are its byte n-grams of 2 to 4 (those that touch a word's edge are its affixes), hashed into ``FEATURES``
buckets, and its membership in each language's lexicon, the most frequent words of the training sample. Feature weights and the
transition matrix between labels are learned together by the conditional likelihood's gradient (forward-backward, Adagrad) on
code-switched sequences: stretches of documents in different languages put one after another. The training sample is bounded:
``SAMPLE_DOCS`` labelled documents, as many for each language and one at least, by least hash of the id; ``TRAIN_WORDS`` words. All
languages are learned, rare ones too. A label ``und`` is learned from made-up digits and
random letters.

Every word of every document is then labelled by its posterior (forward-backward over the whole text, in blocks that are chained
exactly). Result: ``doc_id, lang`` (label with the largest expected share), ``share, confidence`` (mean posterior of the chosen
labels), ``n_words, n_switches, spans`` (start, end, lang in words) and ``accepted``: false for texts without words, null or empty
(lang null), and where ``und`` has more than half or the confidence is under ``LEAST_CONFIDENCE``.

Ties go to the first label in alphabetical order, ``und`` last. A very long text is labelled whole, by blocks; it takes memory for each of its
words. Null ids are kept; rows that repeat are each labelled; without labelled rows every word is ``und`` and what has words is accepted,
as nothing can be learned; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MAX_BYTES, U, Words, col, mix, slices, words

FEATURES = 1 << 16
SAMPLE_DOCS, TRAIN_WORDS = 1000, 60_000
LEXICON = 1500
ROUNDS = 30
LEAST_CONFIDENCE = 0.5
BLOCK = 64
SHAPE = "doc_id long, lang string, share double, confidence double, n_words long, n_switches long, spans array<struct<start:int,end:int,lang:string>>, accepted boolean"


def reserved(langs: int) -> int:
    """First features, one for each language's lexicon; 64 at least."""
    return max(64, langs + 1)


def features(w: Words, at: np.ndarray, h: np.ndarray, lexicon: np.ndarray, member: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
    """Word (index in ``at``) and feature of each feature that holds. ``lexicon``: sorted hashes, one for each language that has the word;
    ``member``: that language; ``own``: features reserved for lexicons."""
    size = w.ends[at] - w.starts[at] + 2
    first = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(at)), size)
    inside = np.arange(len(owner)) - first[owner]
    src = np.repeat(w.starts[at] - 1, size) + inside
    text = np.where(inside == 0, 1, np.where(inside == size[owner] - 1, 2, w.data[np.clip(src, 0, max(len(w.data) - 1, 0))])).astype(np.uint64)
    who, what = [], []
    with np.errstate(over="ignore"):
        for n in (2, 3, 4):
            g = np.zeros(max(len(text) - n + 1, 0), np.uint64)
            for k in range(n):
                g = (g << U(8)) | text[k : k + len(g)]
            ok = inside[: len(g)] + n <= size[owner[: len(g)]]
            who.append(owner[: len(g)][ok])
            what.append((mix(g[ok] + U(n << 40)) >> U(48)).astype(np.int64) % (FEATURES - 64) + own)
    if len(lexicon):
        i = np.searchsorted(lexicon, h)
        times = np.searchsorted(lexicon, h, side="right") - i
        hit = np.repeat(np.arange(len(h)), times)
        who.append(hit)
        what.append(member[i[hit] + np.arange(len(hit)) - (np.cumsum(times) - times)[hit]] + 1)
    return np.concatenate(who), np.concatenate(what)


def emissions(who: np.ndarray, what: np.ndarray, n: int, weight: np.ndarray) -> np.ndarray:
    out = np.empty((n, weight.shape[1]))
    for k in range(weight.shape[1]):
        out[:, k] = np.bincount(who, weights=weight[:, k][what], minlength=n)
    return out


def posteriors(score: np.ndarray, of: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label marginals of every word, and expected transitions. Blocks are reduced to matrices, chained, then filled in."""
    n, L = score.shape
    if not n:
        return np.zeros((0, L)), np.zeros((L, L))
    e_all = np.exp(score - score.max(1, keepdims=True))
    T = np.exp(trans - trans.max())
    count = np.diff(of)
    blocks = -(-count // BLOCK)
    seq = np.repeat(np.arange(len(count)), blocks)
    base = np.cumsum(blocks) - blocks
    nth = np.arange(len(seq)) - base[seq]
    at = of[:-1][seq][:, None] + nth[:, None] * BLOCK + np.arange(BLOCK)
    valid = at < of[1:][seq][:, None]
    at = np.minimum(at, n - 1)
    B = len(seq)
    e = np.where(valid.T[:, :, None], e_all[at.T], 1.0)  # BLOCK x B x L
    P = np.broadcast_to(np.eye(L), (B, L, L)).copy()
    for j in range(BLOCK):
        Q = (P.reshape(-1, L) @ T).reshape(B, L, L) * e[j][:, None, :]
        Q /= Q.max((1, 2), keepdims=True)
        ok = valid[:, j]
        if ok.all():
            P = Q
        else:
            P[ok] = Q[ok]
    before, after = np.full((B, L), 1.0 / L), np.ones((B, L))
    order = np.argsort(nth, kind="stable")
    cut = np.searchsorted(nth[order], np.arange(nth.max() + 2))
    for k in range(1, len(cut) - 1):
        i = order[cut[k] : cut[k + 1]]
        v = np.einsum("bi,bij->bj", before[i - 1], P[i - 1])
        before[i] = v / v.sum(1, keepdims=True)
    for k in range(len(cut) - 2, 0, -1):
        i = order[cut[k] : cut[k + 1]]
        v = np.einsum("bij,bj->bi", P[i], after[i])
        after[i - 1] = v / v.sum(1, keepdims=True)
    alpha = np.empty((BLOCK, B, L))
    a = before
    prior = np.empty((BLOCK, B, L))
    for j in range(BLOCK):
        prior[j] = a
        nxt = (a @ T) * e[j]
        nxt /= nxt.sum(1, keepdims=True)
        a = np.where(valid[:, j][:, None], nxt, a)
        alpha[j] = a
    beta = after
    post = np.empty((BLOCK, B, L))
    pairs = np.zeros((L, L))
    for j in range(BLOCK - 1, -1, -1):
        ok = valid[:, j][:, None]
        m = alpha[j] * beta
        post[j] = m / m.sum(1, keepdims=True)
        right = e[j] * beta
        norm = np.einsum("bi,ij,bj->b", prior[j], T, right)
        inner = valid[:, j] & ((nth > 0) | (j > 0))
        pairs += T * ((prior[j] / norm[:, None])[inner].T @ right[inner])
        b = right @ T.T
        beta = np.where(ok, b / b.sum(1, keepdims=True), beta)
    out = np.empty((n, L))
    out[at[valid]] = post.transpose(1, 0, 2)[valid]
    return out, pairs


@dataclass
class Model:
    labels: list[str]
    weight: np.ndarray
    trans: np.ndarray
    lexicon: np.ndarray
    member: np.ndarray


def train(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """From (language, text) rows."""
    langs = sorted({r[0] for r in rows})
    labels = [*langs, "und"]
    if not langs:
        return Model(labels, np.zeros((FEATURES, 1)), np.zeros((1, 1)), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    rng = np.random.default_rng(seed)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz0123456789"))
    made = [" ".join("".join(rng.choice(letters[26:] if rng.random() < 0.4 else letters, rng.integers(1, 12))) for _ in range(300)) for _ in range(8)]
    at_lang = {a: k for k, a in enumerate(langs)}
    texts = [(at_lang[a], t) for a, t in rows] + [(len(langs), t) for t in made]
    w = words(pa.array([t for _, t in texts], pa.string()))
    h, kind = w.hashes(), np.array([k for k, _ in texts])
    of_label = kind[w.row()]

    top: list[tuple[int, int]] = []
    for k in range(len(langs)):
        u, c = np.unique(h[of_label == k], return_counts=True)
        for x in u[np.lexsort((u, -c))[:LEXICON]][: int((c > 1).sum())]:
            top.append((int(x), k))
    top.sort()
    lexicon = np.array([x for x, _ in top], np.uint64)
    member = np.array([k for _, k in top], np.int64)

    by = [[i for i in range(len(texts)) if kind[i] == k and w.of[i + 1] > w.of[i]] for k in range(len(labels))]
    live = [k for k in range(len(labels)) if by[k]]
    pieces, size = [], 0
    while size < TRAIN_WORDS:
        k = int(rng.choice(live)) if rng.random() > 0.05 else live[-1]
        i = by[k][int(rng.integers(len(by[k])))]
        n = int(rng.integers(4, 60))
        s = int(rng.integers(w.of[i], max(w.of[i] + 1, w.of[i + 1] - n)))
        pieces.append(np.arange(s, min(s + n, w.of[i + 1])))
        size += len(pieces[-1])
    idx = np.concatenate(pieces)
    of = np.unique(np.append(np.arange(0, len(idx), 200), len(idx)))
    gold = of_label[idx]
    code, uniq = pd.factorize(h[idx])
    first = np.zeros(len(uniq), np.int64)
    first[code[::-1]] = idx[::-1]
    L, own = len(labels), reserved(len(langs))
    size = FEATURES - 64 + own
    who, what = features(w, first, uniq, lexicon, member, own)
    weight, trans = np.zeros((size, L)), np.zeros((L, L))
    gw, gt = np.full((size, L), 1e-6), np.full((L, L), 1e-6)
    truth = np.eye(L)[gold]
    inner = np.ones(len(idx), bool)
    inner[of[:-1]] = False
    i = np.flatnonzero(inner)
    seen = np.zeros((L, L))
    np.add.at(seen, (gold[i - 1], gold[i]), 1)
    for _ in range(ROUNDS):
        post, pairs = posteriors(emissions(who, what, len(uniq), weight)[code], of, trans)
        d = truth - post
        dw = np.stack([np.bincount(what, weights=np.bincount(code, weights=d[:, k], minlength=len(uniq))[who], minlength=size) for k in range(L)], 1) - 0.05 * weight
        dt = seen - pairs - 0.05 * trans
        gw += dw * dw
        gt += dt * dt
        weight += 0.3 * dw / np.sqrt(gw)
        trans += 0.3 * dt / np.sqrt(gt)
    return Model(labels, weight, trans, lexicon, member)


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """On labelled documents of least hash, as many for each language (one at least, ``sample_docs`` over all languages); texts and languages that are not empty."""
    h = F.xxhash64(F.col("doc_id").cast("long"), F.lit(11))
    some = docs.where("lang is not null and cast(lang as string) not in ('', 'und')").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), h.alias("h"))
    some = some.where(F.length("text") > 0)
    langs = [r[0] for r in some.groupBy("lang").count().orderBy("lang").collect()]
    if not langs:
        return train([])
    each = max(1, sample_docs // len(langs))
    # numbers first: each task sends ``each`` of a language at most; then the texts
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    last = some.select("lang", "h").withColumn("rank", rank).where(F.col("rank") <= each).groupBy("lang").agg(F.max("h").alias("last"))
    last = {r.lang: r.last for r in last.collect()}
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in last.items() for x in kv]), F.col("lang"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))  # rows that share an id share a hash
    rows = some.where(F.col("h") <= limit).withColumn("rank", rank).where(F.col("rank") <= each).orderBy("h", "lang", "text").collect()
    return train([(r.lang, r.text) for r in rows])


def label(b: pa.RecordBatch, m: Model) -> tuple[Words, np.ndarray]:
    w = words(col(b, "text"))
    if not len(w.starts):
        return w, np.zeros((0, len(m.labels)))
    h = w.hashes()
    code, uniq = pd.factorize(h)
    first = np.zeros(len(uniq), np.int64)
    first[code[::-1]] = np.arange(len(h))[::-1]
    who, what = features(w, first, uniq, m.lexicon, m.member, reserved(len(m.labels) - 1))
    return w, posteriors(emissions(who, what, len(uniq), m.weight)[code], w.of, m.trans)[0]


def held(m: Model) -> int:
    """Bytes of text labelled at one time: fewer with many labels, as a block's matrix has a row and a column for each."""
    return MAX_BYTES * 60**2 // max(len(m.labels), 60) ** 2


def judge(b: pa.RecordBatch, m: Model) -> dict[str, np.ndarray]:
    w, post = label(b, m)
    n = np.diff(w.of)
    some = n > 0
    L = len(m.labels)
    best = post.argmax(1) if len(post) else np.zeros(0, np.int64)
    share, sure = np.zeros((w.rows, L)), np.zeros(w.rows)
    if len(post):
        at = w.of[:-1][some]
        share[some] = np.add.reduceat(post, at) / n[some][:, None]
        sure[some] = np.add.reduceat(post.max(1), at) / n[some]
    top = share.argmax(1)
    ok = some & (sure >= LEAST_CONFIDENCE) & ((share[:, -1] <= 0.5) | (L == 1))
    turn = np.ones(len(best), bool)
    turn[1:] = best[1:] != best[:-1]
    turn[w.of[:-1][some]] = True
    return {"words": n, "share": share, "sure": sure, "top": top, "ok": ok, "best": best, "turn": turn, "of": w.of}


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Labels of every document; see the module's docstring."""
    sent = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = pa.array(m.labels)
        for b in slices(batches, "text", held(m)):
            j = judge(b, m)
            some = j["words"] > 0
            start = np.flatnonzero(j["turn"])
            end = np.append(start[1:], len(j["turn"]))
            runs = np.searchsorted(start, j["of"])
            zero = np.repeat(j["of"][:-1], np.diff(runs))
            span = pa.StructArray.from_arrays([pa.array((start - zero).astype(np.int32)), pa.array((end - zero).astype(np.int32)), names.take(pa.array(j["best"][start]))], ["start", "end", "lang"])
            lang = names.take(pa.array(np.where(some, j["top"], 0), mask=~some))
            yield pa.record_batch(
                [col(b, "doc_id"), lang, pa.array(j["share"].max(1)), pa.array(j["sure"]), pa.array(j["words"]), pa.array(np.maximum(np.diff(runs) - 1, 0)), pa.ListArray.from_arrays(pa.array(runs.astype(np.int32)), span), pa.array(j["ok"])],
                ["doc_id", "lang", "share", "confidence", "n_words", "n_switches", "spans", "accepted"],
            )

    return docs.mapInArrow(run, SHAPE)


def accepted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents that ``identify`` accepts, unchanged."""
    sent, shape = docs.sparkSession.sparkContext.broadcast(model or fit(docs)), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", held(sent.value)):
            yield b.filter(pa.array(judge(b, sent.value)["ok"]))

    return docs.mapInArrow(run, shape)


__all__ = ["Model", "accepted", "fit", "identify", "posteriors", "train"]
