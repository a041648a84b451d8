"""Operator 3: quality classifier, a generalised additive model with pairwise interactions.

Numeric features of a text (``NAMES``) are cut into quantile bins of the training sample. Boosting goes round the features again and
again; each step fits a tree of at most three leaves on one feature to the logistic gradient and adds it to that feature's lookup
table. The feature pairs whose coarse grids explain most of what is left then get tables of their own, boosted the same way with
one cut along each feature. A score is the intercept plus one entry of each table: bins are found and entries added for whole
columns at a time.

Trained on at most ``SAMPLE`` labelled rows of least hash (a bound, not a share), a fifth of them held out to stop the boosting;
applied to every document. Result: ``doc_id, logit, score, keep`` (score >= 0.5). Null labels and labels other than 0 and 1
aren't used, of several labels of an id the least is; without both labels every score is 0.5 and all is kept. Null and
empty texts are scored by their features (0 words), very long ones by all their words; ties: the first feature, cut or pair counts; null ids and repeated rows are kept; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, Words, buffers, by_row, col, mix, slices, words

NAMES = (
    "log_words", "word_length", "upper", "digits", "symbols", "stops", "commas", "not_ascii", "spaces", "line_words", "line_repeats",
    "distinct", "top_word", "short_words", "pair_repeats", "long_words",
)
SAMPLE = 4000
BINS, COARSE, PAIRS = 32, 8, 6
ROUNDS, RATE, PATIENCE = 300, 0.08, 30

_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[ord(c) for c in "#$%&*@|<>{}[]^~_=+\\/`"]] = 3
_KIND[[ord(c) for c in ".!?"]] = 4
_KIND[[ord(c) for c in ",;:"]] = 5
_KIND[128:] = 6
_KIND[[32, 9, 10, 13]] = 7


def _per_row(value: np.ndarray, of: np.ndarray) -> np.ndarray:
    s = np.concatenate([[0], np.cumsum(value)])
    return s[of[1:]] - s[of[:-1]]


def _repeats(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries, different entries and count of the commonest, by row."""
    n = np.bincount(row, minlength=rows)
    if not len(row):
        return n, n, n
    o = by_row(row, h)
    r, x = row[o], h[o]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (x[1:] != x[:-1])
    at = np.flatnonzero(new)
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, r[at], np.diff(np.append(at, len(r))))
    return n, np.bincount(r[at], minlength=rows), top


def features(b: pa.RecordBatch) -> np.ndarray:
    text = pc.fill_null(col(b, "text"), "")
    off, data = buffers(text)
    rows = b.num_rows
    w = words(text)
    h, row = w.hashes(), w.row()
    kind = _KIND[data]
    size = np.maximum(np.diff(off), 1)
    share = [_per_row(kind == k, off) / size for k in range(1, 8)]
    n, different, top = _repeats(row, h, rows)
    n1 = np.maximum(n, 1)
    length = w.ends - w.starts
    with np.errstate(over="ignore"):
        two = mix(h[:-1] * U(3) + h[1:]) if len(h) > 1 else h[:0]
        inner = row[:-1] == row[1:] if len(h) > 1 else np.zeros(0, bool)
        pairs, pairs_different, _ = _repeats(row[:-1][inner], two[inner], rows) if len(h) > 1 else (n * 0, n * 0, n * 0)
        # lines: pieces between line feeds, named by the sum of their bytes' hashes
        cut = np.flatnonzero(data == 10)
        start = np.unique(np.concatenate([off[:-1][off[:-1] < len(data)], cut[cut + 1 < len(data)] + 1])).astype(np.int64)
        end = np.append(start[1:], len(data)) if len(start) else start
        body = end - (data[np.maximum(end - 1, 0)] == 10) if len(start) else end
        full = body > start
        start, body = start[full], body[full]
        line = Words(data, start, body, np.zeros(1, np.int64), 0).hashes()
    line_row = np.searchsorted(off, start, "right") - 1
    lines, lines_different, _ = _repeats(line_row, line, rows)
    l1 = np.maximum(lines, 1)
    long_share = np.bincount(row[length > 20], minlength=rows) / n1
    return np.stack([
        np.log1p(n), np.bincount(row, weights=length, minlength=rows) / n1, *share[:7], n / l1, (lines - lines_different) / l1,
        different / n1, top / n1, np.bincount(row[length <= 3], minlength=rows) / n1, (pairs - pairs_different) / np.maximum(pairs, 1), long_share,
    ], 1)


@dataclass
class Model:
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for k, (edge, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += table[np.searchsorted(edge, x[:, k], "right")]
        for (i, j), grid in zip(self.pairs, self.grids, strict=True):
            out += grid[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return out


def _edges(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.arange(1, bins) / bins))


def _tree(g: np.ndarray, h: np.ndarray, cuts: int = 2, weight: float = 1.0) -> np.ndarray:
    """Values by bin of the tree with up to ``cuts`` cuts, each where it gains most."""
    parts = [(0, len(g))]
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain_of = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + weight)
    for _ in range(cuts):
        options = []
        for a, b in parts:
            if b - a > 1:
                m = np.arange(a + 1, b)
                gain = gain_of(a, m) + gain_of(m, b) - gain_of(a, b)
                options.append((float(gain.max()), a, b, int(m[gain.argmax()])))
        if not options or max(options)[0] <= 1e-9:
            break
        _, a, b, m = max(options)
        parts.remove((a, b))
        parts += [(a, m), (m, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + weight)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, weight: float = 1.0) -> tuple[np.ndarray, float]:
    """Values on a grid of the best pair of cuts, and their gain."""
    G, H = (np.zeros((g.shape[0] + 1, g.shape[1] + 1)) for _ in range(2))
    G[1:, 1:], H[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, where = -1.0, (1, 1)
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            q = [(G[i, j], H[i, j]), (G[-1, j] - G[i, j], H[-1, j] - H[i, j]), (G[i, -1] - G[i, j], H[i, -1] - H[i, j])]
            q.append((G[-1, -1] - sum(a for a, _ in q), H[-1, -1] - sum(b for _, b in q)))
            gain = sum(a * a / (b + weight) for a, b in q)
            if gain > best:
                best, where = gain, (i, j)
    out = np.zeros(g.shape)
    i, j = where
    for a in (slice(0, i), slice(i, None)):
        for b in (slice(0, j), slice(j, None)):
            out[a, b] = g[a, b].sum() / (h[a, b].sum() + weight)
    return out, best - G[-1, -1] ** 2 / (H[-1, -1] + weight)


def train(x: np.ndarray, y: np.ndarray, seed: int = 3) -> Model:
    if not len(y) or y.min() == y.max():
        return Model()
    d = x.shape[1]
    out = np.random.default_rng(seed).random(len(y)) < 0.2
    fit = ~out
    if y[fit].min() == y[fit].max():
        fit[:] = True
    p = y[fit].mean()
    m = Model(float(np.log(p / (1 - p))), [_edges(x[fit, k], BINS) for k in range(d)], [], [_edges(x[fit, k], COARSE) for k in range(d)])
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    at = [np.searchsorted(m.edges[k], x[:, k], "right") for k in range(d)]
    rough = [np.searchsorted(m.coarse[k], x[:, k], "right") for k in range(d)]
    f = np.full(len(y), m.base)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-f))
        return np.where(fit, y - q, 0.0), np.where(fit, q * (1 - q), 0.0)

    def loss() -> float:
        z = f[out] if out.any() else f
        return float(np.mean(np.logaddexp(0, z) - (y[out] if out.any() else y) * z))

    def boost(step: object, tables: list[np.ndarray]) -> None:
        nonlocal f
        best, kept, since = loss(), ([t.copy() for t in tables], f.copy()), 0
        for _ in range(ROUNDS):
            step()
            if (now := loss()) < best - 1e-5:
                best, kept, since = now, ([t.copy() for t in tables], f.copy()), 0
            elif (since := since + 1) >= PATIENCE:
                break
        for t, k in zip(tables, kept[0], strict=True):
            t[...] = k
        f = kept[1]

    def mains() -> None:
        for k in range(d):
            g, h = slope()
            add = RATE * _tree(np.bincount(at[k], g, len(m.tables[k])), np.bincount(at[k], h, len(m.tables[k])))
            m.tables[k] += add
            f[:] += add[at[k]]

    boost(mains, m.tables)
    g, h = slope()
    shape = lambda i, j: (len(m.coarse[i]) + 1, len(m.coarse[j]) + 1)

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        a, b = shape(i, j)
        return np.bincount(rough[i] * b + rough[j], v, a * b).reshape(a, b)

    gains = sorted(((_quadrants(grid(i, j, g), grid(i, j, h))[1], i, j) for i in range(d) for j in range(i + 1, d) if min(shape(i, j)) > 1), reverse=True)
    m.pairs = [(i, j) for _, i, j in gains[:PAIRS]]
    m.grids = [np.zeros(shape(i, j)) for i, j in m.pairs]

    def inter() -> None:
        for k, (i, j) in enumerate(m.pairs):
            g, h = slope()
            add = RATE * _quadrants(grid(i, j, g), grid(i, j, h))[0]
            m.grids[k] += add
            f[:] += add[rough[i], rough[j]]

    boost(inter, m.grids)
    return m


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """On at most ``sample`` labelled documents."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    ids = ids.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(sample)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            x = features(b)
            yield pa.record_batch([col(b, "doc_id"), col(b, "y"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = slim.join(F.broadcast(ids), "doc_id").mapInArrow(run, "doc_id long, y int, x array<double>").orderBy("doc_id", "x").limit(sample).collect()
    return train(np.array([r[2] for r in rows]).reshape(len(rows), -1), np.array([r[1] for r in rows], float)) if rows else Model()


def score(docs: DataFrame, model: Model) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            f = sent.value.score(features(b))
            yield pa.record_batch([col(b, "doc_id"), pa.array(f), pa.array(1 / (1 + np.exp(-f))), pa.array(f >= 0)], ["doc_id", "logit", "score", "keep"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, logit double, score double, keep boolean")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
