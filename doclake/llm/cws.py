"""Operator 5: document fingerprints by consistent weighted sampling.

A document is its words, each weighted by 1 + ln(count). For every word and each of ``SAMPLES`` samples, r and c are drawn from
Gamma(2, 1) and b from U(0, 1), all from a hash of word and sample number, so that every task draws the same. With weight w,
t = floor(ln w / r + b) and ln a = ln c - r (t - b) - r; the sample is the (word, t) of least a. Two documents have an equal sample
with the probability of their generalised Jaccard similarity, sum(min) / sum(max) of their weights, so the share of equal
entries of two signatures estimates it.

Result: ``doc_id, n_words, signature`` (array<int>, a 32-bit hash of word, t and sample number). Equal bags of words have equal
signatures whatever the order, and ties within a sample go to the least name. A very long text is weighed whole. Texts without words, null or empty, have an empty signature; null ids and repeated rows are kept;
an empty table gives an empty result; other columns are not read. ``estimate`` compares two signature columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U, by_row, col, list_of, mix, slices, words

SAMPLES = 64


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> U(11)).astype(np.float64) + 0.5) / 2.0**53


def scores(word: np.ndarray, count: np.ndarray, k: int) -> np.ndarray:
    """For each (word, count): ln a of sample k, made an ordered 32-bit number, above 32 bits that name (word, t, k)."""
    with np.errstate(over="ignore"):
        base = mix(word + U(k + 1) * U(0x9E3779B97F4A7C15))
        draw = [_uniform(mix(base + U(i) * U(0xD1B54A32D192ED03))) for i in range(1, 6)]
        r, c, b = -np.log(draw[0] * draw[1]), -np.log(draw[2] * draw[3]), draw[4]
        t = np.floor(np.log(1 + np.log(count)) / r + b)
        a = (np.log(c) - r * (t - b) - r).astype(np.float32).view(np.uint32)
        order = np.where(a >> np.uint32(31), ~a, a | np.uint32(1 << 31)).astype(np.uint64)
        name = mix(base ^ mix(t.astype(np.int64).view(np.uint64) + U(0x51ED))) >> U(32)
    return (order << U(32)) | name


def signatures(row: np.ndarray, h: np.ndarray, rows: int, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the rows that have words, and which rows those are."""
    o = by_row(row, h)
    row, h = row[o], h[o]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(h)))
    row, h = row[at], h[at]
    # scores depend on word and count only; each pair of them is worked out once
    key = mix(h) + count.astype(np.uint64)
    _, first, code = np.unique(key, return_index=True, return_inverse=True)
    there, start = np.unique(row, return_index=True)
    out = np.empty((len(there), samples), np.uint32)
    uh, uc = h[first], count[first].astype(np.float64)
    for k in range(samples):
        s = scores(uh, uc, k)
        out[:, k] = np.minimum.reduceat(s[code], start) & U(0xFFFFFFFF)
    return out, there


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Signatures of every document; see the module's docstring."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 4 << 20):
            w = words(col(b, "text"))
            n = np.diff(w.of)
            if len(w.starts):
                sig, there = signatures(w.row(), w.hashes(), b.num_rows, samples)
            else:
                sig, there = np.zeros((0, samples), np.uint32), np.zeros(0, np.int64)
            size = np.zeros(b.num_rows, np.int64)
            size[there] = samples
            yield pa.record_batch([col(b, "doc_id"), pa.array(n), list_of(sig.ravel().view(np.int32), size, pa.int32())], ["doc_id", "n_words", "signature"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_words long, signature array<int>")


def estimate(a: Column, b: Column) -> Column:
    """Share of equal entries; null where either is empty."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), equal / F.size(a))
