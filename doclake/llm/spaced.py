"""Operator 6: benchmark decontamination by spaced seeds.

A seed is a mask over successive words that reads some positions and ignores the others, so one replaced word is missed by a mask
that ignores it. Every position of every benchmark item and every document is hashed under each mask; equal hashes are hits. A hit
fixes a diagonal; along it the item and the document are compared word by word, and the best stretch (a match counts 1, a
substitution -2) is a finding if it has ``least_matches`` matching words, or all but one in ten of a shorter item's.

The masks are complete: every stretch that is a finding of an item of ten words or more holds a hit of one of them (a test goes
through all patterns of matches and substitutions). A shorter item has to match whole, so its seed is a mask of its length. Items
shorter than ``least_item`` words (a parameter; most texts hold so few words by chance) are not looked for.

Words are those of ``common``. Result: ``doc_id, item_id, doc_word, item_word, n_words, n_matches``, the best stretch of each document
and item (ties: most matches, then the first). Null ids of either table are left out, null and empty texts have no findings, repeated rows
give equal findings once, rows that repeat an id with other texts are searched each, empty tables give an empty result; other columns
are not read. Very long texts are compared whole: diagonals are found in pieces of ``PAIRS`` hits, and a run of hits on a diagonal counts
once, so that texts of one word repeated take no more memory.

The benchmark goes to the tasks in slices of ``SLICE_WORDS`` words, one pass over the documents for each, so what is broadcast is
bounded whatever the benchmark's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, col, longs, mix, slices, words

#: 1 is read, 0 ignored.
MASKS = ("11101101", "11110001001", "11101000101")
#: Words of an item from which on the masks are used.
MASKED = 10
LEAST_ITEM = 5
LEAST_MATCHES = 12
SLICE_WORDS = 1_000_000
SUBSTITUTION = 2
#: Hits that are put on their diagonals at one time.
PAIRS = 1 << 20


@dataclass
class Index:
    """Seeds of a slice of the benchmark."""

    ids: np.ndarray
    words: np.ndarray
    of: np.ndarray
    masks: list[tuple[int, ...]]
    hashes: list[np.ndarray]  # sorted, for each mask
    places: list[np.ndarray]  # index of the item's word where that hash begins
    shift: int  # a hash's bits below those that index the filter
    bits: np.ndarray  # filter of all hashes, eight to a byte

    def seen(self, s: np.ndarray) -> np.ndarray:
        """Hashes that may be among the seeds."""
        k = (s >> U(self.shift)).astype(np.int64)
        return (self.bits[k >> 3] >> (7 - (k & 7)).astype(np.uint8) & 1).astype(bool)


def seed(h: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Hash of each stretch of words that begins at 0, 1, ... and lies within ``h``."""
    n = len(h) - mask[-1]
    s = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        with np.errstate(over="ignore"):
            for k, p in enumerate(mask):
                s += h[p : p + n] * U((0x9E3779B97F4A7C15 * (2 * k + 1)) & (2**64 - 1))
            s = mix(s + U(len(mask) * 1000 + mask[-1]))
    return s


def build(ids: np.ndarray, h: np.ndarray, of: np.ndarray, least_item: int = LEAST_ITEM) -> Index:
    masks = [tuple(i for i, c in enumerate(m) if c == "1") for m in MASKS]
    size = np.diff(of)
    short = sorted({int(n) for n in size if max(1, least_item) <= n < MASKED})
    own = np.repeat(size, size)  # words of the item that a word is of
    left = np.repeat(of[1:], size) - np.arange(len(h))  # words from here to the item's end
    hashes, places, all_masks = [], [], []
    for m, of_length in [(m, None) for m in masks] + [(tuple(range(n)), n) for n in short]:
        s = seed(h, m)
        n = own[: len(s)]
        at = np.flatnonzero((left[: len(s)] > m[-1]) & ((n == of_length) if of_length else (n >= max(MASKED, least_item))))
        o = np.argsort(s[at], kind="stable")
        all_masks.append(m)
        hashes.append(s[at][o])
        places.append(at[o])
    index = min(28, max(16, (8 * sum(map(len, hashes))).bit_length()))
    bits = np.zeros(1 << index, bool)
    for s in hashes:
        bits[(s >> U(64 - index)).astype(np.int64)] = True
    return Index(ids, h, of, all_masks, hashes, places, 64 - index, np.packbits(bits))


def best(same: np.ndarray) -> tuple[int, int, int]:
    """Start, end and matches of the stretch with the highest score; the first of equals."""
    score = np.concatenate([[0], np.cumsum(np.where(same, 1, -SUBSTITUTION))])
    low = np.minimum.accumulate(score)
    end = int(np.argmax(score - low))
    start = int(np.flatnonzero(score[: end + 1] == low[end])[-1])
    return start, end, int(same[start:end].sum())


def enough(matches: int, item_words: int, least: int) -> bool:
    return matches >= min(least, item_words - item_words // 10)


def diagonals(h: np.ndarray, of: np.ndarray, x: Index) -> list[tuple[int, int, int]]:
    """(row, item, place in the document less place in the benchmark) of every hit, sorted; a row's words are h[of[row] : of[row + 1]]."""
    ends = np.repeat(of[1:], np.diff(of))
    firsts = np.repeat(of[:-1], np.diff(of))
    item_of = np.repeat(np.arange(len(x.ids)), np.diff(x.of))
    lanes: list[np.ndarray] = []
    for m, hashes, places in zip(x.masks, x.hashes, x.places, strict=True):
        if not len(hashes):
            continue
        s = seed(h, m)
        at = np.flatnonzero(x.seen(s))
        at = at[at + m[-1] < ends[at]]
        lo, hi = np.searchsorted(hashes, s[at], "left"), np.searchsorted(hashes, s[at], "right")
        some = hi > lo
        at, lo, times = at[some], lo[some], (hi - lo)[some]
        own = seed(x.words, m)
        total, k = np.cumsum(times), 0
        while k < len(at):
            to = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + PAIRS, side="right")))
            t = times[k:to]
            who = np.repeat(at[k:to], t)
            place = places[np.repeat(lo[k:to], t) + np.arange(len(who)) - np.repeat(np.cumsum(t) - t, t)]
            # a hit right after another one on its diagonal says nothing new
            inner = (who > firsts[who]) & (place > x.of[item_of[place]])
            new = ~(inner & (s[np.maximum(who - 1, 0)] == own[np.maximum(place - 1, 0)]))
            who, place = who[new], place[new]
            found = np.stack([np.searchsorted(of, who, "right") - 1, item_of[place], who - place], 1)
            lanes.append(np.unique(found, axis=0))
            k = to
    return [tuple(v) for v in np.unique(np.concatenate(lanes), axis=0).tolist()] if lanes else []


def findings(h: np.ndarray, of: np.ndarray, x: Index, least: int) -> dict[tuple[int, int], tuple[int, int, int, int]]:
    """(row, item) -> (matches, document word, item word, words)."""
    out: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    for row, item, shift in diagonals(h, of, x):
        a, b = int(x.of[item]), int(x.of[item + 1])
        lo, hi = max(a, int(of[row]) - shift), min(b, int(of[row + 1]) - shift)
        start, end, matches = best(h[lo + shift : hi + shift] == x.words[lo:hi])
        if enough(matches, b - a, least):
            found = (matches, lo + start + shift - int(of[row]), lo + start - a, end - start)
            was = out.get((row, item))
            if was is None or (-found[0], *found[1:]) < (-was[0], *was[1:]):
                out[row, item] = found
    return out


def indexes(benchmark: DataFrame, least_item: int) -> Iterator[Index]:
    held: list[tuple[int, str]] = []
    size = 0
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null").distinct()

    def made() -> Index:
        w = words(pa.array([t for _, t in held], pa.string()))
        return build(np.array([i for i, _ in held], np.int64), w.hashes(), w.of, least_item)

    for r in rows.orderBy("item_id", "text").toLocalIterator():  # a slice at a time
        held.append((r[0], r[1]))
        size += r[1].count(" ") + 1
        if size >= SLICE_WORDS:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def hits(docs: DataFrame, benchmark: DataFrame, least_matches: int = LEAST_MATCHES, least_item: int = LEAST_ITEM) -> DataFrame:
    """Findings; see the module's docstring."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    names = ["doc_id", "item_id", "doc_word", "item_word", "n_words", "n_matches"]
    shape = ", ".join(f"{n} long" for n in names)
    spark = docs.sparkSession
    out = spark.createDataFrame([], shape)
    for x in indexes(benchmark, least_item):
        sent = spark.sparkContext.broadcast(x)

        def look(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            x, found = sent.value, []
            for b in slices(batches, "text"):
                w = words(col(b, "text"))
                ids = longs(b, "doc_id")
                for (row, item), (n, d, i, size) in findings(w.hashes(), w.of, x, least_matches).items():
                    found.append((int(ids[row]), int(x.ids[item]), d, i, size, n))
                if found:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names)
                    found = []

        out = out.unionByName(docs.mapInArrow(look, shape))
    first = F.min(F.struct((-F.col("n_matches")).alias("k"), "doc_word", "item_word", "n_words", "n_matches")).alias("f")
    return out.groupBy("doc_id", "item_id").agg(first).select("doc_id", "item_id", "f.doc_word", "f.item_word", "f.n_words", "f.n_matches")


def without_hits(docs: DataFrame, benchmark: DataFrame, least_matches: int = LEAST_MATCHES, least_item: int = LEAST_ITEM) -> DataFrame:
    """Documents that have no finding, in one pass for each slice of the benchmark and without a shuffle. Null ids stay if clean."""
    shape, spark = docs.schema, docs.sparkSession
    for x in indexes(benchmark, least_item):
        sent = spark.sparkContext.broadcast(x)

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            x = sent.value
            for b in slices(batches, "text"):
                w = words(col(b, "text"))
                clean = np.ones(b.num_rows, bool)
                clean[[row for row, _ in findings(w.hashes(), w.of, x, least_matches)]] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, shape)
    return docs
