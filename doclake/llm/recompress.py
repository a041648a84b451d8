"""Operator 10: long repeated substrings by recompression.

Each document is a sequence of word symbols. Rounds alternate *block* compression (a run of one symbol becomes a symbol) and
*pair* compression (a hash bit that changes from round to round puts each symbol left or right; each left-right pair becomes a
symbol). A symbol is named by a 64-bit hash of what it replaces, so all tasks give one expansion the same name and equal substrings
get equal symbols except near their ends. What must be known globally is which names are met more than once; that is a Spark round:

1. The first round compresses words to symbols of ``FREEZE`` words or more (what is left over joins its left neighbour). Two
   successive symbols make an anchor, named and counted over the whole table; anchors met once go.
2. Each further round compresses what is left, ``LEVELS`` times, where neighbours are still next to each other, and counts the new
   symbols over the whole table; those met once go. Rounds end when no symbol grows. Shared symbols of ``min_words`` words or more
   are repeats as they stand.
3. What high-level symbols don't show are repeats that reach beyond their ends, or too short for them. Every window of ``min_words``
   words around an anchor (or on a run of one symbol) is hashed, but for windows inside a high-level symbol that was met before: these are repeats already.
4. Windows and high-level symbols that were met before are verified by a second hash of their bytes, independent of the first (96
   bits in all), and merge with their neighbours on the same diagonal to spans.

So each window of ``min_words`` words around an anchor that occurs before, at any distance and in any number of places, is in a
span: ``doc_id, start_word, n_words, other_doc_id, other_start_word``, the other place the first one of that window or symbol (least
id, then position), always before this one, so that removing every such span leaves one copy. A span isn't limited in length; where
the first places of its parts lie in different documents, a repeat is told in several spans.

Words are those of ``common``; case and punctuation are not compared. Null ids are left out; null, empty and short texts have no
repeats. Ties: the first place is that of least id, then position. Rows that repeat an id with the same text count as one; with
different texts each is searched, spans carry the id, and a cut is made only where the row's own words are those of the span. An
empty table gives an empty result; other columns are not read. A very long text is hashed in bounded pieces; of a document one task
holds its words' hashes. A run of one symbol has an anchor of its own, named without
its length, as that differs from place to place; one of ``min_words`` repeats itself one symbol later, so that one symbol of it stays.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_WORD, U, Words, col, forget_since, list_of, longs, mix, power, signed, slices, stash, stashed, whole_groups, words
from .jaccard import by_id

FREEZE = 6
ROUNDS = 12
#: Compressions between two global counts.
LEVELS = 12
LEAST_ANCHOR = 10
#: Symbols from this size on are anchors by themselves, as a pair of them may be too long for a window.
ALONE = 16
#: In place of the words to the next anchor: a run of one symbol, named without its length, as that differs from place to place.
RUN = -1
#: Windows hashed at one time.
CHUNK = 1 << 17
SPANS = "_doclake_spans"
K1, K2, K3 = U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB)
SYMBOL = "name long, doc_id long, place long, step int"
Arrays = tuple[np.ndarray, ...]


def anchors(h: np.ndarray, of: np.ndarray, min_words: int) -> Arrays:
    """Name, row, first word within the row, length in words of every anchor of rows ``of`` of word hashes, and words to the next one (0: none, RUN: a run)."""
    sym, size = h.copy(), np.ones(len(h), np.int64)
    start = np.arange(len(h), dtype=np.int64)
    row = np.repeat(np.arange(len(of) - 1), np.diff(of))
    extra: list[Arrays] = []
    for r in range(ROUNDS):
        if len(sym) < 2:
            break
        live = size < FREEZE
        new = np.ones(len(sym), bool)
        new[1:] = ~((sym[1:] == sym[:-1]) & (row[1:] == row[:-1]) & live[1:])
        if not new.all():
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(sym)))
            s = sym[at]
            whole = size[at] * times
            for long, skip in (((times > 1) & (whole >= LEAST_ANCHOR), 0), ((times > 1) & (whole >= min_words), size[at])):
                if long.any():
                    past = np.broadcast_to(skip, whole.shape)[long]
                    extra.append((mix(s[long] ^ K3), row[at][long], start[at][long] + past, whole[long] - past, np.full(int(long.sum()), RUN)))
            with np.errstate(over="ignore"):
                sym = np.where(times > 1, mix(s * K3 + times.astype(np.uint64)), s)
            size, start, row = whole, start[at], row[at]
            live = size < FREEZE
        with np.errstate(over="ignore"):
            left = (mix(sym + U(r) * K2) & U(1)).astype(bool)
        pair = np.zeros(len(sym), bool)
        pair[:-1] = left[:-1] & ~left[1:] & live[:-1] & live[1:] & (row[:-1] == row[1:])
        at = np.flatnonzero(pair)
        if len(at):
            with np.errstate(over="ignore"):
                sym[at] = mix(mix(sym[at] * K1) + sym[at + 1] * K2)
            size[at] += size[at + 1]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, size, start, row = sym[keep], size[keep], start[keep], row[keep]
    if len(sym):  # what stayed short joins the symbol before it
        head = np.ones(len(sym), bool)
        head[1:] = (size[1:] >= FREEZE) | (row[1:] != row[:-1])
        at = np.flatnonzero(head)
        total = np.add.reduceat(size, at)
        with np.errstate(over="ignore"):
            order = (np.arange(len(sym)) - at[np.cumsum(head) - 1]).astype(np.uint64)
            name = np.add.reduceat(mix(sym + order * K2), at)
        alone = total == size[at]
        sym, size, start, row = np.where(alone, sym[at], mix(name)), total, start[at], row[at]
    k = np.flatnonzero(size >= ALONE)
    extra.append((mix(sym[k] ^ K1), row[k], start[k], size[k], np.zeros(len(k), np.int64)))
    ok = (row[1:] == row[:-1]) & (size[1:] + size[:-1] >= LEAST_ANCHOR) if len(sym) > 1 else np.zeros(0, bool)
    i = np.flatnonzero(ok)
    with np.errstate(over="ignore"):
        name = mix(mix(sym[i] * K2) + sym[i + 1] * K1) if len(i) else np.zeros(0, np.uint64)
    follows = np.zeros(len(i), bool)
    follows[:-1] = i[1:] == i[:-1] + 1
    pairs = (name, row[i], start[i], size[i] + size[i + 1], np.where(follows, size[i], 0)) if len(i) else (name, *[np.zeros(0, np.int64)] * 4)
    name, row, start, size, step = (np.concatenate([p[k] for p in (pairs, *extra)]) for k in range(5))
    return name, row, start - of[row], size, step


def packed(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << 32) | size


def emit(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        w = words(col(b, "text"))
        name, row, start, size, step = anchors(w.hashes(), w.of, min_words)
        yield pa.record_batch([signed(name), pa.array(longs(b, "doc_id")[row]), pa.array(packed(start, size)), pa.array(step.astype(np.int32))], ["name", "doc_id", "place", "step"])


def shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose name is met at two places or more, and whether one is the first; input sorted by name, id, place. Holds a batch at most."""
    names = ["name", "doc_id", "place", "step"]
    held: list[np.ndarray] | None = None
    last: tuple[int, int, int] | None = None  # the last row that was given out
    for b in batches:
        if not b.num_rows:
            continue
        c = [longs(b, n) for n in names]
        if held is not None:
            c = [np.concatenate(x) for x in zip(held, c, strict=True)]
        again = np.zeros(len(c[0]), bool)
        again[1:] = (c[0][1:] == c[0][:-1]) & (c[1][1:] == c[1][:-1]) & (c[2][1:] >> 32 == c[2][:-1] >> 32)
        again[0] = last is not None and (int(c[0][0]), int(c[1][0]), int(c[2][0]) >> 32) == last
        c = [x[~again] for x in c]
        if not len(c[0]):
            continue
        same = np.zeros(len(c[0]), bool)
        same[1:] = c[0][1:] == c[0][:-1]
        same[0] = last is not None and int(c[0][0]) == last[0]
        keep = same.copy()
        keep[:-1] |= same[1:]
        held = None if keep[-1] else [x[-1:] for x in c]
        if keep[-1]:
            last = (int(c[0][-1]), int(c[1][-1]), int(c[2][-1]) >> 32)
        if keep.any():
            yield pa.record_batch([*[pa.array(x[keep]) for x in c[:3]], pa.array(c[3][keep].astype(np.int32)), pa.array(~same[keep])], [*names, "first"])


def compress(sym: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray, step: np.ndarray, salt: int) -> Arrays:
    """One block and one pair compression of symbols sorted by document and start."""

    def merged(head: np.ndarray, name: np.ndarray) -> Arrays:
        at = np.flatnonzero(head)
        end = np.append(at[1:], len(head)) - 1
        return name, doc[at], start[at], start[end] + size[end] - start[at], np.where(step[end] > 0, start[end] + step[end] - start[at], 0)

    def joint() -> np.ndarray:
        return (doc[1:] == doc[:-1]) & (step[:-1] > 0) & (start[:-1] + step[:-1] == start[1:])

    if len(sym) > 1:
        head = np.ones(len(sym), bool)
        head[1:] = ~(joint() & (sym[1:] == sym[:-1]))
        if not head.all():
            times = np.diff(np.append(np.flatnonzero(head), len(sym)))
            with np.errstate(over="ignore"):
                name = np.where(times > 1, mix(sym[head] * K3 + times.astype(np.uint64)), sym[head])
            sym, doc, start, size, step = merged(head, name)
    if len(sym) > 1:
        with np.errstate(over="ignore"):
            left = (mix(sym + U(salt) * K2) & U(1)).astype(bool)
            pair = np.append(joint() & left[:-1] & ~left[1:], False)
            name = np.where(pair, mix(mix(sym * K1) + np.append(sym[1:], U(0)) * K2), sym)
        head = np.ones(len(sym), bool)
        head[1:] = ~pair[:-1]
        sym, doc, start, size, step = merged(head, name[head])
    return sym, doc, start, size, step


def grow(batches: Iterator[pa.RecordBatch], r: int) -> Iterator[pa.RecordBatch]:
    """Symbols of the next round; those without a neighbour go, as they can't grow."""
    for b in whole_groups(batches, "doc_id"):
        doc, place, step, sym = longs(b, "doc_id"), longs(b, "place"), longs(b, "step").astype(np.int64), longs(b, "name").view(np.uint64)
        some = step > 0
        some[1:] |= (doc[1:] == doc[:-1]) & (step[:-1] > 0)
        o = np.flatnonzero(some)
        o = o[np.lexsort((place[o], doc[o]))]
        x = (sym[o], doc[o], place[o] >> 32, place[o] & 0xFFFFFFFF, step[o])
        keep = np.ones(len(o), bool)  # an anchor that stands alone has no step, but may begin where another does
        if len(o):
            near = np.zeros(len(o), bool)
            near[:-1] = (x[1][1:] == x[1][:-1]) & (x[4][:-1] > 0) & (x[2][:-1] + x[4][:-1] == x[2][1:])
            keep = near.copy()
            keep[1:] |= near[:-1]
        x = tuple(v[keep] for v in x)
        for k in range(LEVELS):
            x = compress(*x, salt=1000 + r * LEVELS + k)
        if len(x[0]):
            yield pa.record_batch([signed(x[0]), pa.array(x[1]), pa.array(packed(x[2], x[3])), pa.array(x[4].astype(np.int32))], ["name", "doc_id", "place", "step"])


def united(lo: np.ndarray, hi: np.ndarray, less_lo: np.ndarray, less_hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges, less other ranges; bounds are sorted and don't touch."""
    at = np.concatenate([lo, hi, less_lo, less_hi])
    n, m = len(lo), len(less_lo)
    add = np.concatenate([np.ones(n, np.int64), -np.ones(n, np.int64), np.zeros(2 * m, np.int64)])
    less = np.concatenate([np.zeros(2 * n, np.int64), np.ones(m, np.int64), -np.ones(m, np.int64)])
    o = np.argsort(at, kind="stable")
    at, inside = at[o], (np.cumsum(add[o]) > 0) & (np.cumsum(less[o]) == 0)
    last = np.ones(len(at), bool)
    last[:-1] = at[1:] != at[:-1]  # of several events at one place, what holds after all of them
    at, inside = at[last], inside[last]
    turn = np.ones(len(at), bool)
    turn[1:] = inside[1:] != inside[:-1]
    if len(at):
        turn[0] = inside[0]
    at = at[turn]
    return at[::2], at[1::2]


def zones(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """For each document the first words of the windows to hash, as ranges, and the high-level symbols to verify; input sorted by id."""
    for b in whole_groups(batches, "doc_id"):
        doc, place = longs(b, "doc_id"), longs(b, "place")
        high, first = (col(b, c).to_numpy(zero_copy_only=False) for c in ("high", "first"))
        ids, nth = np.unique(doc, return_inverse=True)
        base = nth.astype(np.int64) << 33
        s, n = place >> 32, place & 0xFFFFFFFF
        low = ~high
        wide = col(b, "wide").to_numpy(zero_copy_only=False)[low] | (n[low] >= min_words)
        a = base[low] + np.maximum(np.where(wide, s[low] - min_words + 1, s[low] + n[low] - min_words), 0)
        z = base[low] + np.where(wide, s[low] + n[low] - 1, s[low]) + 1
        met = high & ~first
        lo, hi = united(a, z, base[met] + s[met], base[met] + s[met] + n[met] - min_words + 1)
        row = lo >> 33
        ranges = packed(lo - (row << 33), hi - (row << 33))
        # a symbol within a longer one that was met before needs no look of its own
        k = np.flatnonzero(high)
        k = k[np.lexsort((-n[k], s[k], nth[k]))]
        end = base[k] + s[k] + n[k]
        reach = np.maximum.accumulate(np.where(met[k], end, 0)) if len(k) else end
        before = np.concatenate([[0], reach[:-1]]) if len(k) else reach
        k = k[end > before]
        spans, count = place[k], np.bincount(nth[k], minlength=len(ids))
        yield pa.record_batch([pa.array(ids), list_of(ranges, np.bincount(row, minlength=len(ids)), pa.int64()), list_of(spans, count, pa.int64())], ["doc_id", "ranges", "spans"])


class Sums:
    """Hashes of stretches of words, by prefix sums."""

    def __init__(self, h: np.ndarray):
        self.h, up = h, power(len(h) + 1)
        self.down = up[1]
        with np.errstate(over="ignore"):
            self.s = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(h * up[0][: len(h)], out=self.s[1:])

    def of(self, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.s[start + n] - self.s[start]) * self.down[start] + n.astype(np.uint64) * K1)


def windows(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """(key, check, doc_id, place) of every wanted window and symbol."""
    for b in slices(batches, "text"):
        w = words(col(b, "text"))
        if not len(w.starts):
            continue
        key, check, ids = Sums(w.hashes()), Sums(w.hashes(other=True)), longs(b, "doc_id")

        def rows(start: np.ndarray, n: np.ndarray, row: np.ndarray, key=key, check=check, ids=ids, w=w) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(start), CHUNK):
                s, m, r = start[k : k + CHUNK], n[k : k + CHUNK], row[k : k + CHUNK]
                second = (check.of(s, m) >> U(32)).astype(np.uint32).view(np.int32)
                yield pa.record_batch([signed(key.of(s, m)), pa.array(second), pa.array(ids[r]), pa.array(packed(s - w.of[r], m))], ["key", "check", "doc_id", "place"])

        for name in ("ranges", "spans"):
            a = col(b, name)
            off, val = a.offsets.to_numpy(), a.values.to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), np.diff(off))
            val = val[off[0] : off[-1]]
            lo, hi = w.of[row] + (val >> 32), val & 0xFFFFFFFF
            if name == "spans":
                ok = lo + hi <= w.of[row + 1]  # else of another row of the id
                yield from rows(lo[ok], hi[ok], row[ok])
                continue
            hi = np.minimum(w.of[row] + hi, w.of[row + 1] - min_words + 1)
            count = np.maximum(hi - lo, 0)
            ends, at = np.cumsum(count), 0
            while at < len(count):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 4 * CHUNK, side="right")))
                c = count[at:to]
                r = np.repeat(np.arange(at, to), c)
                start = lo[r] + np.arange(len(r)) - np.repeat(np.cumsum(c) - c, c)
                yield from rows(start, np.full(len(r), min_words, np.int64), row[r])
                at = to


def met_before(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each later place of a window or symbol with the first; input sorted by key, check, id, place. Holds a batch at most."""
    first: tuple[int, int, int, int] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        key, check, doc, place = (longs(b, c) for c in ("key", "check", "doc_id", "place"))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
        new[0] = first is None or first[:2] != (int(key[0]), int(check[0]))
        at = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        f_doc, f_place = (np.concatenate([[first[2 + k] if first else 0], c[at]])[group + 1] for k, c in enumerate((doc, place)))
        first = (int(key[-1]), int(check[-1]), int(f_doc[-1]), int(f_place[-1]))
        s, os = place >> 32, f_place >> 32
        ok = ~new & ((doc != f_doc) | (s != os))
        ok[1:] &= ~((key[1:] == key[:-1]) & (doc[1:] == doc[:-1]) & (place[1:] == place[:-1]))
        if ok.any():
            yield pa.record_batch([pa.array(x[ok]) for x in (doc, s, place & 0xFFFFFFFF, f_doc, os, key)], ["doc_id", "s", "n", "other", "os", "key"])


def islands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans that overlap or touch on one diagonal become one; ``n0`` and ``key`` are those of its first."""
    for b in whole_groups(batches, "doc_id"):
        d, s, n, o, os, key = (longs(b, c) for c in ("doc_id", "s", "n", "other", "os", "key"))
        k = np.lexsort((s, s - os, o, d))
        d, s, n, o, os, key = d[k], s[k], n[k], o[k], os[k], key[k]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (o[1:] != o[:-1]) | ((s - os)[1:] != (s - os)[:-1])
        lane = np.cumsum(new)
        end = s + n
        top = int(end.max()) + 1 if len(end) else 1
        reach = np.maximum.accumulate(end + lane * top) - lane * top
        new[1:] |= s[1:] > reach[:-1]
        at = np.flatnonzero(new)
        whole = np.maximum.reduceat(end, at) - s[at] if len(at) else end
        yield pa.record_batch([pa.array(x) for x in (d[at], s[at], whole, o[at], os[at], n[at], key[at])], ["doc_id", "s", "n", "other", "os", "n0", "key"])


def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document with as few of its spans as have the same words in them; input sorted by id."""
    for b in whole_groups(batches, "doc_id"):
        d, s, n = longs(b, "doc_id"), longs(b, "s"), longs(b, "n")
        ids, nth = np.unique(d, return_inverse=True)
        o = np.lexsort((-n, s, nth))
        at = (nth[o].astype(np.int64) << 33) + s[o]
        end = at + n[o]
        further = np.ones(len(o), bool)
        further[1:] = end[1:] > np.maximum.accumulate(end)[:-1]
        o, at, end = o[further], at[further], end[further]  # starts and ends both rise
        reach = np.searchsorted(at, end, side="right") - 1  # the last span that begins within this one or right after it
        taken, k = [], 0
        while k < len(o):
            taken.append(k)
            k = int(reach[k]) if reach[k] > k else k + 1
        o = o[taken]
        spans = pa.StructArray.from_arrays([col(b, c).take(pa.array(o)) for c in ("s", "n", "n0", "key")], ["s", "n", "n0", "key"])
        of = np.concatenate([[0], np.cumsum(np.bincount(nth[o], minlength=len(ids)))]).astype(np.int32)
        yield pa.record_batch([pa.array(ids), pa.ListArray.from_arrays(pa.array(of), spans)], ["doc_id", "spans"])


def counted(symbols: DataFrame, name: str) -> DataFrame:
    """Symbols met at two places or more, over the whole table."""
    return stash(symbols.repartition("name").sortWithinPartitions("name", "doc_id", "place").mapInArrow(shared, f"{SYMBOL}, first boolean"), name)


def found(docs: DataFrame, min_words: int) -> DataFrame:
    """Verified windows and symbols that were met before (doc_id, s, n, other, os, key), sorted by id within partitions."""
    mark = stashed()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    low = counted(docs.mapInArrow(lambda bs: emit(bs, min_words), SYMBOL), "anchors")
    parts, now, size = [low.select("doc_id", "place", F.lit(False).alias("high"), "first", (F.col("step") == RUN).alias("wide"))], low, -1
    for r in range(64):  # a symbol's words grow by a factor, so that a text of any length is done long before
        by = now.select("name", "doc_id", "place", "step").repartition("doc_id").sortWithinPartitions("doc_id", "place")
        now = counted(by.mapInArrow(lambda bs, r=r: grow(bs, r), SYMBOL), "symbols")
        some = now.agg(F.count("*"), F.sum(F.expr("place & 4294967295"))).first()
        if not some[0] or some[1] == size:
            break
        size = some[1]
        parts.append(now.where(F.expr(f"place & 4294967295 >= {min_words}")).select("doc_id", "place", F.lit(True).alias("high"), "first", F.lit(False).alias("wide")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    wanted = rows.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(lambda bs: zones(bs, min_words), "doc_id long, ranges array<long>, spans array<long>")
    wanted = stash(wanted, "zones", slim=True)
    forget_since(mark, wanted)
    seen = by_id(docs, wanted, weight="1 + size(ranges) + size(spans)").mapInArrow(lambda bs: windows(bs, min_words), "key long, check int, doc_id long, place long")
    seen = seen.repartition("key").sortWithinPartitions("key", "check", "doc_id", "place").mapInArrow(met_before, "doc_id long, s long, n long, other long, os long, key long")
    return seen.repartition("doc_id").sortWithinPartitions("doc_id")


def repeats(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """Repeated spans; see the module's docstring."""
    spans = found(docs, min_words).mapInArrow(islands, "doc_id long, s long, n long, other long, os long, n0 long, key long")
    return spans.select("doc_id", F.col("s").alias("start_word"), F.col("n").alias("n_words"), F.col("other").alias("other_doc_id"), F.col("os").alias("other_start_word"))


def own(w: Words, row: np.ndarray, spans: pa.StructArray) -> np.ndarray:
    """Of spans of rows, those whose first words are this row's."""
    s, n, n0, key = (spans.field(c).to_numpy(zero_copy_only=False) for c in ("s", "n", "n0", "key"))
    ok = w.of[row] + s + n <= w.of[row + 1]
    i = np.flatnonzero(ok)
    ok[i] = Sums(w.hashes()).of(w.of[row[i]] + s[i], n0[i]).view(np.int64) == key[i]
    return ok


def cut(batches: Iterator[pa.RecordBatch], names: list[str], own_column: str = SPANS) -> Iterator[pa.RecordBatch]:
    """Take the spans out of each text, with the white space and punctuation after them; n_chars follows."""
    for b in slices(batches, "text"):
        spans = col(b, own_column)
        hit = np.flatnonzero(pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False) > 0)
        if not len(hit):
            yield b.select(names)
            continue
        texts = pc.fill_null(col(b, "text").take(pa.array(hit)), "")
        spans = spans.take(pa.array(hit))
        row = np.repeat(np.arange(len(hit)), pc.list_value_length(spans).to_numpy(zero_copy_only=False))
        flat = spans.flatten()
        good = own(words(texts), row, flat)
        w = words(texts, lower=False)
        of = np.searchsorted(row, np.arange(len(hit) + 1))
        first, length = flat.field("s").to_numpy(zero_copy_only=False), flat.field("n").to_numpy(zero_copy_only=False)
        text_end = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
        new = col(b, "text").to_pylist()
        gone, changed = np.zeros(b.num_rows, bool), np.zeros(b.num_rows, bool)
        for k in range(len(hit)):
            mine = np.flatnonzero(good[of[k] : of[k + 1]]) + of[k]
            if not len(mine):
                continue
            out, at, end = [], int(text_end[k]), int(text_end[k + 1])
            for i in mine[np.lexsort((length[mine], first[mine]))]:
                a, z = int(w.of[k] + first[i]), int(w.of[k] + first[i] + length[i])
                lo, hi = int(w.starts[a]), int(w.starts[z]) if z < w.of[k + 1] else end
                if lo > at:
                    out.append(w.data[at:lo].tobytes())
                at = max(at, hi)
            out.append(w.data[at:end].tobytes())
            joined = b"".join(out)
            new[hit[k]] = joined.decode()
            changed[hit[k]] = True
            gone[hit[k]] = not IS_WORD[np.frombuffer(joined, np.uint8)].any()
        columns = []
        for n in names:
            c = col(b, n)
            if n == "text":
                c = pa.array(new, c.type)
            elif n == "n_chars" and pa.types.is_integer(c.type):
                c = pc.if_else(pa.array(changed), pa.array([len(t or "") for t in new], c.type), c)
            columns.append(c.filter(pa.array(~gone)))
        yield pa.record_batch(columns, names)


def without_repeats(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """Documents less every repeated span but its first place; one left without a word goes, all others stay, null ids and texts too.

    Columns stay as they are, also one named like the operator's own; n_chars, where it is an integer, follows a changed text.
    """
    names, own_column = docs.columns, SPANS
    while own_column in names:
        own_column += "_"
    mark = stashed()
    spans = found(docs, min_words).mapInArrow(lambda bs: cover(islands(bs)), "doc_id long, spans array<struct<s:long,n:long,n0:long,key:long>>")
    spans = stash(spans.withColumnRenamed("spans", own_column), "spans", slim=True)
    forget_since(mark, spans)
    return by_id(docs, spans, "left", f"1 + size({own_column})").mapInArrow(lambda bs: cut(bs, names, own_column), docs.schema)


__all__ = ["anchors", "repeats", "without_repeats"]
