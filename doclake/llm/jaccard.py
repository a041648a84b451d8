"""Operator 7: n-gram Jaccard self-join, size-aware (heavy-light); exact for light sets, and but for a chance of ``MISS`` a pair for heavy ones.

A document is the set of its word n-grams; one with fewer than ``n`` words has one gram, all its words; one without words has an
empty set and no partner. All pairs with Jaccard >= ``threshold`` are found:

* Every set's grams are put in one global order, rare first. Two similar sets share a gram among their first
  ``size - ceil(threshold * size) + 1`` (prefix filter), and ``k`` grams if ``k - 1`` more are taken. The order rests on two
  count sketches of fixed size over the whole table; they decide cost, never results.
* *Light* sets, smaller than the boundary, enumerate the 2-subsets of that prefix: two light sets are candidates when they
  share one. *Heavy* sets scan the inverted lists of single prefix grams, which also hold light sets near the boundary.
  ``boundary`` weighs subsets written against list entries scanned, with the mean list length that the sketch shows.
* Heavy sets fall into classes of size, each class with lists of its own that hold its sets and those of the class below. As
  two similar sets share k grams of prefixes k - 1 longer, a class may list a hashed sample of the grams: at rate r with
  (1 - r)^k <= ``MISS`` / 2, a similar pair is missed with that probability at most. The rate that writes fewest entries is taken.
* Two sets are partners in a list if size, position and enough of 128 bits of their entries agree (``digests``, ``least_equal``), which
  a similar pair fails with ``MISS`` / 2 at most, so that grams shared by chance make no partners. Entries without a partner end there.
* A set joins the *unit* of the list in which it has most partners, so that a group of alike sets is a few units, however large. What is
  written are pairs of units of which sets are partners, not pairs of sets; all sets of the two are then compared by their full grams,
  64 common grams at once (``overlaps``). Units decide cost, never results. The comparisons within a group stay quadratic, its rows don't.

Equal sets are one set throughout (by two 64-bit names), so thousands of copies cost no pairs. ``links`` has a row for every id:
``doc_id, class_id, n_links``. n_links is the number of other documents that are similar, counted by id, so that those whose sets are equal, texts
that differ among them, each have all their links. class_id is the least id of the group that chains of links connect, a document's own where it has none. ``join``
has the pairs between the least ids of different sets, and a star for equal ones.
Null ids are left out; null and empty texts have no partner; repeated rows of an id are one document, and an id with several texts has
the links of each; columns beside ``doc_id`` and ``text`` are not read. Ties: of equal sets the least id stands for all. Very long texts are sets like others, held whole by one task.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX_BYTES, U, by_row, col, forget, forget_since, list_of, longs, mix, signed, slices, stash, stashed, whole_groups, words

#: Words of a gram, and the least similarity of a pair.
N, THRESHOLD = 2, 0.7
#: Chance that a pair of heavy sets at the threshold is missed: half of it in the lists, half by digests.
MISS = 1e-6
#: Grams from which on a digest is of parts of the hash space, and no longer of hash functions, which cost a look at every gram each.
DIGESTED = 256
DIGEST = ("d0", "d1", "e0", "e1")
A1, A2 = U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
SKETCH = 1 << 20
BLOCK = 1 << 14
#: Ids or rows that a join may broadcast; beyond it both sides are shuffled.
BROADCAST_ROWS = 1_000_000
#: Cost of looking at one entry of an inverted list, against that of writing one key.
SCAN_COST = 0.05
#: Bits of a digest.
BINS = 128
SEEDS = np.random.default_rng(0x0D16).integers(0, 2**64, BINS, dtype=np.uint64)
#: Pairs of a list that are listed by index; those of longer lists are looked at as bits, TILE entries by TILE_COLUMNS at a time.
LISTED = 20_000
TILE, TILE_COLUMNS = 128, 1024
#: Units of a list whose pairs are marked in a table; beyond it they are listed.
MARKED = 4096
#: Grams of the sets of one unit, and of the units of one meeting, before it is split.
UNIT_GRAMS, MEETING_GRAMS = 2_000_000, 4_000_000


def grams(b: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of every gram, then indexes of its n words (a short one's last again), and the words' hashes."""
    w = words(col(b, "text"))
    h, count = w.hashes(), np.diff(w.of)
    of = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(w.rows), of)
    first = np.arange(len(row)) - np.repeat(np.cumsum(of) - of, of) + np.repeat(w.of[:-1], of)
    last = w.of[1:][row]
    g = np.zeros(len(row), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            at = first + k
            there = at < last
            g = np.where(there, mix(g * A1 + h[np.minimum(at, max(len(h) - 1, 0))]) if len(h) else g, g)
    return row, g, np.minimum(first[:, None] + np.arange(n), last[:, None] - 1), h


def sketch(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of words and of grams in SKETCH buckets each, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros(2 * SKETCH, np.int64)
        for b in slices(batches, "text"):
            _, g, _, h = grams(b, n)
            c[:SKETCH] += np.bincount((h >> U(44)).astype(np.int64), minlength=SKETCH)
            c[SKETCH:] += np.bincount((g >> U(44)).astype(np.int64), minlength=SKETCH)
        if c.any():
            blocks = c.reshape(-1, BLOCK)
            for k in range(len(blocks)):
                yield pa.record_batch({"block": pa.array([k], pa.int32()), "counts": pa.array([blocks[k].astype(np.uint32).tobytes()])})

    def total(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros(BLOCK, np.int64)
        for b in batches:
            for x in b.column(1):
                c += np.frombuffer(x.as_buffer(), np.uint32)
        yield pa.record_batch({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([np.minimum(c, 2**32 - 1).astype(np.uint32).tobytes()])})

    parts = docs.select("text").mapInArrow(count, "block int, counts binary")
    out = np.zeros((2 * SKETCH // BLOCK, BLOCK), np.uint32)
    for r in parts.groupBy("block").applyInArrow(total, "block int, counts binary").collect():  # 128 rows of 64 kB at any scale
        out[r[0]] = np.frombuffer(r[1], np.uint32)
    return out.reshape(2, SKETCH)[0], out.reshape(2, SKETCH)[1]


def levels(counts: np.ndarray, over: float, step: float) -> np.ndarray:
    """0 for counts below ``over`` times the mean, then rising with the logarithm."""
    x = counts / max(counts.mean(), 1.0) / over
    return np.clip(np.floor(np.log2(np.maximum(x, 1.0)) * step) + (x > 1), 0, 60).astype(np.uint8)


def boundary(gram_counts: np.ndarray, threshold: float) -> int:
    """Smallest size from which single lists cost less than 2-subsets.

    A set of size s writes C(p + 1, 2) subsets or p list keys; each list key is scanned against the expected list of an
    occurrence, sum(c^2) / sum(c), taken over buckets, less the chance load of a bucket.
    """
    c = gram_counts.astype(np.float64)
    expected = max(0.0, float((c * c).sum() / max(c.sum(), 1.0) - c.mean()))
    s = 3
    while s < 40:
        p = s - math.ceil(threshold * s - 1e-9) + 1
        if (p + 1) * p / 2 > p * (1 + SCAN_COST * expected):
            break
        s += 1
    return s


def need_of(rate: int) -> int:
    """Grams that must be shared if one in 2 ** rate is listed."""
    return 1 if rate == 0 else math.ceil(math.log(MISS / 2) / math.log(1 - 2.0**-rate))


def rate_of(size: float, t: float) -> int:
    """The rate, as a power of two, that lists fewest grams of sets from ``size`` on; what must be shared can't exceed the overlap."""
    fit = [j for j in range(12) if need_of(j) <= t * size]
    return min(fit or [0], key=lambda j: (size - t * size + need_of(j)) * 2.0**-j)


class Sets:
    """Distinct grams of a slice of rows, in the global order."""

    def __init__(self, b: pa.RecordBatch, n: int, word_level: np.ndarray, gram_level: np.ndarray):
        row, g, which, h = grams(b, n)
        level = np.zeros(len(g), np.uint64)
        for k in range(n):
            level += word_level[(h[which[:, k]] >> U(44)).astype(np.int64)] if len(h) else U(0)
        hot = gram_level[(g >> U(44)).astype(np.int64)].astype(np.uint64)
        level = np.minimum(level, U(127)) + np.where(hot > 0, U(128) + hot, U(0))
        key = (level << U(56)) | (g >> U(8))
        o = by_row(row, key)
        row, key = row[o], key[o]
        new = np.ones(len(key), bool)
        new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
        self.row, self.key = row[new], key[new]
        self.size = np.bincount(self.row, minlength=b.num_rows)
        self.start = np.cumsum(self.size) - self.size
        with np.errstate(over="ignore"):
            s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.key))])
            self.name = mix((s[self.start + self.size] - s[self.start]) + self.size.astype(np.uint64) * A2)


@lru_cache
def least_equal(t: float) -> np.ndarray:
    """For n digest bits, how many of them are equal at least in two sets of similarity t, but for a chance of MISS / 2.

    A bit is equal with (1 + t) / 2, so the number is the greatest k with P(Binomial(n, (1 + t) / 2) < k) <= MISS / 2. Bits of large sets
    are of the least grams in parts of the hash space, whose equality is drawn without replacement, which keeps nearer to the mean.
    """
    p = (1 + t) / 2
    out = np.zeros(BINS + 1, np.int64)
    for n in range(1, BINS + 1):
        below = 0.0
        for k in range(n + 1):
            below += math.comb(n, k) * p**k * (1 - p) ** (n - k)
            if below > MISS / 2:
                out[n] = k
                break
    return out


def digests(s: Sets, t: float) -> np.ndarray:
    """Four words of 64 bits for each set: two that are compared with sets of the same kind, and two more for sets that meet both kinds.

    Sets under DIGESTED grams have a bit of the least gram under each of BINS hash functions; larger ones a bit of the least gram in each
    of BINS parts of the hash space (of the next part that holds a gram, where one holds none). Those that sets under DIGESTED may be
    similar to have both, the former last.
    """
    rows = len(s.size)
    out = np.zeros((rows, 4), np.int64)
    pack = lambda bits: np.ascontiguousarray(np.packbits(bits, 1)).view(np.int64).reshape(-1, 2)
    with np.errstate(over="ignore"):
        small = np.flatnonzero((s.size > 0) & (s.size <= DIGESTED / t + 1))
        if len(small):
            of = np.cumsum(s.size[small]) - s.size[small]
            x = mix(s.key[np.repeat(s.start[small] - of, s.size[small]) + np.arange(int(s.size[small].sum()))] ^ A1)
            bits = np.empty((len(small), BINS), bool)
            for k in range(BINS):
                y = (x ^ SEEDS[k]) * (SEEDS[k] | U(1))
                y ^= y >> U(32)
                bits[:, k] = mix(np.minimum.reduceat(y * A2, of)) & U(1)
            out[small, :2] = pack(bits)
        large = np.flatnonzero(s.size >= DIGESTED)
        if len(large):
            is_large = s.size >= DIGESTED
            nth = np.cumsum(is_large) - 1
            mine = is_large[s.row]
            h = mix(s.key[mine] * A2)
            least = np.full(len(large) * BINS, 2**64 - 1, np.uint64)
            np.minimum.at(least, nth[s.row[mine]] * BINS + (h >> U(57)).astype(np.int64), h << U(7) >> U(1))
            full = (least != U(2**64 - 1)).reshape(-1, BINS)
            bits = (least >> U(20) & U(1)).astype(bool).reshape(-1, BINS)
            twice = np.where(np.concatenate([full, full], 1), np.arange(2 * BINS), 4 * BINS)
            near = np.minimum.accumulate(twice[:, ::-1], 1)[:, ::-1][:, :BINS] % BINS
            out[large, 2:] = out[large, :2]
            out[large, :2] = pack(np.take_along_axis(bits, near, 1))
    return out


def second_names(s: Sets) -> np.ndarray:
    """A second name of each set, independent of the first."""
    with np.errstate(over="ignore"):
        x = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s.key * A2 + A1))])
        return x[s.start + s.size] - x[s.start]


def keys(batches: Iterator[pa.RecordBatch], n: int, t: float, x: int, wl: np.ndarray, gl: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (key, name, meta, d0, d1, e0, e1): meta is size << 32 | position << 6 | rate << 2 | kind; kind 0 subset, 1 entry in the lists of
    the class above, 2 in those of the set's own, 3 a member, whose key is its id; d0 to e1 are a list entry's digest, d0 a member's second name."""
    step = -math.log(t) * 1.0001
    rates = np.array([rate_of(x * math.exp(step * c), t) for c in range(64)])
    needs = np.array([need_of(j) for j in range(12)])
    for b in slices(batches, "text"):
        s = Sets(b, n, wl, gl)
        size = s.size.astype(np.int64)
        need = np.ceil(t * size - 1e-9).astype(np.int64)
        out: list[tuple[np.ndarray, ...]] = []
        pos = np.arange(len(s.row)) - s.start[s.row]
        own = np.floor(np.log(np.maximum(size, 1) / x) / step + 1e-12).astype(np.int64)  # -1 just below the boundary
        draw = mix(s.key ^ A2)
        entry = digests(s, t)
        told: list[np.ndarray] = []
        for kind in (2, 1):
            c = own + (kind == 1)
            rate = rates[np.clip(c, 0, 63)]
            prefix = np.where((c >= 0) & (size >= (x if kind == 2 else np.ceil(t * x - 1e-9))), size - need + needs[rate], 0)
            listed = np.flatnonzero(pos < prefix[s.row])
            r = s.row[listed]
            chosen = (draw[listed] >> (U(64) - rate[r].astype(np.uint64)).clip(0, 63)) == 0
            chosen |= rate[r] == 0
            listed, r = listed[chosen], r[chosen]
            with np.errstate(over="ignore"):
                key = mix((s.key[listed] ^ A1) + c[r].astype(np.uint64) * A2)
            out.append((key, s.name[r], (size[r] << 32) | (pos[listed] << 6) | (rate[r] << 2) | kind))
            told.append(entry[r])
        for k in range(1, x):
            rows = np.flatnonzero(size == k)
            if not len(rows):
                continue
            p = int(k - math.ceil(t * k - 1e-9) + 1)
            if math.ceil(t * k - 1e-9) < 2:
                m = s.key[s.start[rows][:, None] + np.arange(p)]
                out.append((mix(m ^ A2).ravel(), np.repeat(s.name[rows], p), np.full(m.size, k << 32)))
            p = min(p + 1, k)
            i, j = np.triu_indices(p, 1)
            if len(i):
                m = s.key[s.start[rows][:, None] + np.arange(p)]
                with np.errstate(over="ignore"):
                    out.append((mix(mix(m[:, i] * A1) + m[:, j]).ravel(), np.repeat(s.name[rows], len(i)), np.full(len(rows) * len(i), k << 32)))
        some = size > 0
        out.append((longs(b, "doc_id")[some].astype(np.int64).view(np.uint64), s.name[some], (size[some] << 32) | 3))
        # list and subset keys need no more bits than keep chance meetings few; a member's is its whole id
        out = [(o[0] >> U(16), *o[1:]) for o in out[:-1]] + out[-1:]
        total = sum(len(o[0]) for o in out)
        digest = np.concatenate([*told, np.zeros((total - sum(map(len, told)), 4), np.int64)])
        digest[total - int(some.sum()) :, 0] = second_names(s)[some].view(np.int64)
        columns = [signed(np.concatenate([o[0] for o in out])), signed(np.concatenate([o[1] for o in out])), pa.array(np.concatenate([o[2] for o in out])), *[pa.array(np.ascontiguousarray(digest[:, k])) for k in range(4)]]
        yield pa.record_batch(columns, ["key", "name", "meta", *DIGEST])


ENTRIES = "what int, key long, name long, meta long, many long, d0 long, d1 long, e0 long, e1 long"


def reach(key: np.ndarray, size: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """For entries sorted by list and size: how many after each are of sets not too large to be similar, and the entry's list."""
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    joint = (group << 32) | size
    return np.searchsorted(joint, (group << 32) | np.floor(size / t + 1e-9).astype(np.int64), side="right") - np.arange(len(joint)) - 1, group


def spare_of(meta: np.ndarray) -> np.ndarray:
    """Grams that a list's prefix holds beyond the first that must be shared."""
    return np.array([need_of(j) - 1 if j < 12 else 0 for j in range(16)])[(meta >> 2) & 15]


def partners(key: np.ndarray, meta: np.ndarray, digest: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Entries of one list that may be of similar sets, for entries sorted by list and size: by size, position and digest. ``tiles`` has those of long lists."""
    least_bits = int(least_equal(t)[BINS])
    size, pos = meta >> 32, (meta & 0xFFFFFFFF) >> 6
    spare, kind, digest = spare_of(meta), meta & 3, digest.view(np.uint64)
    count, group = reach(key, size, t)
    count[np.bincount(group, count)[group] > LISTED] = 0
    at, ends = 0, np.cumsum(count)
    while at < len(count):  # pairs are expanded a bounded number at a time
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 500_000, side="right")))
        c = count[at:to]
        i = np.repeat(np.arange(at, to), c)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        at = to
        ok = (kind[i] == 0) | ((kind[i] | kind[j]) >= 2)
        least = np.ceil(t / (1 + t) * (size[i] + size[j]) - 1e-9)
        ok &= (kind[i] == 0) | (np.minimum(size[i] - pos[i], size[j] - pos[j]) >= least - spare[i])
        i, j = i[ok], j[ok]
        both = ((size[i] < DIGESTED) & (size[j] >= DIGESTED))[:, None]  # size[i] is the lesser one
        unlike = np.bitwise_count(digest[i, :2] ^ np.where(both, digest[j, 2:], digest[j, :2])).sum(1, dtype=np.int64)
        ok = (kind[i] == 0) | (BINS - unlike >= least_bits)
        yield i[ok], j[ok]


def tiles(key: np.ndarray, meta: np.ndarray, digest: np.ndarray, t: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """The partners in lists of more than LISTED pairs, as (first row, first column, whether they are): the same ones as ``partners`` would
    list. Digests come first, two words a pair, as nearly all pairs of such a list share its gram by chance; the rest is for what they leave."""
    most = BINS - int(least_equal(t)[BINS])
    size, kind, spare, words = meta >> 32, meta & 3, spare_of(meta), np.ascontiguousarray(digest.view(np.uint64).T)
    room = size - ((meta & 0xFFFFFFFF) >> 6)
    count, group = reach(key, size, t)
    end = np.arange(len(key)) + 1 + count
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    xor, unlike, more = (np.empty((TILE, TILE_COLUMNS), k) for k in (np.uint64, np.uint8, np.uint8))
    for g in np.flatnonzero(np.bincount(group, count) > LISTED):
        lo, hi = int(first[g]), int(first[g + 1]) if g + 1 < len(first) else len(key)
        large = lo + int(np.searchsorted(size[lo:hi], DIGESTED))  # from there on sets have digests of the other kind
        for a, z in ((lo, large), (large, hi)):
            for r0 in range(a, z, TILE):
                r1 = min(r0 + TILE, z)
                subset = kind[r0:r1] == 0
                for c, d, w in ((r0, large, 0), (max(r0, large), hi, 2 if z == large else 0)):
                    for c0 in range(c, min(d, int(end[r1 - 1])), TILE_COLUMNS):
                        c1 = min(c0 + TILE_COLUMNS, d, int(end[r1 - 1]))
                        at = np.s_[: r1 - r0, : c1 - c0]
                        np.bitwise_count(np.bitwise_xor(words[0, r0:r1, None], words[w, None, c0:c1], out=xor[at]), out=unlike[at])
                        np.bitwise_count(np.bitwise_xor(words[1, r0:r1, None], words[w + 1, None, c0:c1], out=xor[at]), out=more[at])
                        ok = np.add(unlike[at], more[at], out=unlike[at]) <= most
                        ok[subset] = True
                        k = np.flatnonzero(ok.any(1))
                        if not len(k):
                            continue
                        i, j = np.arange(r0, r1)[k, None], np.arange(c0, c1)[None]
                        some = ok[k] & (j > i) & (j < end[i])
                        least = t / (1 + t) * (size[i] + size[j]) - 1e-9
                        some &= subset[k, None] | (((kind[i] | kind[j]) >= 2) & (least <= np.minimum(room[i], room[j]) + spare[i]))
                        if some.any():
                            ok[:] = False
                            ok[k] = some
                            yield r0, c0, ok


def scan(batches: Iterator[pa.RecordBatch], t: float) -> Iterator[pa.RecordBatch]:
    """From sorted keys, rows with what = 1 for members, and 0 for the entries that have partners in their list, and how many."""
    names = ["what", "key", "name", "meta", "many", *DIGEST]
    for b in whole_groups(batches, "key"):
        key, name, meta = longs(b, "key"), longs(b, "name"), longs(b, "meta")
        digest = np.stack([longs(b, c) for c in DIGEST], 1)
        rows = lambda what, k, many: pa.record_batch([pa.array(np.full(len(k), what, np.int32)), *[pa.array(v) for v in (key[k], name[k], meta[k], many)], *[pa.array(np.ascontiguousarray(digest[k, c])) for c in range(4)]], names)
        member = (meta & 3) == 3
        if member.any():
            k = np.flatnonzero(member)
            yield rows(1, k, np.zeros(len(k), np.int64))
        k = np.flatnonzero(~member)
        k = k[np.concatenate([[True], (key[k[1:]] != key[k[:-1]]) | (name[k[1:]] != name[k[:-1]])])[: len(k)]]
        same = key[k[1:]] == key[k[:-1]]
        k = k[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(k) > 1 else k[:0]
        if not len(k):
            continue
        k = k[np.lexsort((meta[k] >> 32, key[k]))]
        many = np.zeros(len(k), np.int64)
        for i, j in partners(key[k], meta[k], digest[k], t):
            many += np.bincount(i, minlength=len(k)) + np.bincount(j, minlength=len(k))
        for r, c, ok in tiles(key[k], meta[k], digest[k], t):
            many[r : r + len(ok)] += np.count_nonzero(ok, 1)
            many[c : c + ok.shape[1]] += np.count_nonzero(ok, 0)
        if many.any():
            yield rows(0, k[many > 0], many[many > 0])


def unit_pairs(batches: Iterator[pa.RecordBatch], t: float) -> Iterator[pa.RecordBatch]:
    """Pairs of units (a <= b) of which sets are partners in a list."""
    for b in whole_groups(batches, "key"):
        key, meta, unit, digest = longs(b, "key"), longs(b, "meta"), longs(b, "unit"), np.stack([longs(b, c) for c in DIGEST], 1)
        o = np.lexsort((meta >> 32, key))
        ids, unit = np.unique(unit[o], return_inverse=True)
        key, meta, digest = key[o], meta[o], digest[o]
        seen = np.zeros(0, np.int64)
        for i, j in partners(key, meta, digest, t):
            x = np.unique(np.minimum(unit[i], unit[j]) * len(ids) + np.maximum(unit[i], unit[j]))
            seen = np.union1d(seen, x)
        known, local, marks = None, unit, np.zeros((0, 0), bool)
        for r, c, ok in tiles(key, meta, digest, t):
            if known != key[r]:  # another list, whose units get numbers of their own
                known = key[r]
                lo, hi = np.searchsorted(key, known, side="left"), np.searchsorted(key, known, side="right")
                kinds, own = np.unique(unit[lo:hi], return_inverse=True)
                local = np.zeros(len(o), np.int64)
                local[lo:hi] = own
                marks = np.zeros((len(kinds), len(kinds)) if len(kinds) <= MARKED else (0, 0), bool)
            if len(marks):
                ok &= ~marks[local[r : r + len(ok), None], local[None, c : c + ok.shape[1]]]
            i, j = np.nonzero(ok)
            if len(i):
                i, j = i + r, j + c
                if len(marks):
                    marks[local[i], local[j]] = marks[local[j], local[i]] = True
                seen = np.union1d(seen, np.minimum(unit[i], unit[j]) * len(ids) + np.maximum(unit[i], unit[j]))
        if len(seen):
            yield pa.record_batch([pa.array(ids[seen // len(ids)]), pa.array(ids[seen % len(ids)])], ["a", "b"])


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """How many grams each set of a shares with each of b, some rows of a at a time: (first row, counts).

    Grams that many sets hold are bits of a word, counted 64 at once; for the others pairs of sets are listed.
    """
    na, nb = len(a), len(b)
    size = np.array([len(x) for x in a] + [len(x) for x in b])
    _, gram = np.unique(np.concatenate(a + b), return_inverse=True)
    gram, owner = gram.astype(np.int64), np.repeat(np.arange(na + nb), size)
    in_a = np.bincount(gram[owner < na], minlength=int(gram.max()) + 1)
    in_b = np.bincount(gram[owner >= na], minlength=len(in_a))
    dense = in_a * in_b * 32 > na * nb
    column = np.cumsum(dense) - 1
    bits = np.zeros((-(-int(dense.sum()) // 64) or 1, na + nb), np.uint64)
    on = dense[gram]
    c = column[gram[on]]
    np.bitwise_or.at(bits, (c >> 6, owner[on]), U(1) << (c & 63).astype(np.uint64))
    rare = ~on & ((in_a > 0) & (in_b > 0))[gram]
    left, right = rare & (owner < na), rare & (owner >= na)
    lg, lo = gram[left], owner[left]
    o = np.argsort(gram[right], kind="stable")
    rg, ro = gram[right][o], owner[right][o] - na
    begin, end = np.searchsorted(rg, lg, side="left"), np.searchsorted(rg, lg, side="right")
    step = max(1, 200_000 // nb)
    for at in range(0, na, step):
        to = min(at + step, na)
        n = np.zeros((to - at, nb), np.int64)
        for w in bits:
            n += np.bitwise_count(w[at:to, None] & w[None, na:])
        p, q = np.searchsorted(lo, [at, to])
        k = end[p:q] - begin[p:q]
        if k.sum():
            j = ro[np.repeat(begin[p:q], k) + np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)]
            n += np.bincount(np.repeat(lo[p:q] - at, k) * nb + j, minlength=n.size).reshape(n.shape)
        yield at, n


def merged(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least member of each one's group after x[k] and y[k] are joined."""
    while True:
        rx, ry = root[x], root[y]
        apart = rx != ry
        if not apart.any():
            return root
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while (root != root[root]).any():
            root = root[root]


def connect(sets: list[np.ndarray], xs: np.ndarray, ys: np.ndarray, t: float, each: Callable[[np.ndarray, np.ndarray, np.ndarray], None], root: Callable[[], np.ndarray]) -> None:
    """Gives ``each`` similar pairs of xs and ys until all that chains of such pairs connect are: pairs that are connected already aren't compared.

    One set, then twice as many each time, are compared with those that aren't in their group, so alike sets take a look or two each;
    what lies apart from the largest group is compared with all.
    """
    xs = np.roll(xs, -(len(xs) // 2))  # a set of middle size first
    at, step = 0, 1
    while at < len(xs):
        x = xs[at : at + step]
        at, step = at + len(x), step * 2
        now = root()
        main = int(np.bincount(now[np.concatenate([xs, ys])]).argmax())
        if (now[xs] == main).all() and (now[ys] == main).all():
            return
        for rows, within in ((x[now[x] == main], True), (x[now[x] != main], False)):
            now = root()
            columns = ys[now[ys] != now[rows[0]]] if len(rows) and (within or len(rows) == 1) else ys
            if not len(rows) or not len(columns):
                continue
            size = np.array([len(sets[k]) for k in columns])
            for r, n in overlaps([sets[k] for k in rows], [sets[k] for k in columns]):
                sx = np.array([len(sets[k]) for k in rows[r : r + len(n)]])[:, None]
                k, m = np.nonzero(n >= t / (1 + t) * (sx + size) - 1e-6)
                j = n[k, m] / (sx[k, 0] + size[m] - n[k, m])
                ok = j >= t
                each(rows[r + k[ok]], columns[m[ok]], j[ok])


def similar(b: pa.RecordBatch, t: float, each: Callable[[np.ndarray, np.ndarray, np.ndarray], None], start: Callable[[np.ndarray, np.ndarray], None], root: Callable[[], np.ndarray] | None = None) -> Iterator[None]:
    """Verifies the unit pairs of whole meetings; for every meeting ``start`` gets its sets' names and copies, then ``each`` similar pairs
    (by number) with their similarity. With ``root``, the groups so far, it gets as many pairs as connect the sets, as in ``connect``."""
    meet, ua, ub, name, copies = (longs(b, c) for c in ("meet", "a", "b", "name", "copies"))
    g = col(b, "grams")
    is_set = g.is_valid().to_numpy(zero_copy_only=False)
    off, val = g.offsets.to_numpy(), g.values.to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.concatenate([[True], meet[1:] != meet[:-1], [True]]))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        at = lo + np.flatnonzero(is_set[lo:hi])
        at = at[np.unique(name[at], return_index=True)[1]]  # repeated rows of an id
        size = off[at + 1] - off[at]
        at = at[np.lexsort((size, ua[at]))]
        size, sets = off[at + 1] - off[at], [val[off[i] : off[i + 1]] for i in at]
        unit, first = np.unique(ua[at], return_index=True)
        last = np.append(first[1:], len(at))
        start(name[at], copies[at])
        for i in lo + np.flatnonzero(~is_set[lo:hi]):
            u, v = np.searchsorted(unit, [ua[i], ub[i]])
            x0, x1, y0, y1 = first[u], last[u], first[v], last[v]
            if (x1 - x0) * (y1 - y0) <= 4:
                for x in range(x0, x1):
                    for y in range(max(y0, x + 1) if u == v else y0, y1):
                        p, q = (sets[x], sets[y]) if size[x] <= size[y] else (sets[y], sets[x])
                        if len(p) >= t * len(q) - 1e-9:
                            inter = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                            j = inter / (len(p) + len(q) - inter)
                            if j >= t:
                                each(np.array([x]), np.array([y]), np.array([j]))
                continue
            if root is not None:
                connect(sets, np.arange(x0, x1), np.arange(y0, y1), t, each, root)
                continue
            for r, n in overlaps(sets[x0:x1], sets[y0:y1]):
                sx, sy = size[x0 + r : x0 + r + len(n), None], size[None, y0:y1]
                k, m = np.nonzero(n >= t / (1 + t) * (sx + sy) - 1e-6)
                n, x, y = n[k, m], x0 + r + k, y0 + m
                j = n / (size[x] + size[y] - n)
                ok = (j >= t) & ((x < y) | (u != v))
                each(x[ok], y[ok], j[ok])
        yield


def verify(batches: Iterator[pa.RecordBatch], t: float) -> Iterator[pa.RecordBatch]:
    """Similar pairs of sets."""
    now: list[np.ndarray] = []
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for b in whole_groups(batches, "meet"):
        for _ in similar(b, t, lambda x, y, j: out.append((now[0][x], now[0][y], j)), lambda names, _: now.__setitem__(slice(None), [names])):
            for x, y, j in out:
                yield pa.record_batch([pa.array(x), pa.array(y), pa.array(j)], ["a", "b", "jaccard"])
            out.clear()


def linked(batches: Iterator[pa.RecordBatch], t: float) -> Iterator[pa.RecordBatch]:
    """For each set with a similar one: how many documents those are, and a set of its group, in place of the pairs."""

    class Meeting:
        def start(self, names: np.ndarray, copies: np.ndarray) -> None:
            self.names, self.copies, self.n, self.root = names, copies, np.zeros(len(names), np.int64), np.arange(len(names))

        def each(self, x: np.ndarray, y: np.ndarray, _: np.ndarray) -> None:
            self.n += np.bincount(x, self.copies[y], len(self.n)).astype(np.int64) + np.bincount(y, self.copies[x], len(self.n)).astype(np.int64)
            self.root = merged(self.root, x, y)

    m = Meeting()
    for b in whole_groups(batches, "meet"):
        for _ in similar(b, t, m.each, m.start):
            some = m.n > 0
            if some.any():
                yield pa.record_batch([pa.array(m.names[some]), pa.array(m.names[m.root[some]]), pa.array(m.n[some])], ["a", "b", "n"])


def connected(batches: Iterator[pa.RecordBatch], t: float) -> Iterator[pa.RecordBatch]:
    """For each set that is connected to one of a lesser number in its meeting: the least such set. Fewer comparisons than ``linked``, the same groups."""
    names, root = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def start(of: np.ndarray, _: np.ndarray) -> None:
        nonlocal names, root
        names, root = of, np.arange(len(of))

    def each(x: np.ndarray, y: np.ndarray, _: np.ndarray) -> None:
        nonlocal root
        root = merged(root, x, y)

    for b in whole_groups(batches, "meet"):
        for _ in similar(b, t, each, start, lambda: root):
            some = root != np.arange(len(root))
            if some.any():
                yield pa.record_batch([pa.array(names[some]), pa.array(names[root[some]])], ["a", "b"])


def by_id(docs: DataFrame, ids: DataFrame, how: str = "inner", weight: str = "1") -> DataFrame:
    """Join on doc_id; ``ids`` is broadcast up to BROADCAST_ROWS rows (or entries of an array, in ``weight``), beyond that both sides are shuffled."""
    small = (ids.agg(F.sum(F.expr(weight))).first()[0] or 0) <= BROADCAST_ROWS
    return docs.join(F.broadcast(ids) if small else ids.hint("merge"), "doc_id", how)


def meetings(docs: DataFrame, n: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Unit pairs to verify with the sets they need, those that go together sorted by meeting; and (doc_id, name, times, rep, copies), every
    id that has words with its set, number of rows, and the set's least id and number of ids."""
    t = threshold
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    wc, gc = sketch(docs, n)
    x, wl, gl = boundary(gc, t), levels(wc, 2.0, 1.0), levels(gc, 4.0, 1.0)
    rows = docs.mapInArrow(lambda bs: keys(bs, n, t, x, wl, gl), "key long, name long, meta long, d0 long, d1 long, e0 long, e1 long")
    found = stash(rows.repartition("key").sortWithinPartitions("key", "name").mapInArrow(lambda bs: scan(bs, t), ENTRIES), "entries")
    members = found.where("what = 1").groupBy(F.col("key").alias("doc_id"), "name").agg(F.count("*").alias("times"), F.min("d0").alias("second"))
    # sets of one name are equal if their second names are, too; all others stand for themselves
    reps = members.groupBy("name", "second").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    members = stash(members.join(reps, ["name", "second"]).select("doc_id", "name", "times", "rep", "copies"), "members")

    entries = found.where("what = 0")
    picked = entries.groupBy("name").agg(F.max(F.struct("many", "key")).alias("m"), F.max(F.shiftright("meta", 32)).alias("grams")).select("name", "grams", F.col("m.key").alias("list"))
    picked = stash(picked, "picked", slim=True)
    ways = picked.groupBy("list").agg(F.ceil(F.sum("grams") / UNIT_GRAMS).cast("long").alias("ways"))
    units = stash(picked.join(ways, "list").select("name", "grams", F.xxhash64("list", F.pmod(F.xxhash64("name"), F.col("ways"))).alias("unit")), "units", slim=True)
    pairs = entries.join(units.select("name", "unit"), "name").select("key", "unit", "meta", *DIGEST)
    pairs = stash(pairs.repartition("key").sortWithinPartitions("key").mapInArrow(lambda bs: unit_pairs(bs, t), "a long, b long").distinct(), "pairs", slim=True)

    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label"))
    # once more over the neighbours: in a group whose pairs are not all similar, nearly all now have one label
    label = both.join(label.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("label").alias("label"))
    heavy = units.groupBy("unit").agg(F.sum("grams").alias("grams"))
    per = pairs.join(label, "a").select("label", "a", "b")
    load = per.select("label", F.explode(F.array("a", "b")).alias("unit")).distinct().join(heavy, "unit").groupBy("label").agg(F.ceil(F.sum("grams") / MEETING_GRAMS).cast("long").alias("ways"))
    meet = F.xxhash64("label", F.pmod(F.xxhash64("b"), F.col("ways")))
    per = stash(per.join(load, "label").select(meet.alias("meet"), "a", "b"), "meetings", slim=True)
    wanted = per.select("meet", F.explode(F.array("a", "b")).alias("unit")).distinct()
    who = members.where("doc_id = rep").select("name", "doc_id", "copies")
    wanted = wanted.groupBy("unit").agg(F.collect_list("meet").alias("meets")).join(units, "unit").join(who, "name").select("doc_id", "name", "unit", "copies", "meets")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", MAX_BYTES // 2):
            s = Sets(b, n, wl, gl)
            name, unit, copies, meets = longs(b, "name"), longs(b, "unit"), longs(b, "copies"), col(b, "meets")
            off, val = meets.offsets.to_numpy(), meets.values.to_numpy(zero_copy_only=False)
            times = np.where(s.name.view(np.int64) == name, np.diff(off), 0)
            who = np.repeat(np.arange(b.num_rows), times)
            for at in range(0, len(who), 512):
                r = who[at : at + 512]
                k = np.arange(at, at + len(r)) - np.repeat(np.cumsum(times) - times, times)[at : at + 512]
                values = np.concatenate([np.sort(s.key[s.start[i] : s.start[i] + s.size[i]].view(np.int64)) for i in r])
                yield pa.record_batch([pa.array(val[off[r] + k]), pa.array(unit[r]), pa.nulls(len(r), pa.int64()), pa.array(name[r]), pa.array(copies[r]), list_of(values, s.size[r], pa.int64())], ["meet", "a", "b", "name", "copies", "grams"])

    shape = "meet long, a long, b long, name long, copies long, grams array<long>"
    sets = by_id(docs, stash(wanted, "wanted", slim=True), weight="size(meets)").mapInArrow(fetch, shape)
    none = [F.lit(None).cast(k).alias(c) for c, k in (("name", "long"), ("copies", "long"), ("grams", "array<long>"))]
    return sets.unionByName(per.select("*", *none)).repartition("meet").sortWithinPartitions("meet"), members


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """Similar pairs (``doc_id_a, doc_id_b, jaccard``): equal sets are a star (smallest id, other id, 1.0), and a pair of different sets is there
    once, between their smallest ids. As many rows as there are pairs of different sets; ``links`` has as many as documents."""
    work, members = meetings(docs, n, threshold)
    reps = members.where("doc_id = rep").select("name", "rep")
    checked = work.mapInArrow(lambda bs: verify(bs, threshold), "a long, b long, jaccard double")
    ra, rb = (reps.select(F.col("name").alias(k), F.col("rep").alias(f"r{k}")) for k in "ab")
    near = checked.join(ra, "a").join(rb, "b").select(F.least("ra", "rb").alias("doc_id_a"), F.greatest("ra", "rb").alias("doc_id_b"), "jaccard")
    same = members.where("doc_id <> rep").select(F.col("rep").alias("doc_id_a"), F.col("doc_id").alias("doc_id_b"), F.lit(1.0).alias("jaccard")).distinct()
    return near.where("doc_id_a <> doc_id_b").unionByName(same)


def classes(docs: DataFrame, n: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, group) of ids that have a partner, as ``components`` has them; (name, n) of sets that have one of another set; and members."""
    work, members = meetings(docs, n, threshold)
    found = stash(work.mapInArrow(lambda bs: linked(bs, threshold), "a long, b long, n long"), "links", slim=True)
    return groups_of(found, members), found.groupBy(F.col("a").alias("name")).agg(F.sum("n").alias("n")), members


def groups_of(found: DataFrame, members: DataFrame) -> DataFrame:
    """``components`` of the ids of sets that are linked (a, b), and of ids of equal sets."""
    reps = members.where("doc_id = rep").select("name", "rep")
    ra, rb = (reps.select(F.col("name").alias(k), F.col("rep").alias(f"doc_id_{k}")) for k in "ab")
    near = found.where("a <> b").join(ra, "a").join(rb, "b").select("doc_id_a", "doc_id_b").where("doc_id_a <> doc_id_b")
    edges = near.unionByName(members.where("doc_id <> rep").select(F.col("rep").alias("doc_id_a"), F.col("doc_id").alias("doc_id_b")))
    return components(edges)


def links(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """Every document with its class and number of links; see the module's docstring."""
    groups, near, members = classes(docs, n, threshold)
    count = members.join(near, "name", "left").groupBy("doc_id").agg(F.sum(F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    return ids.join(count, "doc_id", "left").join(groups, "doc_id", "left").select("doc_id", F.coalesce("group", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def components(pairs: DataFrame) -> DataFrame:
    """(doc_id, group) with the smallest id of each connected component, for ids that have a partner: alternating large and small stars."""
    edges = stash(pairs.select(F.greatest("doc_id_a", "doc_id_b").alias("u"), F.least("doc_id_a", "doc_id_b").alias("v")).distinct(), "edges", slim=True)
    was, whole = None, edges
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        edges = edges.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        before, edges = whole, stash(edges, "edges", slim=True)
        forget(before)
        whole = edges
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 998_244_353)).first()
        if now == was:
            break
        was = now
    return edges.groupBy("u").agg(F.min("v").alias("group")).select(F.col("u").alias("doc_id"), "group")


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """Documents without all but the smallest id of each group of similar ones; of several rows of an id one stays.

    Rows without an id or without words stay as they are, so that null and empty texts are nobody's copies; an empty table stays empty.
    """
    mark = stashed()
    work, members = meetings(docs, n, threshold)
    found = stash(work.mapInArrow(lambda bs: connected(bs, threshold), "a long, b long"), "links", slim=True)
    groups = groups_of(found, members)
    gone = stash(groups.where("doc_id <> group").select("doc_id"), "gone", slim=True)
    again = stash(members.groupBy("doc_id").agg(F.sum("times").alias("times")).where("times > 1").select("doc_id"), "again", slim=True)
    forget_since(mark, gone, again)
    kept = by_id(docs, gone, "left_anti")
    if again.isEmpty():
        return kept
    rows = by_id(docs, again, "left_semi").join(gone, "doc_id", "left_anti")
    return by_id(kept, again, "left_anti").unionByName(rows.dropDuplicates(["doc_id"]).select(*kept.columns))


PAIRS_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x00-/:-@\[-`{-\x7f]+') AS w FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END)) AS g
      FROM w WHERE len(w) > 0),
s AS (SELECT g, min(doc_id) AS rep, len(g) AS size FROM g GROUP BY g),
same AS (SELECT DISTINCT s.rep AS doc_id_a, g.doc_id AS doc_id_b, 1.0::DOUBLE AS jaccard FROM g JOIN s USING (g) WHERE g.doc_id <> s.rep),
e AS (SELECT rep, size, unnest(g) AS x FROM s),
o AS (SELECT a.rep AS ra, b.rep AS rb, a.size AS sa, b.size AS sb, count(*) AS o FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep
      AND a.size >= 0.7 * b.size AND b.size >= 0.7 * a.size GROUP BY ALL)
SELECT ra AS doc_id_a, rb AS doc_id_b, o / (sa + sb - o)::DOUBLE AS jaccard FROM o WHERE o / (sa + sb - o)::DOUBLE >= 0.7
UNION ALL SELECT * FROM same
"""

LINKS_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x00-/:-@\[-`{-\x7f]+') AS w FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT DISTINCT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END)) AS g
      FROM w WHERE len(w) > 0),
s AS (SELECT g, min(doc_id) AS rep, len(g) AS size, count(*) AS copies FROM g GROUP BY g),
m AS (SELECT g.doc_id, s.rep, s.copies FROM g JOIN s USING (g)),
e AS (SELECT rep, size, unnest(g) AS x FROM s),
o AS (SELECT a.rep AS ra, b.rep AS rb, a.size AS sa, b.size AS sb, count(*) AS o FROM e a JOIN e b ON a.x = b.x AND a.rep <> b.rep
      AND a.size >= 0.7 * b.size AND b.size >= 0.7 * a.size GROUP BY ALL),
near AS (SELECT ra, rb FROM o WHERE o / (sa + sb - o)::DOUBLE >= 0.7),
n AS (SELECT ra AS rep, sum(s.copies) AS n FROM near JOIN s ON s.rep = rb GROUP BY ra),
step AS (SELECT ra, rb FROM near UNION SELECT a.rep, b.rep FROM m a JOIN m b USING (doc_id) WHERE a.rep <> b.rep),
reach AS (SELECT DISTINCT rep AS a, rep AS b FROM s UNION SELECT reach.a, step.rb FROM reach JOIN step ON step.ra = reach.b),
c AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(min(c.class_id), d.doc_id)::BIGINT AS class_id, coalesce(sum(m.copies - 1 + coalesce(n.n, 0)), 0)::BIGINT AS n_links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN m USING (doc_id) LEFT JOIN c ON c.rep = m.rep LEFT JOIN n ON n.rep = m.rep
GROUP BY d.doc_id
"""
