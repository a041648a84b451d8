"""Operator 2: mixing sources to target weights by subset-sum budget fitting.

Each source has a token budget, its weight's share of ``total``. Documents are counted by source and exact token length; the rest
is arithmetic on those counts. A source over its budget first takes the same fraction of every length, rounded down, then single
documents, longest first, until what is left is near ``WINDOW``. A bounded knapsack over the counts not yet taken (dynamic programming
on a bit set, counts split in powers of two) fills what is left exactly or, where no set of documents does, as far as can be;
while that leaves a gap, the window is doubled by giving documents back, up to the whole source or ``WIDEST`` tokens, from where on a
gap is left as it is. Within a source and length the documents of least seeded hash of id and text are selected; ties are rows with
equal id and text, of which as many are taken as are needed. The greatest hash taken is found by a histogram of hashes, then within
one bucket of it, so no group is sorted whole and no text moves.

Tokens are runs of characters other than white space, or ``n_tokens`` of a given column expression. Sources without a weight
get none if weights are given; by default all sources get equal weights. ``total`` is a token count or, below 1, a share of all
tokens. A source with less than its budget gives all it has. Null sources share a budget with a source named ''; documents without
tokens, null or empty, are never selected; repeated rows are separate documents; very long texts are counted whole; an empty table
gives an empty result. Result: ``doc_id, source, n_tokens``, or the columns that are asked for, as they are, and ``n_tokens``, with an
underscore where the table has a column of that name. Columns of the table named like the operator's own working columns are not
disturbed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, forget_since, longs, stash, stashed

WINDOW, WIDEST = 1 << 15, 1 << 22
#: Leading bits of a hash by which documents of a source and length are counted.
BUCKET_BITS = 12
SEED = 17
#: Rows of (source, length, documents to take) that a join may broadcast.
BROADCAST_ROWS = 500_000


def knapsack(length: np.ndarray, count: np.ndarray, room: int) -> np.ndarray:
    """How many of each length make the largest sum up to ``room``; the first found among equals."""
    items: list[tuple[int, int]] = []
    for k in range(len(length)):
        n, part = int(min(count[k], room // length[k])), 1
        while n > 0:
            part = min(part, n)
            items.append((k, part))
            n -= part
            part *= 2
    mask, reach = (1 << (room + 1)) - 1, [1]
    for k, n in items:
        now = reach[-1]
        reach.append((now | (now << (int(length[k]) * n))) & mask)
        if reach[-1] >> room & 1:
            break
    at = reach[-1].bit_length() - 1
    out = np.zeros(len(length), np.int64)
    for i in range(len(reach) - 1, 0, -1):
        if not reach[i - 1] >> at & 1:
            k, n = items[i - 1]
            out[k] += n
            at -= int(length[k]) * n
    return out


def take(length: np.ndarray, count: np.ndarray, budget: int, window: int = WINDOW) -> np.ndarray:
    """Documents of each length whose tokens come nearest to ``budget`` from below."""
    length, count = length.astype(np.int64), count.astype(np.int64)
    whole = int((length * count).sum())
    if whole <= budget:
        return count.copy()
    budget -= budget % int(np.gcd.reduce(length))  # no sum lies between
    o = np.argsort(-length, kind="stable")
    length, count = length[o], count[o]
    out = np.array([int(c) * budget // whole for c in count], np.int64)
    left = budget - int((length * out).sum())
    for k in range(len(length)):
        n = int(min(count[k] - out[k], max(0, left - window) // length[k]))
        out[k] += n
        left -= n * int(length[k])
    while True:
        add = knapsack(length, count - out, left)
        gap = left - int((length * add).sum())
        if gap == 0 or not out.any() or left >= WIDEST:
            break
        more = max(2 * left, window)
        for k in range(len(length) - 1, -1, -1):  # short documents first: they fit best
            n = int(min(out[k], -(-max(0, more - left) // length[k])))
            out[k] -= n
            left += n * int(length[k])
    result = np.zeros(len(o), np.int64)
    result[o] = out + add
    return result


def fit(docs: DataFrame, weights: dict[str, float] | None = None, total: float = 0.5, n_tokens: Column | None = None, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """Selected documents; ``keep`` names columns of ``docs`` to return as they are, in place of ``doc_id`` and ``source``."""
    mark = stashed()
    tokens = n_tokens if n_tokens is not None else F.regexp_count(F.col("text").cast("string"), F.lit(r"\S+"))
    own = [  # a decision rests on these alone, so that rows needn't move
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce(tokens.cast("long"), F.lit(0)).alias("n"),
        F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit(seed)).alias("h"),
    ]
    if keep is None:
        row = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"))
        rows = stash(docs.select(row.alias("row"), F.struct(*own).alias("own")).where("own.n > 0"), "lengths")
        numbers = rows
    else:
        rows = docs.select(F.struct(*keep).alias("row"), F.struct(*own).alias("own")).where("own.n > 0")
        numbers = stash(docs.select(F.struct(*own).alias("own")).where("own.n > 0"), "lengths")
    # the histogram of hashes gives the counts too; its last BUCKET_BITS make no group larger than 2 ** BUCKET_BITS rows
    bucket = F.shiftrightunsigned("own.h", 64 - BUCKET_BITS)
    hist = stash(numbers.groupBy(F.col("own.source").alias("source"), F.col("own.n").alias("n"), bucket.alias("bucket")).count(), "hashes", slim=True)
    counts = hist.groupBy("source", "n").agg(F.sum("count").alias("count"))
    by = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("count")).alias("has"))
    if weights is None:
        share = F.lit(1.0)
    else:
        share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in (str(kv[0]), float(kv[1]))]), F.col("source")), F.lit(0.0)) if weights else F.lit(0.0)
    by = by.withColumn("share", share)
    sums = by.agg(F.sum("has").alias("all"), F.sum("share").alias("shares"))
    goal = F.when(F.lit(total < 1), F.col("all") * F.lit(float(total))).otherwise(F.lit(float(total)))
    budget = F.when(F.col("shares") > 0, F.floor(goal * F.col("share") / F.col("shares"))).otherwise(F.lit(0)).cast("long")
    by = by.crossJoin(F.broadcast(sums)).select("source", budget.alias("budget"))  # sums is one row

    def solve(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("n").combine_chunks().to_batches()
        for b in t:
            n = take(longs(b, "n"), longs(b, "count"), int(longs(b, "budget")[0]))
            some = n > 0
            yield pa.record_batch([col(b, "source").filter(pa.array(some)), col(b, "n").filter(pa.array(some)), pa.array(n[some])], ["source", "n", "take"])

    plan = stash(counts.join(by, "source").select("source", "n", "count", "budget").groupBy("source").applyInArrow(solve, "source string, n long, take long"), "takes", slim=True)
    # the bucket in which a group's last document lies, and how many of that bucket are taken
    order = Window.partitionBy("source", "n").orderBy("bucket")
    upto = hist.join(plan, ["source", "n"]).withColumn("upto", F.sum("count").over(order))
    last = stash(upto.where("upto >= take and upto - count < take").select("source", "n", "bucket", F.expr("take - upto + count").alias("rest"), (F.col("upto") == F.col("take")).alias("whole")), "buckets", slim=True)
    small = last.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    sent = F.broadcast if small else lambda df: df
    part = last.where("not whole").select("source", "n", "bucket", "rest")
    inside = numbers.select("own.source", "own.n", "own.h").withColumn("bucket", F.shiftrightunsigned("h", 64 - BUCKET_BITS)).join(sent(part), ["source", "n", "bucket"])
    ties = inside.groupBy("source", "n", "h", "rest").count()
    ties = ties.withColumn("upto", F.sum("count").over(Window.partitionBy("source", "n").orderBy("h"))).where("upto >= rest and upto - count < rest")
    cut = stash(ties.select("source", "n", "h", F.expr("rest - upto + count").alias("equal"), (F.col("upto") > F.col("rest")).alias("tied")), "cuts", slim=True)
    # the greatest hash that is taken: that of the last document, or the bucket's end
    end = F.shiftleft("bucket", 64 - BUCKET_BITS).bitwiseOR(F.lit((1 << (64 - BUCKET_BITS)) - 1))
    cut = last.join(cut, ["source", "n"], "left").select("source", "n", F.coalesce("h", end).alias("cut"), F.coalesce("equal", F.lit(0)).alias("equal"), F.coalesce("tied", F.lit(False)).alias("tied"))
    cut = stash(cut, "limits", slim=True)
    forget_since(mark, cut, rows)
    least = F.lit(-(2**63))  # hashes in order as unsigned numbers
    joined = rows.join(sent(cut), [F.col("own.source") == cut["source"], F.col("own.n") == cut["n"]])
    before, at = F.col("own.h").bitwiseXOR(least) < F.col("cut").bitwiseXOR(least), F.col("own.h") == F.col("cut")
    chosen = joined.where(before | (at & ~F.col("tied"))).select("row", "own.n")
    if not cut.where("tied").isEmpty():  # rows that are equal in id and text: any of them will do
        rank = F.row_number().over(Window.partitionBy("own.source", "own.n").orderBy("row"))
        chosen = chosen.unionByName(joined.where(at & F.col("tied")).withColumn("_rank", rank).where("_rank <= equal").select("row", "own.n"))
    name = "n_tokens"
    while name in (keep or ()):
        name += "_"
    return chosen.select(*[F.col("row").getField(c).alias(c) for c in (keep if keep is not None else ["doc_id", "source"])], F.col("n").alias(name))
