"""Operator 4: token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are kept as a sum of committed batches. A batch is a set of deltas,

    op (insert, delete, revise), source, lang, tokenizer, n_tokens, old_tokens

and adds up to signed rows: an insert +1 document and +n_tokens, a delete -1 and -n_tokens, a revision no document and
n_tokens - old_tokens. Only these sums are stored, one folder for a batch; a batch counts once its ``_SUCCESS`` is there. A batch id
commits once: another commit of it changes nothing, and one that was broken off is written anew. ``totals`` sums the committed
batches, and groups that are back at nothing vanish; ``compact`` sums them into a snapshot that stands for them. Sums are additive, so batches may come in any
order.

Null sources and languages are groups of their own; null counts are 0; deltas with another op are refused when they are added up
(``ValueError`` before anything is written); repeated rows count each, ties don't arise; empty batches (an empty table) commit and add
nothing; other columns are not read. Texts are counted whole, whatever their length.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, slices

KEYS = ("source", "lang", "tokenizer")
SHAPE = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
#: Token patterns that Spark and other SQL engines count alike.
PATTERNS = {"words-1": r"[^ \t\n\r\f]+", "pieces-1": r"[A-Za-z]+|[0-9]|[^ \t\n\r\fA-Za-z0-9]"}


class Rollup:
    """Totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, p: str) -> object:
        return self.spark._jvm.org.apache.hadoop.fs.Path(p)

    def _folder(self, batch: str) -> str:
        return f"{self.path}/batch-{hashlib.sha256(batch.encode()).hexdigest()[:32]}"

    def _exists(self, p: str) -> bool:
        return self._fs.exists(self._path(p))

    def _snapshots(self) -> list[tuple[int, str, set[str]]]:
        """Number of batches, folder and batches of every whole snapshot, the one that stands for most of them last."""
        out = []
        for p in self._folders("snapshot-"):
            if self._exists(f"{p}.covers"):
                names = {r[0] for r in self.spark.read.text(f"{p}.covers").collect()}
                out.append((len(names), p, names))
        return sorted(out, key=lambda x: x[:2])

    def _covers(self) -> tuple[str | None, set[str]]:
        """The snapshot that is read and the batches in it. Batches only come, so of two snapshots one holds all that the other does."""
        found = self._snapshots()
        return found[-1][1:] if found else (None, set())

    def _folders(self, prefix: str) -> list[str]:
        if not self._exists(self.path):
            return []
        return [s.getPath().toString() for s in self._fs.listStatus(self._path(self.path)) if s.isDirectory() and s.getPath().getName().startswith(prefix)]

    def committed(self, batch: str) -> bool:
        folder = self._folder(batch)
        return self._exists(f"{folder}/_SUCCESS") or folder.rpartition("/")[2] in self._covers()[1]

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add a batch; False if it was committed before."""
        if self.committed(batch):
            return False
        if not deltas.where("op is null or op not in ('insert', 'delete', 'revise')").isEmpty():
            raise ValueError(f"batch {batch} has deltas that are no insert, delete or revision")
        new, old = F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)), F.coalesce(F.col("old_tokens").cast("long"), F.lit(0))
        docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0).cast("long")
        tokens = F.when(F.col("op") == "insert", new).when(F.col("op") == "delete", -new).otherwise(new - old)
        rows = deltas.select(*[F.col(k).cast("string").alias(k) for k in KEYS], docs.alias("d"), tokens.alias("t"))
        sums = rows.groupBy(*KEYS).agg(F.sum("d").alias("n_docs"), F.sum("t").alias("n_tokens"))
        sums.coalesce(1).write.mode("overwrite").parquet(self._folder(batch))
        return True

    def _parts(self) -> tuple[list[str], list[str]]:
        """Folders that add up to the totals, and the names of all batches in them."""
        snapshot, covered = self._covers()
        fresh = [p for p in self._folders("batch-") if p.rpartition("/")[2] not in covered and self._exists(f"{p}/_SUCCESS")]
        return [snapshot] * bool(snapshot) + fresh, sorted(covered | {p.rpartition("/")[2] for p in fresh})

    def _sum(self, paths: list[str]) -> DataFrame:
        rows = self.spark.read.schema(SHAPE).parquet(*paths) if paths else self.spark.createDataFrame([], SHAPE)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        return self._sum(self._parts()[0])

    def compact(self) -> None:
        """Write a snapshot of all committed batches. It counts once its list of them is there; a run that breaks off changes nothing.

        What is summed is what was listed: a batch that is committed meanwhile stays a batch. Runs at the same time make snapshots of
        their own names, of which the one with most batches is read.
        """
        paths, names = self._parts()
        if len(paths) < 2:
            return
        folder = f"{self.path}/snapshot-{uuid.uuid4().hex}"
        self._sum(paths).coalesce(1).write.parquet(folder)
        out = self._fs.create(self._path(f"{folder}.list"))
        out.write(bytearray("\n".join(names).encode()))
        out.close()
        self._fs.rename(self._path(f"{folder}.list"), self._path(f"{folder}.covers"))

    def vacuum(self) -> None:
        """Delete what the snapshot that is read replaces; not while totals that were asked for before are still being read."""
        found = self._snapshots()
        if not found:
            return
        _, snapshot, covered = found[-1]
        for p in self._folders("batch-"):
            if p.rpartition("/")[2] in covered:
                self._fs.delete(self._path(p), True)
        for _, p, names in found:
            if p != snapshot and names <= covered:
                self._fs.delete(self._path(f"{p}.covers"), False)
                self._fs.delete(self._path(p), True)


def pattern_tokens(docs: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """A row (doc_id, source, lang, tokenizer, n_tokens) for each document and pattern, counted in one pass."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    each = F.array(*[F.struct(F.lit(k).alias("tokenizer"), F.regexp_count(text, F.lit(p)).cast("long").alias("n_tokens")) for k, p in (patterns or PATTERNS).items()])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.inline(each))


def bpe_tokens(docs: DataFrame, path: str, version: str) -> DataFrame:
    """The same rows for a public byte-level vocabulary of ranks (tiktoken's format) at ``path``, read by the driver and sent to the executors."""
    with open(path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in sent.value.splitlines())}
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        encoding = tiktoken.Encoding(version, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in slices(batches, "text"):
            n = [len(encoding.encode_ordinary(t or "")) for t in col(b, "text").to_pylist()]
            yield pa.record_batch([col(b, "doc_id"), col(b, "source"), col(b, "lang"), pa.array([version] * len(n)), pa.array(n, pa.int64())], ["doc_id", *KEYS, "n_tokens"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))
    return slim.mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, n_tokens long")


def deltas(rows: DataFrame, op: str, where: Column | None = None, new: Column | None = None) -> DataFrame:
    """Deltas of one kind from token rows; ``new`` is the revised count."""
    rows = rows if where is None else rows.where(where)
    count = F.col("n_tokens")
    return rows.select(F.lit(op).alias("op"), *KEYS, (new if new is not None else count).alias("n_tokens"), count.alias("old_tokens"))


TOTALS_SQL = r"""
WITH t AS (
  SELECT doc_id, source, lang, 'words-1' AS tokenizer, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f]+')) AS n FROM documents
  UNION ALL
  SELECT doc_id, source, lang, 'pieces-1', len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[0-9]|[^ \t\n\r\fA-Za-z0-9]')) FROM documents),
s AS (SELECT source, lang, tokenizer, CASE WHEN doc_id % 10 = 7 THEN greatest(n - 1, 0) ELSE n END AS n FROM t WHERE doc_id IS NULL OR doc_id % 10 <> 3)
SELECT source, lang, tokenizer, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens FROM s GROUP BY ALL
"""


__all__ = ["PATTERNS", "Rollup", "bpe_tokens", "deltas", "pattern_tokens"]
