"""What the operators share: words of whole Arrow columns as numpy arrays, streams of sorted groups, and lineage cuts.

A *word* is a maximal run of ASCII letters and digits and of any non-ASCII characters, compared in lower case. In DuckDB and RE2
the same words are ``regexp_extract_all(lower(text), WORD_SQL)``. A null text has no words.
"""

from __future__ import annotations

import atexit
import ctypes
import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

WORD_SQL = r"[^\x00-/:-@\[-`{-\x7f]+"
U = np.uint64
MAX_BYTES = 1 << 20  # of text that numpy holds expanded at one time

_c = np.arange(256)
IS_WORD = (_c >= 0x80) | ((_c >= 48) & (_c <= 57)) | ((_c >= 65) & (_c <= 90)) | ((_c >= 97) & (_c <= 122))
_BYTE = np.random.default_rng(0x5EED).integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_BYTE2 = np.random.default_rng(0xB17E).integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_B, _INV = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> U(30))
        h = h * U(0xBF58476D1CE4E5B9)
        h ^= h >> U(27)
        h *= U(0x94D049BB133111EB)
        return h ^ (h >> U(31))


def power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse up to the n-th. A worker keeps a table of 2 * MAX_BYTES of them, longer ones only as long as they are used."""
    if len(_powers[0]) > n:
        return _powers[0], _powers[1]
    made = []
    for base in (_B, _INV):
        p = np.full(max(n + 1, MAX_BYTES * 2), base)
        p[0] = 1
        made.append(np.cumprod(p))
    if n < MAX_BYTES * 2:
        _powers[:] = made
    return made[0], made[1]


@dataclass
class Words:
    """Words of a slice of rows: ``of[i]:of[i + 1]`` are those of row i."""

    data: np.ndarray  # bytes of all rows
    starts: np.ndarray
    ends: np.ndarray
    of: np.ndarray
    rows: int

    def hashes(self, other: bool = False) -> np.ndarray:
        """A hash of each word, or another one independent of it; bytes are expanded MAX_BYTES at a time, so a very long text takes no more."""
        byte, out, at = _BYTE2 if other else _BYTE, np.empty(len(self.starts), np.uint64), 0
        while at < len(out):
            lo = int(self.starts[at])
            to = max(at + 1, int(np.searchsorted(self.ends, lo + MAX_BYTES, side="right")))
            data = self.data[lo : int(self.ends[to - 1])]
            up, down = power(len(data) + 1)
            with np.errstate(over="ignore"):
                s = np.zeros(len(data) + 1, np.uint64)
                np.cumsum(byte[data] * up[: len(data)], out=s[1:])
                out[at:to] = mix((s[self.ends[at:to] - lo] - s[self.starts[at:to] - lo]) * down[self.starts[at:to] - lo])
            at = to
        return out

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.of))


def buffers(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string column without nulls."""
    a = a.cast(pa.large_string())
    off = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8) if len(a) else np.zeros(1, np.int64)
    raw = a.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return off - off[0], data


def words(a: pa.Array, lower: bool = True) -> Words:
    a = pc.fill_null(a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a, "")
    off, data = buffers(pc.utf8_lower(a) if lower else a)
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(data, z, z, np.zeros(len(a) + 1, np.int64), len(a))
    w = IS_WORD[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = w[:-1]
    before[off[off < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = w[1:]
    after[off[off > 0] - 1] = False
    starts, ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, off), len(a))


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = MAX_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with about ``most`` bytes of text and under 60,000 rows; a longer row stays whole.

    At the end the memory that this took goes back to the system: workers live on, and an executor has several.
    """
    yield from _slices(batches, column, most)
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _slices(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        at, end = 0, np.cumsum(size)
        while at < b.num_rows:
            to = int(np.searchsorted(end, (end[at - 1] if at else 0) + most, side="right"))
            to = min(max(to, at + 1), at + 60_000, b.num_rows)
            yield b.slice(at, to - at)
            at = to


def col(b: pa.RecordBatch, name: str) -> pa.Array:
    return b.column(b.schema.get_field_index(name))


def longs(b: pa.RecordBatch, name: str) -> np.ndarray:
    """An integer column; null is 0."""
    return pc.fill_null(col(b, name), 0).to_numpy(zero_copy_only=False)


def by_row(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Order by (row, key); rows under 65,536."""
    o = np.argsort(key)
    return o[np.argsort(row[o].astype(np.uint16), kind="stable")]


def signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def list_of(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))


def whole_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Batches of sorted rows, joined and cut so that no key's rows lie in two of them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = longs(b, key)
        cut = int(np.searchsorted(k, k[-1], side="left"))
        if cut == 0 and held and longs(held[-1], key)[-1] == k[0]:
            held.append(b)
            continue
        if held and cut == 0:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = [b]
            continue
        if cut == 0:
            held = [b]
            continue
        yield pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks().to_batches()[0]
        held = [b.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


_made: list[tuple[SparkSession, str]] = []
_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset on a session of one machine, a new temporary one."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is unset: on {master} it has to name a folder that all executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="doclake-"))
        place = _local[0]
    return place.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; its folder goes with the cluster
            pass


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the driver ends."""
    if not _made:
        atexit.register(_clean)
    path = f"{shared_dir(spark)}/doclake-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def stash(df: DataFrame, name: str, slim: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it: its lineage ends there, and a lost executor loses nothing of it.

    ``slim``: far smaller than what it is made of; it is gathered into few files first.
    """
    df = df.hint("rebalance") if slim else df
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _stashed[id(out)] = (out, path)
    return out


_stashed: dict[int, tuple[DataFrame, str]] = {}


def stashed() -> set[int]:
    """Marks the tables that are stashed so far, for ``forget_since``."""
    return set(_stashed)


def forget_since(mark: set[int], *keep: DataFrame) -> None:
    """Delete what was stashed after a mark, but for tables that are still to be read."""
    forget(*[t for k, (t, _) in list(_stashed.items()) if k not in mark and not any(t is x for x in keep)])


def forget(*tables: DataFrame) -> None:
    """Delete stashed tables that nothing will read again."""
    for t in tables:
        if (found := _stashed.pop(id(t), None)) is not None:
            _delete(t.sparkSession, found[1])


_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; the package is sent to the executors first, which needn't have it installed."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        root, packed = Path(__file__).parents[1], io.BytesIO()
        with zipfile.ZipFile(packed, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        place = f"{folder(spark, 'code')}/doclake-code.zip"
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(packed.getvalue()))
        out.close()
        sc.addPyFile(place)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")
