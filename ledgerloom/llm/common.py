"""Helpers shared by the operators: shared-folder tables, Arrow text access, hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20
U64 = np.uint64
_RNG = np.random.default_rng(20240607)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share; it goes when the session ends.

    Only a local session (tests) that names no such folder gets a temporary one; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/loom-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write df to a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys are hot from this share of the rows on, so that at most HOT of them are, or from HOT_LEAST rows.
HOT, HOT_LEAST = 10_000, 500


def spread_join(rows: DataFrame, table: DataFrame, on: Sequence[str], total: int, how: str = "left", size: str = "size") -> DataFrame:
    """rows joined with a table of one row per key, without a task that gets all rows of a hot key.

    size, a column of table that is not kept, counts a key's rows; total counts all. Hot keys are HOT at most and are
    broadcast, the others meet in a shuffle.
    """
    on, hot = list(on), max(HOT_LEAST, total // HOT)
    often = F.broadcast(table.where(F.col(size) >= hot).drop(size).withColumn("__hot", F.lit(True)))
    met = rows.join(often, on, "left")
    rest = met.where("__hot is null").select(*rows.columns).join(table.where(F.col(size) < hot).drop(size), on, how)
    return met.where("__hot").drop("__hot").unionByName(rest)


_STEP = 1 << 15


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix64, elementwise, in pieces that fit a processor's cache."""
    out = np.array(x, np.uint64, order="C")
    flat = out.reshape(-1)
    for i in range(0, len(flat), _STEP):
        y = flat[i : i + _STEP]
        y ^= y >> U64(30)
        y *= U64(0xBF58476D1CE4E5B9)
        y ^= y >> U64(27)
        y *= U64(0x94D049BB133111EB)
        y ^= y >> U64(31)
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut Arrow batches into runs of rows of about limit text bytes: (rows, bytes, offsets).

    A longer text is a run of its own and is never cut.
    """
    for batch in batches:
        data, at = text_bytes(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
            j = min(j, batch.num_rows, i + 4096)
            yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j


def word_spans(data: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes outside the space set, cut at document ends): starts, ends, first word of each document."""
    n = len(data)
    inside = ~space[data]
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    before[at[at < n + 1]] = False
    starts = np.flatnonzero(inside & ~before[:n])
    after = np.zeros(n + 1, bool)
    after[:n] = inside
    after[at] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, at)


def loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, the first byte lowest; zeros follow the last byte."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LANES = _RNG.integers(0, 1 << 64, (2, 2), dtype=np.uint64) | U64(1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span: eight bytes after eight are taken in and mixed.

    Spans of one length of up to eight bytes never share a hash. Lanes are independent hashes; both together are
    128 bits. Where a shared hash would change a result, bytes are compared (same_spans) or both lanes are used.
    """
    size = ends - starts
    seed, factor = _LANES[lane]
    out = mix(size.astype(np.uint64) * factor + seed)
    words, rows = loads(data), np.flatnonzero(size > 0)
    at, left = starts[rows], size[rows]
    while len(rows):
        out[rows] = mix((out[rows] ^ (words[at] & _MASKS[np.minimum(left, 8)])) * factor)
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    return out


def same_spans(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether size bytes of a from at on equal those of b from bt on, for each of some spans."""
    same, x, y = np.ones(len(size), bool), loads(a), loads(b)
    rows, k = np.flatnonzero(size > 0), 0
    while len(rows):
        left = size[rows] - k
        same[rows[((x[at[rows] + k] ^ y[bt[rows] + k]) & _MASKS[np.minimum(left, 8)]) != 0]] = False
        rows, k = rows[left > 8], k + 8
    return same


def gram_hashes(data: np.ndarray, length: int, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of the `length` bytes (eight or more) from each place on: halves are mixed, then mixed together."""
    n = len(data)
    if n < length:
        return np.zeros(0, np.uint64)
    seed, factor = _LANES[lane]
    have, out = 8, mix(loads(data)[: n - 7] ^ seed)
    while have < length:
        step = min(have, length - have)  # the last two parts may overlap
        out = mix(out[:-step] * factor + out[step:])
        have += step
    return out


SHINGLE = 5
_KEYS = _RNG.integers(0, 1 << 64, SHINGLE, dtype=np.uint64) | U64(1)


def shingle_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two independent hashes of the five-word shingles of lower-cased texts and each document's first shingle.

    A document of one to four words has its whole sequence as one shingle; one without words has none.
    """
    starts, ends, first = word_spans(data, at)
    counts = np.diff(first)
    sizes = np.where(counts >= SHINGLE, counts - SHINGLE + 1, (counts > 0).astype(np.int64))
    begin = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(sizes, out=begin[1:])
    owner = np.repeat(np.arange(len(counts)), sizes)
    place = np.arange(begin[-1]) - begin[owner] + first[owner]
    low, short, both = LOWER[data], bool((counts < SHINGLE).any()), []
    for lane in range(2):
        padded = np.concatenate([span_hashes(low, starts, ends, lane), np.zeros(SHINGLE, np.uint64)])
        out = np.minimum(counts[owner], SHINGLE).astype(np.uint64)
        for k in range(SHINGLE):
            part = padded[place + k] * _KEYS[k]
            out += np.where(k < counts[owner], part, U64(0)) if short else part
        both.append(mix(out))
    return both[0], both[1], begin


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; extra columns, whatever they are called, play no part."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def whole_rows(df: DataFrame) -> Column:
    """All columns in one, so that columns beside it may have any name."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])
