"""Shared helpers of the training-data operators.

Text is handled as Arrow buffers: one partition's batches are cut into slices
of about a megabyte and words are found and hashed with numpy over the bytes,
so memory does not depend on the size of a partition or of a batch.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
BATCH_BYTES = 4 << 20

#: A word is a run of bytes other than space and \t \n \v \f \r.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: A word is a run of a-z, 0-9 and anything outside ASCII (after lower-casing A-Z).
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_TAIL = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by bytes and let local Python workers import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), root) if x)
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors see; set here only where it is unset."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Give freed memory back to the system, so that a worker that waits or goes on to another stage holds none of it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    # Not in every C library.
    if trim is not None:
        trim(0)


def tidy(run):
    """The same task over batches, with memory released before and after it."""

    def task(batches):
        release()
        try:
            yield from run(batches)
        finally:
            release()

    return task


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def slices(column: pa.Array, most: int = SLICE_BYTES):
    """(first row, end row, bytes, offsets from 0) for runs of rows of about `most` bytes, one row at least."""
    data, off = buffers(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


class Words:
    """Word places of the rows of one slice. Row d has words first[d] to first[d + 1]."""

    def __init__(self, data: np.ndarray, off: np.ndarray, kind: np.ndarray = SPACED, lower: bool = False):
        self.data = LOWER[data] if lower else data
        n = len(data)
        inside = kind[self.data] if n else np.zeros(0, bool)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = off[(off > 0) & (off < n)]
        before[edges] = False
        after[edges - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, off)

    def hashes(self) -> np.ndarray:
        """64 bits a word, from eight bytes at a time."""
        size = self.ends - self.starts
        padded = np.concatenate([self.data, np.zeros(16, np.uint8)])
        lanes = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), shape=(len(padded) - 8,), strides=(1,))
        h = mix((lanes[self.starts] & _TAIL[np.minimum(size, 8)]) + size.astype(np.uint64) * _K1)
        at, k = np.flatnonzero(size > 8), 8
        while len(at):
            h[at] = mix(h[at] * _K2 + (lanes[self.starts[at] + k] & _TAIL[np.minimum(size[at] - k, 8)]))
            k += 8
            at = at[size[at] > k]
        return h

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def shingles(h: np.ndarray, first: np.ndarray, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles of `width` (two or more) words by position of their first word, and the mask of those within one row.

    A row of fewer words has its whole sequence as its only shingle, at its first word.
    """
    n = len(h)
    out, valid = np.zeros(n, np.uint64), np.zeros(n, bool)
    if n >= width:
        rest = mix(h[width - 1 :] * _K3)
        for k in range(width - 2, 0, -1):
            rest = mix(h[k : n - width + 1 + k] * _K2 + rest)
        out[: n - width + 1] = mix(h[: n - width + 1] * _K1 + rest)
    counts = np.diff(first)
    last = np.repeat(first[1:], counts)
    valid[:] = np.arange(n) + width - 1 < last
    for k in range(1, width):
        at = first[:-1][counts == k]
        if len(at):
            rest = h[at + k - 1] * _K2 if k > 1 else np.uint64(0)
            for j in range(k - 2, 0, -1):
                rest = h[at + j] * _K2 + mix(rest)
            out[at] = mix(h[at] * _K1 + rest + np.uint64(k))
            valid[at] = True
    return out, valid


def hashed_counts(df: DataFrame, fill, bits: int, kind=np.int32, merge=np.add) -> np.ndarray:
    """One table of 2**bits cells that `fill(batch, cells)` changes in each task, merged over all partitions.

    Each task sends its cells of type `kind` in 256 pieces, the pieces are
    merged in as many groups, and the driver gets 2**bits numbers: sums as
    64 bits, anything else as `kind`.
    """
    pieces = min(256, 1 << bits)
    whole = np.int64 if merge is np.add else kind

    def count(batches):
        cells = np.zeros(1 << bits, kind)
        some = False
        for batch in batches:
            fill(batch, cells)
            some = True
        if some:
            rows = [(k, p.tobytes()) for k, p in enumerate(np.split(cells, pieces)) if p.any()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], ["piece", "cells"])

    def add(groups):
        total: dict[int, np.ndarray] = {}
        for batch in groups:
            for k, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cells = np.frombuffer(p, kind).astype(whole)
                total[k] = merge(total[k], cells) if k in total else cells
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["piece", "cells"])

    schema = "piece int, cells binary"
    out = np.zeros((pieces, (1 << bits) // pieces), whole)
    for r in df.mapInArrow(count, schema).repartition("piece").mapInArrow(add, schema).collect():
        out[r.piece] = merge(out[r.piece], np.frombuffer(r.cells, whole))
    return out.ravel()


def sorted_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the input: by sorting at every size, so plans of small and large runs are alike."""
    return left.join(right.hint("merge"), on, how)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def doc_key(name: str = "doc_id"):
    """The id, or the least long where it is null: lets null ids join."""
    return F.coalesce(F.col(name).cast("long"), F.lit(-(2**63)))


def free_name(taken: list[str], name: str) -> str:
    """`name`, with underscores until it clashes with no column."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def discard(*frames: DataFrame) -> None:
    """Delete tables that `saved` wrote, once nothing reads them any more."""
    for df in frames:
        hadoop = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for name in df.inputFiles()[:1]:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name).getParent()
            folder.getFileSystem(hadoop).delete(folder, True)
