"""Helpers that the corpus operators share: durable intermediate tables, word hashing and bounded Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one Arrow slice holds when Python code expands it.
SLICE_BYTES = 2 << 20
#: Ids that are broadcast to pick documents by (16 bytes each, with what comes with them).
BROADCAST_IDS = 2_000_000
#: Rows of an Arrow batch while a table is written.
BATCH_ROWS = 2000
#: Bytes that a task gathers before it writes a row group, for tables of large values: two tasks' groups stay small within a heap.
SMALL_GROUP = 16 << 20
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``. Where that is unset, a temporary folder of this
    machine serves a local session; on a cluster it is an error, as executors could not read each other's tables there."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = _own_dirs.setdefault(spark.sparkContext.applicationId, "")
        if not path:
            path = _own_dirs[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="corvid-")
    return path.rstrip("/")


#: Temporary folders of local sessions.
_own_dirs: dict[str, str] = {}
#: Tables written within each workspace that is open.
_workspaces: list[list[DataFrame]] = []


@contextlib.contextmanager
def workspace():
    """Own the intermediate tables that are written inside: all that are left are deleted at the end, so the results that are
    wanted must be written by then (``saved`` with ``keep``; they belong to the workspace around this one, if there is one)."""
    _workspaces.append([])
    try:
        yield
    finally:
        release(*_workspaces.pop())


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/corvid-{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, codec: str = "zstd", batch_rows: int = BATCH_ROWS, keep: bool = False, row_group: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and a lost executor costs nothing. With
    ``keep`` the table outlives the ``workspace`` it is written in. ``row_group``: bytes of a row group, if not the usual number.

    While it is written, Arrow batches have at most ``batch_rows`` rows, which bounds what Python workers hold.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(batch_rows, int(before)) if int(before) > 0 else batch_rows))
    try:
        writer = df.write.option("compression", codec)
        (writer.option("parquet.block.size", row_group) if row_group else writer).parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    owners = _workspaces[:-1] if keep else _workspaces
    if owners:
        owners[-1].append(out)
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``saved`` wrote, once all that read them is written itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def by_ids(docs: DataFrame, ids: DataFrame, condition, how: str) -> DataFrame:
    """Join documents with a written table of ids (of a few fixed-width columns). Up to BROADCAST_IDS of them, counted first, are broadcast, so that no text
    moves; more are joined by a shuffle."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, condition, how)


#: What a Python worker can do to hold less, added by modules that remember things from task to task.
worker_caches: list = []


def free_worker() -> None:
    """Give back to the system what earlier tasks of this worker took and no longer need."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: Memory blocks from this size on are given back to the system as soon as they are free, in a worker that is ``lean``.
MAPPED_BYTES = 256 << 10


def lean_worker() -> None:
    """From now on this worker keeps no large blocks that are free: they are mapped one by one, for glibc would keep what it has once
    freed for later, and Arrow takes them from the same place."""
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).mallopt(-3, MAPPED_BYTES)  # M_MMAP_THRESHOLD


def trim_worker() -> None:
    """Make room: ask the worker's caches to shrink, too. Called by tasks that need much memory themselves."""
    for shrink in worker_caches:
        shrink()
    free_worker()


def input_bytes(df: DataFrame, column: str) -> int:
    """Bytes of UTF-8 in one text column, over all rows."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Cut a record batch so that each piece holds about ``limit`` bytes of ``column`` (one row at least)."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    if len(lengths) == 0:
        return
    part = np.cumsum(lengths) // limit
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(lengths)], strict=True):
        yield batch.slice(a, b - a)


def utf8(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8 bytes; null counts as empty."""
    return pa.compute.fill_null(column.cast(pa.large_binary()), b"").to_pylist()


def hash_words(words: list[bytes]) -> np.ndarray:
    """A 64-bit keyed hash (SipHash) of each word, the same in every process."""
    if not words:
        return np.zeros(0, np.uint64)
    array = np.empty(len(words), object)
    array[:] = words
    return pd.util.hash_array(array, categorize=False)


def word_arrays(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, one after another, and each text's number of words.

    ``bytes.split()`` splits at exactly these six bytes, and ``bytes.lower()`` changes only A-Z.
    """
    parts = [(t.lower() if lower else t).split() for t in texts]
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    return hash_words([w for p in parts for w in p]), counts


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Where each group begins, given the groups' sizes."""
    return np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(counts) else np.zeros(0, np.int64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and odd multiplications), elementwise."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as the first one and the gaps after it, in as few bytes each as the widest gap needs, byte plane by byte plane:
    the higher planes are mostly small numbers and take little room compressed."""
    if not len(keys):
        return b""
    gaps = np.diff(keys)
    wide = -(-int(gaps.max(initial=np.uint64(0))).bit_length() // 8)
    return bytes([wide]) + int(keys[0]).to_bytes(8, "little") + gaps.astype("<u8").view("u1").reshape(-1, 8)[:, :wide].T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    wide = data[0]
    out = np.zeros(((len(data) - 9) // wide if wide else 0) + 1, "<u8")
    out[0] = int.from_bytes(data[1:9], "little")
    if wide:
        out[1:].view("u1").reshape(-1, 8)[:, :wide] = np.frombuffer(data, "u1", offset=9).reshape(wide, -1).T
    return np.cumsum(out, dtype=np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
