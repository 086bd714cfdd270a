"""Packing along a space-filling curve.

Each document's hashed token counts are projected to a few dimensions; the cell it falls into has a place on the Hilbert
curve. Documents are range-sorted by that place and laid one after another into sequences of fixed length, so a sequence holds
documents that lie near each other. Only the last sequence of each range has padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm import tokens
from corvid.llm.common import free_worker, mix, saved, slices, utf8

LENGTH, END_ID = 4096, 2
#: Buckets of the hashed document vector, dimensions it is projected to, bits of each on the curve.
BUCKETS, DIMENSIONS, BITS = 1024, 3, 10
#: Tokens in one range of the curve, and most ranges; beyond both, ranges grow.
RANGE_TOKENS, MOST_RANGES = 1 << 22, 1 << 16


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer cells (one a row, ``bits`` bits in each dimension): a bijection in which
    neighbouring places are neighbouring cells. The coordinates are turned into the curve's frame level by level, from the
    largest cube to the smallest, then Gray-decoded and interleaved."""
    x = np.array(cells, np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = np.int64(1) << level, (np.int64(1) << level) - 1
        for i in range(n):
            upper = (x[i] & bit) != 0
            swap = np.where(upper, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(upper, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flips = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flips ^= np.where(x[n - 1] >> level & 1, (np.int64(1) << level) - 1, 0)
    x ^= flips
    place = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            place = place << 1 | x[i] >> level & 1
    return place


def projection() -> np.ndarray:
    """A fixed random matrix: a row for each bucket."""
    return np.random.default_rng(20240229).standard_normal((BUCKETS, DIMENSIONS))


TOKENISED = "doc_id bigint, n_tokens bigint, ids binary, " + ", ".join(f"p{i} double" for i in range(DIMENSIONS))


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens with the end id, the ids' bytes, and the projected document vector."""

    def run(batches):
        free_worker()
        encoder = tokens.word_tokenizer(path)
        end = np.array([END_ID], encoder.dtype).tobytes()
        bucket = (mix(np.arange(1 << 16, dtype=np.uint64), 1) % np.uint64(BUCKETS)).astype(np.int64)
        matrix = projection()
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [x + end for x in encoder.encode(utf8(part.column("text")))]
                out = np.zeros((len(ids), DIMENSIONS))
                for i, x in enumerate(ids):
                    counts = np.log1p(np.bincount(bucket[np.frombuffer(x, encoder.dtype) & 0xFFFF], minlength=BUCKETS))
                    out[i] = counts @ matrix / np.sqrt(counts @ counts)
                yield pa.record_batch([part.column("doc_id"), pa.array([len(x) // encoder.dtype.itemsize for x in ids], pa.int64()), pa.array(ids, pa.binary()), *(pa.array(out[:, i]) for i in range(DIMENSIONS))], names=["doc_id", "n_tokens", "ids", *(f"p{i}" for i in range(DIMENSIONS))])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, TOKENISED)


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, place bigint"


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the document's place.

    Null and empty texts give the end id alone. Equal texts have the same place; doc_id's hash and doc_id break ties, so a hot
    group of copies spreads over ranges. Repeated rows are packed as often as they occur. An empty table gives no rows; columns
    other than doc_id and text are ignored. Texts longer than a sequence run on over several.
    """
    path = path or tokens.default_path()
    rows = saved(tokenised(docs, path), "tokenised")
    axes = [f"p{i}" for i in range(DIMENSIONS)]
    stats = rows.agg(F.sum("n_tokens"), *(F.avg(a) for a in axes), *(F.stddev_pop(a) for a in axes)).first()
    centre = np.array([m or 0.0 for m in stats[1 : DIMENSIONS + 1]])
    spread = np.array([s or 1.0 for s in stats[DIMENSIONS + 1 :]])

    @F.pandas_udf("bigint")
    def place(p: pd.DataFrame) -> pd.Series:
        z = (p.to_numpy() - centre) / spread
        cells = np.clip((np.tanh(z * 0.8) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
        return pd.Series(hilbert_index(cells))

    wide = tokens.WordTokenizer(path).dtype.itemsize

    def lay(batches):
        base, sequence, at = TaskContext.get().partitionId() << 40, 0, 0
        for batch in batches:
            out: list[tuple] = []
            for doc, raw, where in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "place")), strict=True):
                ids = np.frombuffer(raw, f"<u{wide}").astype("<u4")
                start = 0
                while start < len(ids):
                    n = min(len(ids) - start, length - at)
                    out.append((doc, start, n, zlib.crc32(ids[start : start + n]), len(ids), base + sequence, at, where))
                    start, at = start + n, at + n
                    if at == length:
                        sequence, at = sequence + 1, 0
            columns = list(zip(*out, strict=True)) or [()] * 8
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "place"])

    ranges = max(1, min(MOST_RANGES, round((stats[0] or 0) / range_tokens)))
    placed = rows.select("doc_id", "ids", place(F.struct(*axes)).alias("place"), F.xxhash64("doc_id").alias("tie"))
    return placed.repartitionByRange(ranges, "place", "tie", "doc_id").sortWithinPartitions("place", "tie", "doc_id").select("doc_id", "ids", "place").mapInArrow(lay, PIECES)
