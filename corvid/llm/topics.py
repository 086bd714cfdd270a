"""Topics of documents: k-means over centred, hashed word vectors, each pass over all documents.

A document's vector is the sum of its distinct words' random directions, each weighted by the logarithm of how often the word
occurs. The mean vector of the document's language is taken away, so what all texts of a language share (its frequent words)
makes no topic, and the rest is scaled to length 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import mix, release, saved

#: Dimensions of a vector; documents that the first centres are found among (those of least hash), passes over all documents.
DIMS, FIRST, PASSES = 32, 512, 6


def directions(words: np.ndarray) -> np.ndarray:
    """+1 or -1 in each dimension, from the bits of a hash of the word's hash."""
    bits = np.unpackbits(mix(words, 91).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : DIMS // 8], axis=1, bitorder="little")
    return bits.astype(np.float32) * 2 - 1


#: Distinct words whose directions are in memory at a time, about.
BLOCK_WORDS = 50_000


def vectors(words: list[np.ndarray], counts: list[np.ndarray]) -> np.ndarray:
    """A row for each document, from its distinct words' hashes and how often each occurs; 0 for one without words."""
    out = np.zeros((len(words), DIMS), np.float32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes[full]) // BLOCK_WORDS, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(full)], strict=True):
        own = full[a:b]
        weighted = directions(np.concatenate([words[i] for i in own])) * (1 + np.log(np.concatenate([counts[i] for i in own]))).astype(np.float32)[:, None]
        out[own] = np.add.reduceat(weighted, np.concatenate([[0], np.cumsum(sizes[own])[:-1]]), axis=0)
        out[own] /= np.linalg.norm(out[own], axis=1, keepdims=True) + 1e-12
    return out


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, DIMS).astype(float)


def unit(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=-1, keepdims=True) + 1e-12)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre of largest cosine for each row; the first of those that tie."""
    return np.round(x @ centres.T, 9).argmax(1)


def first_centres(x: np.ndarray, topics: int) -> np.ndarray:
    """Spread over the sample: each next one is the row that is farthest from those there are; then a few passes over the sample."""
    if not len(x):
        return np.zeros((topics, DIMS))
    centres = x[:1]
    while len(centres) < topics:
        centres = np.vstack([centres, x[np.round((x @ centres.T).max(1), 9).argmin()]])
    for _ in range(10):
        own = nearest(x, centres)
        centres = np.array([unit(x[own == k].sum(0)) if (own == k).any() else centres[k] for k in range(topics)])
    return np.round(centres, 6)


def centred(rows: DataFrame) -> DataFrame:
    """``rows`` (lang, vector as little-endian floats and more) with the mean of its language taken away, at length 1. A language
    has one row of means, so a hot one is met by a broadcast or a split join."""
    names = [f"m{i}" for i in range(DIMS)]

    def sums(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            langs, own = np.unique(np.array(batch.column("lang").to_pylist(), object).astype(str), return_inverse=True)
            x = _matrix(batch.column("vector"))
            total = np.zeros((len(langs), DIMS))
            np.add.at(total, own, x)
            yield pa.record_batch([pa.array(langs.tolist()), pa.array(np.bincount(own), pa.int64()), *(pa.array(total[:, i]) for i in range(DIMS))], names=["lang", "n", *names])

    means = rows.select("lang", "vector").mapInArrow(sums, "lang string, n bigint, " + ", ".join(f"{m} double" for m in names))
    means = saved(means.groupBy("lang").agg(*((F.sum(m) / F.sum("n")).alias(m) for m in names)).select("lang", F.array(*names).alias("mean")), "language-means")
    columns = rows.columns

    def take(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vector"))
            mean = batch.column("mean").flatten().to_numpy().reshape(-1, DIMS)
            moved = np.where(x.any(1, keepdims=True), unit(x - mean), 0).astype("<f4")
            raw = pa.array([v.tobytes() for v in moved], pa.binary())
            yield pa.record_batch([raw if c == "vector" else batch.column(c) for c in columns], names=columns)

    out = saved(rows.join(means, "lang").select(*columns, "mean").mapInArrow(take, rows.schema), "centred")
    release(means)
    return out


def fitted(rows: DataFrame, topics: int, passes: int = PASSES) -> np.ndarray:
    """The centres after ``passes`` over all vectors of ``rows``, a written table. The first ones come from a bounded sample."""
    some = rows.orderBy(F.xxhash64("vector"), "vector").select("vector").limit(FIRST).toArrow()
    x = _matrix(some.column("vector"))
    centres = first_centres(x[x.any(1)], topics)
    for _ in range(passes):

        def sums(batches, centres=centres):
            total, n = np.zeros((topics, DIMS)), np.zeros(topics, np.int64)
            for batch in batches:
                x = _matrix(batch.column("vector"))
                x = x[x.any(1)]
                own = nearest(x, centres)
                np.add.at(total, own, x)
                n += np.bincount(own, minlength=topics)
            yield pa.record_batch([pa.array(np.arange(topics)), pa.array(n), *(pa.array(total[:, i]) for i in range(DIMS))], names=["topic", "n", *(f"s{i}" for i in range(DIMS))])

        parts = rows.select("vector").mapInArrow(sums, "topic bigint, n bigint, " + ", ".join(f"s{i} double" for i in range(DIMS)))
        for r in parts.groupBy("topic").agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(DIMS))).collect():
            if r["n"]:
                centres[r["topic"]] = np.round(unit(np.array([r[f"s{i}"] for i in range(DIMS)])), 6)
    return centres


def assigned(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """``rows`` with a topic, the number of the nearest centre as text, in place of the vector; '0' for a document without words."""
    columns = [c for c in rows.columns if c != "vector"]

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("vector"))
            own = np.where(x.any(1), nearest(x, centres), 0) if len(x) else np.zeros(0, int)
            yield pa.record_batch([*(batch.column(c) for c in columns), pa.array(own.astype(str).tolist(), pa.string())], names=[*columns, "topic"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "vector") + ", topic string")
