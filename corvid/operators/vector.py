"""Exact vector search: every query against every vector, best k of each.

Queries and vectors are cut into blocks of bounded size by their ids' hashes; each pair of blocks meets in one task, and only the
best k of each query go on. Neither side passes through the driver, and nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.operators.lexical import ranked

#: Values (rows times dimensions) of a block of queries and of a block of vectors, about.
QUERY_VALUES, VECTOR_VALUES = 1_000_000, 4_000_000


def _blocks(rows: DataFrame, vec_col: str, values: int) -> tuple[int, int]:
    """How many blocks the rows make, and the vectors' length; vectors of several lengths are an error."""
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size(vec_col)).alias("lo"), F.max(F.size(vec_col)).alias("hi")).first()
    if r["lo"] != r["hi"]:
        raise ValueError(f"vectors of {r['lo']} and of {r['hi']} dimensions")
    return max(1, -(-r["n"] * (r["hi"] or 1) // values)), r["hi"] or 0


def topk(vectors: DataFrame, queries: DataFrame, k: int, score: Callable[[np.ndarray, np.ndarray], np.ndarray], descending: bool = True, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank). ``score(Q, X)`` gives a matrix of scores for a block of queries and a block of vectors.

    Rows without an id or a vector are left out. Ties go to the smaller id. A pair of blocks gives at most k rows for each of its
    queries.
    """
    vectors, queries = (df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("v")).dropna() for df in (vectors, queries))
    (rows_of, dims), (asked_of, others) = _blocks(vectors, "v", VECTOR_VALUES), _blocks(queries, "v", QUERY_VALUES)
    if dims and others and dims != others:
        raise ValueError(f"queries of {others} dimensions for vectors of {dims}")

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = t.column("id").to_numpy()
        return ids, t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)

    def best(asked: pa.Table, found: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if asked.num_rows and found.num_rows:
            qid, q = matrix(asked)
            vid, x = matrix(found)
            order = np.argsort(vid, kind="stable")
            vid, x = vid[order], x[order]
            step = max(1, VECTOR_VALUES // len(vid))
            for i in range(0, len(qid), step):
                s = np.round(score(q[i : i + step], x), 6) + 0.0
                # Ids are in order, so a stable sort by score settles ties by id.
                first = np.argsort(-s if descending else s, axis=1, kind="stable")[:, :k]
                out.append((np.repeat(qid[i : i + step], first.shape[1]), vid[first.ravel()], np.take_along_axis(s, first, 1).ravel()))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "item", "score"])

    def dealt(df: DataFrame, own: str, own_n: int, other: str, other_n: int, seed: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(own_n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))))

    left = dealt(queries, "qb", asked_of, "vb", rows_of, 1).groupBy("qb", "vb")
    right = dealt(vectors, "vb", rows_of, "qb", asked_of, 2).select("id", "v", "qb", "vb").groupBy("qb", "vb")
    rows = left.cogroup(right).applyInArrow(best, "query_id bigint, item bigint, score double")
    order: list[Column] = [F.desc("score") if descending else F.asc("score"), F.col("item")]
    return ranked(rows, ["query_id"], order, k).select("query_id", F.col("item").alias(id_col), "score", "rank")


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    q, x = q.astype(np.float64), x.astype(np.float64)
    return (q / (np.linalg.norm(q, axis=1, keepdims=True) + 1e-12)) @ (x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)).T


def euclidean(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    q, x = q.astype(np.float64), x.astype(np.float64)
    return np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * q @ x.T))


def codes_apart(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Hamming distance of rows of 64-bit words."""
    a, b = (np.ascontiguousarray(v, np.int64).view(np.uint64) for v in (q, x))
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        out += np.bitwise_count(a[:, i : i + 1] ^ b[None, :, i])
    return out


def signs_apart(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Hamming distance of the packed signs."""
    a, b = np.packbits(q >= 0, axis=1), np.packbits(x >= 0, axis=1)
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        out += np.bitwise_count(a[:, i : i + 1] ^ b[None, :, i])
    return out


def late_chunks(token_vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Mean of the token vectors whose span overlaps the chunk's: (doc_id, chunk_index, embedding). Joined on the document, so the
    overlap is tested within it only. ``token_vectors``: doc_id, start, end, embedding; ``chunks``: doc_id, chunk_index, start, end."""
    t, c = token_vectors.alias("t"), chunks.alias("c")
    hit = (F.col("t.doc_id") == F.col("c.doc_id")) & (F.col("t.start") < F.col("c.end")) & (F.col("t.end") > F.col("c.start"))
    rows = c.join(t, hit).select("c.doc_id", "chunk_index", F.posexplode("embedding").alias("dim", "value"))
    means = rows.groupBy("doc_id", "chunk_index", "dim").agg(F.avg("value").alias("value"))
    return means.groupBy("doc_id", "chunk_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("embedding"))
