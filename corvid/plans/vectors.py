"""Queries of the vector operators. The query vectors are all whose id is divisible by 50, met with all vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvid.functions import vectors as V
from corvid.operators import fusion, vector
from corvid.plans.common import dated, table

DIMS, K = 64, 20


def _both(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    return rows, rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _queries(spark, d):
    rows, _ = _both(spark, d)
    return rows, rows.filter("vec_id % 50 = 0")


def cosine_topk(spark, d):
    rows, queries = _queries(spark, d)
    return vector.topk(rows, queries, K, vector.cosine)


def l2_topk(spark, d):
    rows, queries = _queries(spark, d)
    out = vector.topk(rows, queries, K, vector.euclidean, descending=False)
    return out.withColumn("similarity", F.round(1 / (1 + F.col("score")), 5)).select("query_id", "vec_id", "similarity", "rank")


def hamming_topk(spark, d):
    """Packed signs as 64-bit words, met block by block."""
    rows, queries = _queries(spark, d)
    codes = [x.select("vec_id", V.sign_codes(F.col("embedding"), DIMS).alias("code")) for x in (rows, queries)]
    hits = vector.topk(*codes, K, vector.codes_apart, descending=False, vec_col="code")
    return hits.select("query_id", "vec_id", F.col("score").cast("int").alias("distance"), "rank")


def hamming_topk_blocks(spark, d):
    """The same, signs packed as bytes within each block."""
    rows, queries = _queries(spark, d)
    return vector.topk(rows, queries, K, vector.signs_apart, descending=False).withColumnRenamed("score", "distance")


def sign_pack(spark, d):
    rows, _ = _both(spark, d)
    return rows.select("vec_id", F.hex(V.sign_codes(F.col("embedding"), DIMS)[0]).alias("code"))


def int8_quantize(spark, d):
    rows, _ = _both(spark, d)
    q = rows.select("vec_id", V.int8(F.col("embedding")).alias("x"))
    return q.select("vec_id", F.round("x.scale", 6).alias("scale"), F.aggregate("x.q", F.lit(0), lambda s, v: s + F.abs(v)).alias("sum_abs"), F.array_max("x.q").alias("max_q"))


def truncate_renorm(spark, d):
    rows, _ = _both(spark, d)
    t = rows.select("vec_id", V.truncated(F.col("embedding"), 48).alias("x"))
    return t.select("vec_id", F.size("x").alias("dims"), F.round(V.norm(F.col("x")), 5).alias("norm"), F.round(F.col("x")[0], 5).alias("first"))


def norm_check(spark, d):
    """Whether vectors as stored have length 1; every third is scaled here, so both answers occur."""
    rows, _ = _both(spark, d)
    n = V.norm(V.unit(F.col("embedding")))
    stored = F.transform(V.unit(F.col("embedding")), lambda x: x * F.when(F.col("vec_id") % 3 == 0, 0.5 + F.col("vec_id") % 7 / 10.0).otherwise(1.0))
    return rows.select("vec_id", (F.abs(V.norm(stored) - 1) < 0.01).alias("unit"), F.round(n, 4).alias("norm"))


def sign_variant(spark, d):
    """Cosine of vectors whose values are replaced by their signs: one minus twice the share of bits that differ."""
    rows, queries = _queries(spark, d)
    signs = [x.select("vec_id", F.transform("embedding", lambda v: F.when(v >= 0, 1.0).otherwise(-1.0)).alias("embedding")) for x in (rows, queries)]
    return vector.topk(*signs, K, vector.cosine)


def bytes_per_vector(spark, d):
    rows, _ = _both(spark, d)
    n = F.size("embedding")
    return rows.groupBy(n.alias("dims")).agg(F.count(F.lit(1)).alias("n")).select("dims", "n", (F.col("dims") * 4).alias("float32"), F.col("dims").alias("int8"), F.ceil(F.col("dims") / 8).cast("int").alias("bits"))


def nbit_recall(spark, d):
    """Part of the exact first ten that each quantised scan finds, for 2, 3 and 4 bits."""
    rows, queries = _queries(spark, d)
    exact = vector.topk(rows, queries, 10, vector.cosine).select("query_id", "vec_id")
    out = None
    for bits in (2, 3, 4):
        small = rows.select("vec_id", V.nbit(F.col("embedding"), bits).alias("embedding"))
        hits = vector.topk(small, queries, 10, vector.cosine).select("query_id", "vec_id")
        part = exact.join(hits.withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left").agg(F.lit(bits).alias("bits"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 3).alias("recall_10"))
        out = part if out is None else out.union(part)
    return out


def bit_drift(spark, d):
    """Bits that change when vectors are quantised to int8 before their signs are packed."""
    rows, _ = _both(spark, d)
    a = V.sign_codes(F.col("embedding"), DIMS)
    b = V.sign_codes(V.int8(F.col("embedding"))["q"], DIMS)
    return rows.select("vec_id", V.hamming(a, b).alias("drift"))


def _lists(spark, d):
    """Two rankings of documents (vec_id % 100) per query: by cosine and by Hamming distance."""
    left = cosine_topk(spark, d).select("query_id", (F.col("vec_id") % 100).alias("doc_id"), "score", "rank")
    right = hamming_topk(spark, d).select("query_id", (F.col("vec_id") % 100).alias("doc_id"), (1.0 - F.col("distance") / DIMS).alias("score"), "rank")
    return [fusion.collapse(x, "query_id", "doc_id", [F.col("rank")], K).select("query_id", "doc_id", "score", "rank") for x in (left, right)]


def doc_collapse(spark, d):
    return _lists(spark, d)[0]


def minmax_normalize(spark, d):
    return fusion.minmax(_lists(spark, d)[1], "query_id").select("query_id", "doc_id", F.round("norm", 6).alias("norm"))


def weighted_fusion(spark, d):
    return fusion.weighted(*_lists(spark, d), "query_id", "doc_id", 0.75)


def rrf_fusion(spark, d):
    return fusion.rrf(_lists(spark, d), "query_id", "doc_id")


def alpha_sweep(spark, d):
    return fusion.sweep(*_lists(spark, d), "query_id", "doc_id", [0.25, 0.5, 0.75])


def _dated_list(spark, d):
    dates = dated(table(spark, d, "documents")).select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("publication_date")).alias("publication_date"))
    return _lists(spark, d)[0].join(dates, "doc_id", "left")


def recency_boost(spark, d):
    return fusion.recency_boost(_dated_list(spark, d), "query_id", "doc_id", "publication_date", 0.15)


def recency_blend(spark, d):
    return fusion.recency_blend(_dated_list(spark, d), "query_id", "doc_id", "publication_date", 0.25)


def vector_post_filter(spark, d):
    """Conditions after the cut at K, so fewer than K may stay."""
    meta = dated(table(spark, d, "documents"))
    hits = cosine_topk(spark, d).withColumn("doc_id", F.col("vec_id") % 100)
    return hits.join(meta, "doc_id").filter("section = 'MAT'").select("query_id", "vec_id", "rank")


def overlap_recall(spark, d):
    """Part of the exact list that the Hamming list has, over all queries."""
    a = cosine_topk(spark, d).groupBy("query_id").agg(F.collect_set("vec_id").alias("a"))
    b = hamming_topk(spark, d).groupBy("query_id").agg(F.collect_set("vec_id").alias("b"))
    return a.join(b, "query_id").select("query_id", F.round(F.size(F.array_intersect("a", "b")) / K, 6).alias("recall"))


def label_recall(spark, d):
    """Of the first ten neighbours, how many have the query's label, by label and in total."""
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    hits = cosine_topk(spark, d).filter("rank <= 10 AND query_id <> vec_id")
    rows = hits.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("gold")), "query_id")
    return rows.rollup("gold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("label") == F.col("gold")).cast("double")), 6).alias("precision"))


QUERIES = {f.__name__: f for f in (cosine_topk, l2_topk, hamming_topk, hamming_topk_blocks, sign_pack, int8_quantize, truncate_renorm, norm_check, sign_variant, bytes_per_vector, nbit_recall, bit_drift, doc_collapse, minmax_normalize, weighted_fusion, rrf_fusion, alpha_sweep, recency_boost, recency_blend, vector_post_filter, overlap_recall, label_recall)}

_F = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
_BASE = f"""
    e AS (SELECT vec_id, label, {_F} AS v, sqrt(list_sum(list_transform({_F}, lambda x: x * x))) AS nrm FROM embeddings),
    u AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i, nrm FROM e),
    q AS (SELECT vec_id AS query_id, x, i, nrm FROM u WHERE vec_id % 50 = 0),
    raw AS (SELECT query_id, u.vec_id, sum(q.x * u.x) AS dp, sum((q.x - u.x) * (q.x - u.x)) AS dd,
                   CAST(sum(CASE WHEN (q.x >= 0) <> (u.x >= 0) THEN 1 ELSE 0 END) AS INTEGER) AS distance, any_value(q.nrm) AS nq, any_value(u.nrm) AS nu
            FROM q JOIN u USING (i) GROUP BY query_id, u.vec_id),
    c AS (SELECT query_id, vec_id, round(dp / ((nq + 1e-12) * (nu + 1e-12)), 6) + 0.0 AS score FROM raw),
    cosk AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM c) WHERE rank <= {K}),
    hamk AS (SELECT * FROM (SELECT query_id, vec_id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM raw) WHERE rank <= {K})"""
_LISTS = f"""{_BASE},
    l0 AS (SELECT query_id, vec_id % 100 AS doc_id, score, rank FROM cosk),
    r0 AS (SELECT query_id, vec_id % 100 AS doc_id, 1.0 - CAST(distance AS DOUBLE) / {DIMS} AS score, rank FROM hamk),
    l AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) AS k FROM l0) WHERE k = 1),
    r AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) AS k FROM r0) WHERE k = 1),
    ln AS (SELECT query_id, doc_id, rank, (score - min(score) OVER w) / CASE WHEN max(score) OVER w > min(score) OVER w THEN max(score) OVER w - min(score) OVER w ELSE 1 END AS norm FROM l WINDOW w AS (PARTITION BY query_id)),
    rn AS (SELECT query_id, doc_id, rank, (score - min(score) OVER w) / CASE WHEN max(score) OVER w > min(score) OVER w THEN max(score) OVER w - min(score) OVER w ELSE 1 END AS norm FROM r WINDOW w AS (PARTITION BY query_id)),
    j AS (SELECT query_id, doc_id, coalesce(ln.norm, 0) AS nl, coalesce(rn.norm, 0) AS nr, least(coalesce(ln.rank, 1000000000), coalesce(rn.rank, 1000000000)) AS best FROM ln FULL JOIN rn USING (query_id, doc_id)),
    dt AS (SELECT l.*, CASE WHEN d.doc_id % 7 <> 0 THEN CAST(DATE '2020-01-01' + CAST(d.doc_id % 1500 AS INTEGER) AS DATE) END AS dte FROM l LEFT JOIN documents d USING (doc_id)),
    rec AS (SELECT query_id, doc_id, (count(*) OVER (PARTITION BY query_id) - (row_number() OVER (PARTITION BY query_id ORDER BY dte DESC, doc_id) - 1)) / CAST(count(*) OVER (PARTITION BY query_id) AS DOUBLE) AS rec FROM dt WHERE dte IS NOT NULL)"""
_RANK = "CAST(row_number() OVER (PARTITION BY {by} ORDER BY fused DESC, best, doc_id) AS INTEGER) AS rank"

ORACLE = {
    "cosine_topk": f"WITH {_BASE} SELECT query_id, vec_id, score, rank FROM cosk",
    "l2_topk": f"""WITH {_BASE}, x AS (SELECT query_id, vec_id, round(sqrt(dd), 6) AS s FROM raw),
        y AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s, vec_id) AS INTEGER) AS rank FROM x)
        SELECT query_id, vec_id, round(1 / (1 + s), 5) AS similarity, rank FROM y WHERE rank <= {K}""",
    "hamming_topk": f"WITH {_BASE} SELECT query_id, vec_id, distance, rank FROM hamk",
    "hamming_topk_blocks": f"WITH {_BASE} SELECT query_id, vec_id, CAST(distance AS DOUBLE) AS distance, rank FROM hamk",
    "sign_pack": """
        WITH h AS (SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN '1' ELSE '0' END), '') AS b FROM embeddings)
        SELECT vec_id, upper(coalesce(nullif(ltrim(array_to_string(list_transform(range(0, 16), lambda k: format('{:x}', CAST(
               8 * CAST(b[4 * k + 1] AS INTEGER) + 4 * CAST(b[4 * k + 2] AS INTEGER) + 2 * CAST(b[4 * k + 3] AS INTEGER) + CAST(b[4 * k + 4] AS INTEGER) AS INTEGER))), ''), '0'), ''), '0')) AS code FROM h""",
    "int8_quantize": f"""
        WITH s AS (SELECT vec_id, {_F} AS v, list_max(list_transform({_F}, lambda x: abs(x))) / 127 + 1e-12 AS scale FROM embeddings),
        q AS (SELECT vec_id, scale, list_transform(v, lambda x: CAST(greatest(-127, least(127, round_even(x / scale, 0))) AS INTEGER)) AS q FROM s)
        SELECT vec_id, round(scale, 6) AS scale, CAST(list_sum(list_transform(q, lambda x: abs(x))) AS INTEGER) AS sum_abs, list_max(q) AS max_q FROM q""",
    "truncate_renorm": f"""
        WITH s AS (SELECT vec_id, list_slice({_F}, 1, 48) AS v FROM embeddings),
        n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) + 1e-12 AS n FROM s)
        SELECT vec_id, CAST(len(v) AS INTEGER) AS dims, round(sqrt(list_sum(list_transform(v, lambda x: x * x))) / n, 5) AS norm, round(v[1] / n, 5) AS "first" FROM n""",
    "norm_check": f"""
        WITH n AS (SELECT vec_id, {_F} AS v, sqrt(list_sum(list_transform({_F}, lambda x: x * x))) AS n, CASE WHEN vec_id % 3 = 0 THEN 0.5 + vec_id % 7 / 10.0 ELSE 1.0 END AS k FROM embeddings),
        u AS (SELECT vec_id, k, list_transform(v, lambda x: x / (n + 1e-12)) AS u FROM n)
        SELECT vec_id, abs(sqrt(list_sum(list_transform(u, lambda x: x * k * x * k))) - 1) < 0.01 AS unit, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 4) AS norm FROM u""",
    "sign_variant": f"""WITH {_BASE}, s AS (SELECT query_id, vec_id, round(1 - 2 * distance / CAST({DIMS} AS DOUBLE), 6) + 0.0 AS score FROM raw)
        SELECT query_id, vec_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= {K}""",
    "bytes_per_vector": "SELECT CAST(len(embedding) AS INTEGER) AS dims, count(*) AS n, CAST(len(embedding) * 4 AS INTEGER) AS float32, CAST(len(embedding) AS INTEGER) AS int8, CAST(ceil(len(embedding) / 8) AS INTEGER) AS bits FROM embeddings GROUP BY ALL",
    "nbit_recall": f"""WITH {_BASE}, b AS (SELECT unnest([2, 3, 4]) AS bits),
        l AS (SELECT bits, vec_id, v, list_min(v) AS lo, (list_max(v) - list_min(v)) / (pow(2, bits) - 1) + 1e-12 AS step FROM e, b),
        n AS (SELECT bits, vec_id, list_transform(v, lambda x: lo + round_even((x - lo) / step, 0) * step) AS v FROM l),
        m AS (SELECT bits, vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nrm FROM n),
        d AS (SELECT bits, query_id, m.vec_id, round(sum(q.x * m.x) / ((any_value(q.nrm) + 1e-12) * (any_value(m.nrm) + 1e-12)), 6) + 0.0 AS score FROM q JOIN m USING (i) GROUP BY ALL),
        k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bits, query_id ORDER BY score DESC, vec_id) AS rank FROM d) WHERE rank <= 10)
        SELECT CAST(bits AS INTEGER) AS bits, round(avg(CASE WHEN k.vec_id IS NULL THEN 0.0 ELSE 1.0 END), 3) AS recall_10
        FROM (SELECT * FROM cosk, b WHERE rank <= 10) c LEFT JOIN k USING (bits, query_id, vec_id) GROUP BY bits""",
    "bit_drift": f"""
        WITH s AS (SELECT vec_id, {_F} AS v, list_max(list_transform({_F}, lambda x: abs(x))) / 127 + 1e-12 AS scale FROM embeddings)
        SELECT vec_id, CAST(list_sum(list_transform(v, lambda x: CASE WHEN (x >= 0) <> (round_even(x / scale, 0) >= 0) THEN 1 ELSE 0 END)) AS INTEGER) AS drift FROM s""",
    "doc_collapse": f"WITH {_LISTS} SELECT query_id, doc_id, score, rank FROM l",
    "minmax_normalize": f"WITH {_LISTS} SELECT query_id, doc_id, round(norm, 6) AS norm FROM rn",
    "weighted_fusion": f"WITH {_LISTS}, f AS (SELECT query_id, doc_id, best, round(0.75 * nl + 0.25 * nr, 6) AS fused FROM j) SELECT query_id, doc_id, fused, {_RANK.format(by='query_id')} FROM f",
    "rrf_fusion": f"""WITH {_LISTS}, a AS (SELECT query_id, doc_id, rank FROM l UNION ALL SELECT query_id, doc_id, rank FROM r),
        f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS fused, min(rank) AS best FROM a GROUP BY ALL)
        SELECT query_id, doc_id, fused, {_RANK.format(by='query_id')} FROM f""",
    "alpha_sweep": f"""WITH {_LISTS}, f AS (SELECT alpha, query_id, doc_id, best, round(alpha * nl + (1 - alpha) * nr, 6) AS fused FROM j, (SELECT unnest([CAST(0.25 AS DOUBLE), 0.5, 0.75]) AS alpha))
        SELECT alpha, query_id, doc_id, fused, {_RANK.format(by='alpha, query_id')} FROM f""",
    "recency_boost": f"WITH {_LISTS} SELECT query_id, doc_id, round(0.15 * rec, 6) AS boost FROM rec",
    "recency_blend": f"""WITH {_LISTS}, b AS (SELECT query_id, doc_id, (count(*) OVER (PARTITION BY query_id) - rank + 1) / CAST(count(*) OVER (PARTITION BY query_id) AS DOUBLE) AS rel FROM l),
        f AS (SELECT query_id, doc_id, rel, round(0.75 * rel + 0.25 * coalesce(round(rec, 6), 0), 6) AS blend FROM b LEFT JOIN rec USING (query_id, doc_id))
        SELECT query_id, doc_id, blend, CAST(row_number() OVER (PARTITION BY query_id ORDER BY blend DESC, rel DESC, doc_id) AS INTEGER) AS rank FROM f""",
    "vector_post_filter": f"WITH {_BASE} SELECT query_id, vec_id, rank FROM cosk JOIN documents d ON d.doc_id = vec_id % 100 WHERE d.doc_id % 2 = 0",
    "overlap_recall": f"""WITH {_BASE} SELECT c.query_id, round(count(h.vec_id) / CAST({K} AS DOUBLE), 6) AS recall FROM cosk c LEFT JOIN hamk h USING (query_id, vec_id) GROUP BY c.query_id""",
    "label_recall": f"""WITH {_BASE}, x AS (SELECT g.label AS gold, e.label FROM cosk JOIN e USING (vec_id) JOIN e g ON g.vec_id = query_id WHERE rank <= 10 AND query_id <> cosk.vec_id)
        SELECT gold, count(*) AS n, round(avg(CASE WHEN label = gold THEN 1.0 ELSE 0.0 END), 6) AS precision FROM x GROUP BY ROLLUP (gold)""",
}
