"""Ranked lists as rows (query, item, score, rank): collapsing, normalising, fusing, recency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.operators.lexical import ranked


def collapse(hits: DataFrame, query: str, item: str, order: list[Column], depth: int) -> DataFrame:
    """The best row of each item of a query, ranked anew and cut at ``depth``."""
    best = hits.withColumn("_place", F.row_number().over(Window.partitionBy(query, item).orderBy(*order))).filter("_place = 1").drop("_place")
    return ranked(best, [query], order, depth)


def minmax(hits: DataFrame, query: str, score: str = "score") -> DataFrame:
    """Scores from 0 to 1 in each list; a list whose scores are all equal gets 0."""
    w = Window.partitionBy(query)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return hits.withColumn("norm", (F.col(score) - low) / F.when(high > low, high - low).otherwise(1.0))


def _sides(left: DataFrame, right: DataFrame, query: str, item: str) -> DataFrame:
    a = minmax(left, query).select(query, item, F.col("norm").alias("nl"), F.col("rank").alias("rl"))
    b = minmax(right, query).select(query, item, F.col("norm").alias("nr"), F.col("rank").alias("rr"))
    return a.join(b, [query, item], "full_outer").withColumn("best", F.least(F.coalesce("rl", F.lit(10**9)), F.coalesce("rr", F.lit(10**9))))


def weighted(left: DataFrame, right: DataFrame, query: str, item: str, weight: float | Column = 0.75) -> DataFrame:
    """Weighted sum of both normalised scores; what a list doesn't have counts 0. Ties: best rank, then item."""
    weight = F.lit(weight) if isinstance(weight, float) else weight
    score = F.round(weight * F.coalesce("nl", F.lit(0.0)) + (1 - weight) * F.coalesce("nr", F.lit(0.0)), 6)
    return ranked(_sides(left, right, query, item).withColumn("fused", score), [query], [F.desc("fused"), F.col("best"), F.col(item)]).select(query, item, "fused", "rank")


def sweep(left: DataFrame, right: DataFrame, query: str, item: str, weights: list[float]) -> DataFrame:
    """The weighted fusion at several weights: the lists are joined once, each row is repeated per weight."""
    rows = _sides(left, right, query, item).withColumn("alpha", F.explode(F.array(*map(F.lit, weights))))
    rows = rows.withColumn("fused", F.round(F.col("alpha") * F.coalesce("nl", F.lit(0.0)) + (1 - F.col("alpha")) * F.coalesce("nr", F.lit(0.0)), 6))
    return ranked(rows, ["alpha", query], [F.desc("fused"), F.col("best"), F.col(item)]).select("alpha", query, item, "fused", "rank")


def rrf(lists: list[DataFrame], query: str, item: str, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion. Ties: best rank, then item."""
    rows = lists[0].select(query, item, "rank")
    for other in lists[1:]:
        rows = rows.unionByName(other.select(query, item, "rank"))
    fused = rows.groupBy(query, item).agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("fused"), F.min("rank").alias("best"))
    return ranked(fused, [query], [F.desc("fused"), F.col("best"), F.col(item)]).select(query, item, "fused", "rank")


def recency_boost(rows: DataFrame, query: str, item: str, date: str, weight: float) -> DataFrame:
    """weight * (n - rank) / n over the dated items of a query, the newest with rank 0; undated items are left out."""
    dated = rows.filter(F.col(date).isNotNull())
    w = Window.partitionBy(query)
    rank = F.row_number().over(w.orderBy(F.desc(date), F.col(item))) - 1
    n = F.count(F.lit(1)).over(w)
    return dated.select(query, item, F.round(F.lit(weight) * (n - rank) / n, 6).alias("boost"))


def recency_blend(hits: DataFrame, query: str, item: str, date: str, weight: float) -> DataFrame:
    """Ranks by (1 - weight) * relevance + weight * recency, both linear in rank. Ties: relevance, then item."""
    n = F.count(F.lit(1)).over(Window.partitionBy(query))
    rel = hits.withColumn("rel", (n - F.col("rank") + 1) / n).drop("rank")
    boost = recency_boost(rel, query, item, date, 1.0).withColumnRenamed("boost", "rec")
    both = rel.join(boost, [query, item], "left").withColumn("blend", F.round((1 - weight) * F.col("rel") + weight * F.coalesce("rec", F.lit(0.0)), 6))
    return ranked(both, [query], [F.desc("blend"), F.desc("rel"), F.col(item)]).select(query, item, "blend", "rank")
