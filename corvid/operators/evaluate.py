"""Retrieval metrics over long-form ranked lists and gold tables, overall and by category in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_ranks(ranked: DataFrame, gold: DataFrame, query: str, item: str) -> DataFrame:
    """Rank of the first gold item of every query in ``gold``, null where none was found."""
    hits = ranked.join(gold.select(query, item).distinct(), [query, item], "left_semi").groupBy(query).agg(F.min("rank").alias("first"))
    return gold.select(*[c for c in gold.columns if c != item]).distinct().join(hits, query, "left")


def single_gold(first: DataFrame, by: str | None = None, cut: int = 10, at: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """MRR, recall and NDCG with one gold item; with ``by``, also the total (null category)."""
    found = F.when(F.col("first") <= cut, F.col("first"))
    metrics = [
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.coalesce(1 / found, F.lit(0.0))), 6).alias("mrr"),
        F.round(F.avg(F.coalesce(1 / F.log2(found + 1), F.lit(0.0))), 6).alias("ndcg"),
        *(F.round(F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))), 6).alias(f"recall_{k}") for k in at),
    ]
    return first.rollup(by).agg(*metrics) if by else first.agg(*metrics)


def multi_gold(ranked: DataFrame, gold: DataFrame, query: str, item: str, at: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Per query: gold items, first rank, and for each cut how many were found."""
    rows = gold.select(query, item).distinct().join(ranked.select(query, item, "rank"), [query, item], "left")
    return rows.groupBy(query).agg(F.count(F.lit(1)).alias("gold"), F.min("rank").alias("first"), *(F.count(F.when(F.col("rank") <= k, 1)).alias(f"hit_{k}") for k in at))


def multi_summary(per_query: DataFrame, at: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Any-gold, fractional and all-hop recall at each cut, and MRR of the first gold item."""
    out: list[Column] = [F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr")]
    for k in at:
        hit = F.col(f"hit_{k}")
        out += [
            F.round(F.avg((hit > 0).cast("double")), 6).alias(f"any_{k}"),
            F.round(F.avg(hit / F.col("gold")), 6).alias(f"recall_{k}"),
            F.round(F.avg((hit == F.col("gold")).cast("double")), 6).alias(f"all_{k}"),
        ]
    return per_query.agg(*out)


def citation_metrics(cited: Column, allowed: Column, gold: Column) -> Column:
    """Precision, recall and invalid citations of one answer; null where there is nothing to divide by."""
    good = F.size(F.array_intersect(cited, gold))
    return F.struct(
        F.round(F.try_divide(good.cast("double"), F.size(cited)), 6).alias("precision"),
        F.round(F.try_divide(good.cast("double"), F.size(gold)), 6).alias("recall"),
        F.size(F.array_except(cited, allowed)).alias("invalid"),
    )


def nearest_rank(rows: DataFrame, by: str, value: Column, percents: tuple[int, ...]) -> DataFrame:
    """For each group the values at place ``min(n * percent / 100, n - 1)`` from 0 of its sorted values, as columns p50 and so on.

    Equal values are counted first, so what is sorted is a histogram.
    """
    counts = rows.select(by, value.alias("value")).groupBy(by, "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(by)
    counts = counts.withColumn("upto", F.sum("n").over(w.orderBy("value"))).withColumn("total", F.sum("n").over(w))

    def at(percent: int) -> Column:
        place = F.least(F.floor(F.col("total") * percent / 100), F.col("total") - 1)
        return F.max(F.when((F.col("upto") > place) & (F.col("upto") - F.col("n") <= place), F.col("value"))).alias(f"p{percent}")

    return counts.groupBy(by).agg(*map(at, percents))


def chunk_metrics(ranked: DataFrame, gold: DataFrame, query: str, doc: str = "doc_id", chunk: str = "chunk_id", at: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One ranking of chunks measured twice in one pass: by chunk and by document, whose rank is its best chunk's after documents
    are counted once each. ``gold``: one (query, doc, chunk) a query; the chunk may be null, and then counts for documents only."""
    best = ranked.groupBy(query, doc).agg(F.min("rank").alias("best"))
    placed = best.withColumn("doc_rank", F.row_number().over(Window.partitionBy(query).orderBy("best", doc)))
    rows = gold.select(query, doc, chunk).join(placed.select(query, doc, "doc_rank"), [query, doc], "left")
    rows = rows.join(ranked.select(query, chunk, F.col("rank").alias("chunk_rank")), [query, chunk], "left")
    out = [F.count(F.lit(1)).alias("n"), F.count(chunk).alias("n_chunks")]
    for side, has in (("doc", F.lit(True)), ("chunk", F.col(chunk).isNotNull())):
        rank = F.col(f"{side}_rank")
        out.append(F.round(F.avg(F.when(has, F.coalesce(1 / rank, F.lit(0.0)))), 6).alias(f"{side}_mrr"))
        out += [F.round(F.avg(F.when(has, F.coalesce((rank <= k).cast("double"), F.lit(0.0)))), 6).alias(f"{side}_recall_{k}") for k in at]
    return rows.agg(*out)


def evidence_recall(ranked: DataFrame, gold: DataFrame, query: str, chunk: str = "chunk_id", at: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Over queries with gold chunks: the mean part of them among the first k, and how often all of them are."""
    per = multi_gold(ranked, gold, query, chunk, at)
    shares = [F.count(F.lit(1)).alias("n")]
    for k in at:
        hit = F.col(f"hit_{k}")
        shares += [F.round(F.avg(hit / F.col("gold")), 6).alias(f"evidence_{k}"), F.round(F.avg((hit == F.col("gold")).cast("double")), 6).alias(f"all_evidence_{k}")]
    return per.agg(*shares)


def full_depth_mrr(first: DataFrame, by: str) -> DataFrame:
    """MRR over the whole ranking, however deep, by type and in total (null type), with the share of queries that found their gold."""
    found = F.coalesce(1 / F.col("first"), F.lit(0.0))
    return first.rollup(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(found), 6).alias("mrr"), F.round(F.avg(F.col("first").isNotNull().cast("double")), 6).alias("found"))


def first_per_category(rows: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """One row of each category, the first in order."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter("_place = 1").drop("_place")


def stratified(rows: DataFrame, strata: list[str], key: str, most: int) -> DataFrame:
    """A sample by turns: the first row (by key) of every stratum, the larger strata first, then the second of each, and so on."""
    w = Window.partitionBy(*strata)
    sizes = rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    turns = rows.withColumn("round", F.row_number().over(w.orderBy(key))).filter(F.col("round") <= most).join(sizes, strata)
    return turns.orderBy("round", F.desc("_n"), *strata).limit(most).drop("_n")


def seeded(rows: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """A sample by the keys' digests under a seed: the same whatever the order of rows."""
    return rows.withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).orderBy("h").limit(most)


#: A word of a question finds its document if it is this long and in less than this part of all documents.
ANCHOR_LETTERS, ANCHOR_SHARE = 4, 0.001


def anchored(queries: DataFrame, docs: DataFrame, gold: DataFrame, query: str, share: float = ANCHOR_SHARE, doc: str = "doc_id") -> DataFrame:
    """(query, doc, anchored) for the gold pairs: whether a word of the query that stands in the document would find it: a rare word
    of four letters or more, or a number of four digits or more."""
    from corvid.operators import lexical

    pairs = gold.select(query, doc).distinct()
    asked = queries.join(pairs.select(query).distinct(), query, "left_semi")
    words = lexical.query_terms(asked, query).select(query, "term").filter(F.length("term") >= ANCHOR_LETTERS)
    held = lexical.matching_postings(docs, words, doc)
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    rare = df.crossJoin(F.broadcast(n)).withColumn("good", F.col("term").rlike(r"^\d{4,}$") | ~F.col("term").rlike(r"^\d+$") & (F.col("df") < F.col("n_docs") * share))  # one row
    rows = pairs.join(words, query).join(held.select("term", doc), ["term", doc]).join(rare.select("term", "good"), "term")
    good = rows.groupBy(query, doc).agg(F.max("good").alias("anchored"))
    return pairs.join(good, [query, doc], "left").withColumn("anchored", F.coalesce("anchored", F.lit(False)))


def pareto(rows: DataFrame, first: str, second: str) -> DataFrame:
    """Rows that no other one equals or beats in both columns and beats in one; of rows that are equal in both, all.

    Each value of the first column keeps its greatest second one, so what is sorted in one place is the column's distinct values.
    """
    best = rows.groupBy(first).agg(F.max(second).alias("top"))
    above = Window.orderBy(F.desc(first)).rowsBetween(Window.unboundedPreceding, -1)
    best = best.withColumn("above", F.max("top").over(above)).filter("above IS NULL OR top > above")
    return rows.join(best.select(first, F.col("top").alias(second)), [first, second], "left_semi")


def report(rows: DataFrame, title: str) -> str:
    """A small result, such as a table of metrics by category, as Markdown."""
    names = rows.columns
    lines = [f"## {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    for r in rows.collect():
        lines.append("| " + " | ".join("total" if r[n] is None else f"{r[n]:.4f}" if isinstance(r[n], float) else str(r[n]) for n in names) + " |")
    return "\n".join(lines) + "\n"
