"""Checks as columns: requests, feedback, gold records, provider errors, and what a seeding run has still to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The run store's contract.
QUESTION, HOPS, CLIENT_ID = (3, 2000), (1, 5), r"^[A-Za-z0-9._:-]{1,128}$"
RATINGS = ("correct", "partial", "incorrect")
FATAL_CLASSES = ("AuthenticationError", "PermissionDeniedError")
FATAL_MARKS = ("insufficient_quota", "credit_balance_exhausted", "invalid_api_key", "reached your usage limit", "usage limit")


def request_error(question: Column, as_of: Column, hops: Column, client_id: Column) -> Column:
    """The first field that a request has wrong, null for a good one."""
    n = F.length(F.trim(question))
    return (
        F.when(~F.coalesce(n.between(*QUESTION), F.lit(False)), "question")
        .when(as_of.isNotNull() & F.try_to_date(as_of, "yyyy-MM-dd").isNull(), "as_of")
        .when(~F.coalesce(hops.between(*HOPS), F.lit(False)), "required_hops")
        .when(client_id.isNotNull() & ~client_id.rlike(CLIENT_ID), "client_request_id")
    )


def fatal(error_class: Column, details: Column) -> Column:
    """Whether an error ends a whole session: by its class, or by a mark of a used-up or refused account."""
    text = F.lower(F.coalesce(details, F.lit("")))
    marks = F.lit(False)
    for m in FATAL_MARKS:
        marks = marks | F.contains(text, F.lit(m))
    return F.coalesce(error_class.isin(*FATAL_CLASSES), F.lit(False)) | marks


def gold_errors(records: DataFrame, categories: list[str], per_category: int) -> DataFrame:
    """(id, problem) of gold records: repeated ids, unknown categories, hops that the gold documents don't match, no reference
    answer; and (null, problem) for categories of the wrong size. Columns: id, category, required_hops, n_gold, answer."""
    own = records.select("id", F.explode(F.array_compact(F.array(
        F.when(~F.col("category").isin(categories), "category"),
        F.when(F.col("required_hops") > F.col("n_gold"), "required_hops"),
        F.when(F.length(F.trim(F.coalesce("answer", F.lit("")))) == 0, "reference_answer"),
    ))).alias("problem"))
    repeated = records.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", F.lit("repeated").alias("problem"))
    sizes = records.groupBy("category").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != per_category)
    sizes = sizes.select(F.lit(None).cast(records.schema["id"].dataType).alias("id"), F.concat(F.lit("size of "), F.coalesce("category", F.lit("null"))).alias("problem"))
    return own.unionByName(repeated).unionByName(sizes)


def seed_plan(questions: DataFrame, runs: DataFrame, key: str = "client_id") -> DataFrame:
    """What a seeding run does with each question: skip (succeeded), pending (queued or started), retry (failed), or create."""
    state = F.when(F.col("status") == "succeeded", "skip").when(F.col("status") == "failed", "retry").when(F.col("status").isNotNull(), "pending").otherwise("create")
    return questions.join(runs.select(key, "status"), key, "left").withColumn("action", state)


def guarded_delete(rows: DataFrame, user_col: str, prefix: str, allowed: str = "seed:") -> DataFrame:
    """Rows without those of users under ``prefix``; any other prefix than the seeds' own is refused."""
    if not prefix.startswith(allowed):
        raise ValueError(f"only rows under {allowed!r} can be deleted")
    return rows.filter(~F.coalesce(F.col(user_col).startswith(prefix), F.lit(False)))


def published(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, published): the last word of a log of publish and unpublish actions; deleted runs are gone."""
    last = log.groupBy(key).agg(F.max_by("action", F.struct(*order)).alias("action"))
    return last.filter("action <> 'delete'").select(key, (F.col("action") == "publish").alias("published"))


#: Longest comment of a feedback.
COMMENT = 2000


def feedback_error(rating: Column, comment: Column) -> Column:
    """The first field that a feedback has wrong, null for a good one."""
    return F.when(~F.coalesce(rating.isin(*RATINGS), F.lit(False)), "rating").when(F.length(comment) > COMMENT, "comment")


#: Characters of a made question, and the kinds of questions there are; the kind that needs no question mark.
ASKED, KINDS, MARKLESS = (15, 300), ("factual", "thematic", "paraphrase"), "paraphrase"
#: Words in a row that a question may not share with its source.
COPIED = 8


def question_error(kind: Column, text: Column, before: Column, copied: Column, chunk: Column, chunks: Column) -> Column:
    """The first reason against a made question, null for a good one: its kind, length, question mark, that it was made before
    (``before``: how often), that it copies its source (``copied``: whether), or that its chunk (from 0) is none of the document's."""
    return (
        F.when(~F.coalesce(kind.isin(*KINDS), F.lit(False)), "kind")
        .when(F.length(text) < ASKED[0], "too short")
        .when(F.length(text) > ASKED[1], "too long")
        .when((kind != MARKLESS) & ~text.contains("?"), "no question")
        .when(before > 0, "repeated")
        .when(copied, "copied")
        .when(chunk.isNotNull() & ~chunk.between(0, chunks - 1), "chunk")
    )
