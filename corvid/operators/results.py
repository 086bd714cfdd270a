"""Finished runs of the answering agent as tables: metrics, what is shown of a run, and what is shown while it goes on.

A run is a row: run_id, category, stop_reason, answer (struct of text, citations, invalid, premise), gold (chunk ids), coverage (map
of needs to whether they are met), tool_errors, tool_calls, turns, elapsed_ms, usage (struct of token numbers). What its tools gave
is a row for each call: run_id, call, tool, ok, documents and chunks (arrays of structs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a run ends that has an answer, the category whose questions rest on a false premise, and token numbers kept.
COMPLETED, FALSE_PREMISE = "completed", "negative_false_premise"
USAGE = ("input_tokens", "output_tokens", "total_tokens")
#: Documents and chunks of one call that are shown, and characters of a chunk's text.
SHOWN_DOCUMENTS, SHOWN_CHUNKS, EXCERPT = 20, 30, 1600


def met(coverage: Column) -> Column:
    """Whether all needs are met; null where there are none."""
    return F.when(F.size(coverage) > 0, F.forall(F.map_values(coverage), lambda v: v))


def agent_metrics(runs: DataFrame, by: str = "category") -> DataFrame:
    """Completion, coverage, citations, corrections, errors, effort and tokens, by category and in total (null category).

    Averages are over completed runs, those of coverage over runs with needs; null where there is nothing to divide by.
    """
    done = F.col("stop_reason") == COMPLETED
    cited, gold = F.array_distinct("answer.citations"), F.array_distinct("gold")
    good = F.size(F.array_intersect(cited, gold))
    rows = runs.select(
        by,
        done.alias("done"),
        met(F.col("coverage")).cast("double").alias("covered"),
        F.when(done, F.coalesce(F.try_divide(good.cast("double"), F.size(cited)), F.lit(0.0))).alias("precision"),
        F.when(done, F.try_divide(good.cast("double"), F.size(gold))).alias("recall"),
        F.when(done & (F.col(by) == FALSE_PREMISE), (F.col("answer.premise") == "false").cast("double")).alias("corrected"),
        *(F.when(done, F.col(c)).alias(c) for c in ("tool_errors", "tool_calls", "turns", "elapsed_ms")),
        *(F.when(done, F.coalesce(F.col(f"usage.{c}"), F.lit(0))).alias(c) for c in USAGE),
    )

    def mean(name: str, alias: str) -> Column:
        return F.round(F.avg(name), 6).alias(alias)

    return rows.rollup(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("done").alias("completed"),
        F.round(F.avg(F.col("done").cast("double")), 6).alias("completion_rate"),
        mean("covered", "coverage_completion_rate"),
        mean("precision", "citation_precision"),
        mean("recall", "citation_recall"),
        mean("corrected", "false_premise_accuracy"),
        F.sum("tool_errors").alias("tool_errors"),
        mean("tool_calls", "mean_tool_calls"),
        mean("turns", "mean_turns"),
        mean("elapsed_ms", "mean_elapsed_ms"),
        *(F.sum(c).alias(c) for c in USAGE),
    )


def public_evidence(runs: DataFrame, calls: DataFrame) -> DataFrame:
    """(run_id, chunk_id, doc_id, cited): the chunks that a run read, each once; only reading gives text that can be cited."""
    read = calls.filter(F.col("ok") & (F.col("tool") == "read_chunks")).select("run_id", F.explode("chunks").alias("c")).select("run_id", "c.chunk_id", "c.doc_id").distinct()
    return read.join(runs.select("run_id", F.col("answer.citations").alias("citations")), "run_id").select("run_id", "chunk_id", "doc_id", F.array_contains("citations", F.col("chunk_id")).alias("cited"))


def public_documents(runs: DataFrame, calls: DataFrame) -> DataFrame:
    """(run_id, doc_id, title, used_as_evidence, cited): the documents that a run saw or read. A document's title is that of the
    first call that gave one."""
    ok = calls.filter("ok")
    seen = ok.select("run_id", "call", F.posexplode("documents").alias("place", "d")).select("run_id", "d.doc_id", "d.title", F.struct("call", "place").alias("at"))
    seen = seen.groupBy("run_id", "doc_id").agg(F.min_by("title", "at").alias("title"))
    read = public_evidence(runs, calls).groupBy("run_id", "doc_id").agg(F.max("cited").alias("cited"))
    both = seen.join(read.withColumn("used", F.lit(True)), ["run_id", "doc_id"], "full")
    return both.select("run_id", "doc_id", "title", F.coalesce("used", F.lit(False)).alias("used_as_evidence"), F.coalesce("cited", F.lit(False)).alias("cited"))


def public_results(runs: DataFrame) -> DataFrame:
    """(run_id, text, citations, premise, required, missing, complete, warnings): what is shown of a finished run."""
    missing = F.array_sort(F.map_keys(F.map_filter("coverage", lambda _, v: ~v)))
    warnings = F.array_compact(
        F.array(
            F.when(F.size(missing) > 0, "coverage_incomplete"),
            F.when(F.size("answer.invalid") > 0, "invalid_citations_removed"),
            F.when(F.col("stop_reason") != COMPLETED, F.col("stop_reason")),
        )
    )
    return runs.select("run_id", F.col("answer.text").alias("text"), F.col("answer.citations").alias("citations"), F.col("answer.premise").alias("premise"), F.array_sort(F.map_keys("coverage")).alias("required"), missing.alias("missing"), ((F.col("stop_reason") == COMPLETED) & (F.size(missing) == 0)).alias("complete"), warnings.alias("warnings"))


def progress(calls: DataFrame) -> DataFrame:
    """(run_id, call, tool, ok, documents, chunks, result_count): what a client sees of each call while a run goes on. Texts are
    shown of chunks that were read, up to an excerpt; of a call that failed nothing is shown."""
    documents = F.transform(F.slice("documents", 1, SHOWN_DOCUMENTS), lambda d: F.struct(d["doc_id"].alias("doc_id"), d["title"].alias("title")))
    reads = F.col("tool") == "read_chunks"

    def chunk(c: Column) -> Column:
        long = F.length(c["text"]) > EXCERPT
        return F.struct(c["chunk_id"].alias("chunk_id"), c["doc_id"].alias("doc_id"), F.when(reads, F.substring(c["text"], 1, EXCERPT)).alias("excerpt"), F.when(reads, long).alias("truncated"))

    chunks = F.transform(F.slice("chunks", 1, SHOWN_CHUNKS), chunk)
    count = F.when(F.size("chunks") > 0, F.size("chunks")).otherwise(F.size("documents"))
    shown = F.col("ok") & (F.col("tool") != "get_document_outline")
    return calls.select("run_id", "call", "tool", "ok", F.when(F.col("ok"), documents).alias("documents"), F.when(shown, chunks).alias("chunks"), F.when(F.col("ok"), count).otherwise(0).alias("result_count"))


def answers_from_context(replies: DataFrame) -> DataFrame:
    """(query_id, text, citations, invalid, premise) of model replies (query_id, reply, evidence: chunk ids): the first JSON object's
    answer, its citations within the evidence and those outside of it, and its premise status, unclear where it is none."""
    schema = "answer string, citations array<string>, premise_status string"
    data = F.from_json(F.regexp_extract("reply", r"(?s)(\{.*\})", 1), schema)
    rows = replies.withColumn("data", data)
    listed = F.coalesce("data.citations", F.array().cast("array<string>"))
    cited = F.array_distinct(F.array_compact(F.transform(listed, lambda c: c.try_cast("bigint"))))
    status = F.col("data.premise_status")
    return rows.select("query_id", F.trim(F.coalesce("data.answer", F.lit(""))).alias("text"), F.array_intersect(cited, F.col("evidence")).alias("citations"), F.array_except(cited, F.col("evidence")).alias("invalid"), F.when(status.isin("supported", "false", "unclear"), status).otherwise("unclear").alias("premise"))
