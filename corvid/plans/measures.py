"""Queries of ranking metrics over chunks and of finished agent runs.

Orders stand for runs and their lines for tool calls: suppliers are documents, parts are chunks.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corvid.functions import text as T
from corvid.operators import evaluate, lexical, results
from corvid.plans.common import bm25_sql, table, tokens_sql


def _lines_ranked(spark, d, k):
    """Lines of documents as chunks, the best of each passage."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).withColumn("chunk_id", F.col("doc_id") * 100000 + F.col("i"))
    best = lexical.bm25(lines.select("chunk_id", "text"), table(spark, d, "benchmark"), "item_id", k, "chunk_id")
    return best.withColumn("doc_id", F.floor(F.col("chunk_id") / 100000))


def _gold_chunks(spark, d):
    """Lines that quote a passage of eight words or more."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).withColumn("chunk_id", F.col("doc_id") * 100000 + F.col("i"))
    quotes = table(spark, d, "benchmark").select("item_id", T.tokens("text").alias("words")).filter(F.size("words") >= 8)
    return lexical.phrase_hits(lines, quotes, "item_id", "chunk_id").select("item_id", "chunk_id", F.floor(F.col("chunk_id") / 100000).alias("doc_id"))


def chunk_metrics(spark, d):
    """Chunk and document metrics of one ranking; the gold chunk is a passage's first, and unknown for every fifth passage."""
    gold = _gold_chunks(spark, d).groupBy("item_id").agg(F.min("chunk_id").alias("first"))
    gold = gold.select("item_id", F.floor(F.col("first") / 100000).alias("doc_id"), F.when(F.col("item_id") % 5 != 0, F.col("first")).alias("chunk_id"))
    return evaluate.chunk_metrics(_lines_ranked(spark, d, 30), gold, "item_id")


def evidence_recall(spark, d):
    return evaluate.evidence_recall(_lines_ranked(spark, d, 30), _gold_chunks(spark, d), "item_id")


def full_depth_mrr(spark, d):
    """MRR over rankings of 200 chunks, by the passage's id modulo 3."""
    gold = _gold_chunks(spark, d).select("item_id", "chunk_id", F.concat(F.lit("c"), (F.col("item_id") % 3).cast("string")).alias("category"))
    return evaluate.full_depth_mrr(evaluate.first_ranks(_lines_ranked(spark, d, 200), gold, "item_id", "chunk_id"), "category")


def first_per_category(spark, d):
    """The longest document of each source, the smallest id among equals."""
    rows = table(spark, d, "documents").select("doc_id", "source", F.length("text").alias("n"))
    return evaluate.first_per_category(rows, "source", [F.desc("n"), F.col("doc_id")])


def _runs(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.collect_set(F.when(F.col("l_linenumber") <= 2, F.col("l_partkey"))).alias("cited"),
        F.collect_set(F.when(F.col("l_linenumber").isin(1, 3), F.col("l_partkey"))).alias("gold"),
        F.collect_set(F.when(F.col("l_linenumber") == 6, F.col("l_partkey"))).alias("invalid"),
        F.count(F.lit(1)).alias("tool_calls"),
    )
    o = table(spark, d, "orders").join(lines, "o_orderkey")
    needs = F.when(F.col("o_custkey") % 5 == 0, F.create_map().cast("map<string,boolean>")).otherwise(F.create_map(F.lit("numeral 5.2"), F.col("o_custkey") % 3 != 0, F.lit("2024"), F.col("o_orderkey") % 7 != 0))
    usage = F.struct(F.col("o_custkey").alias("input_tokens"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 100).alias("output_tokens"), (F.col("o_custkey") + 1).alias("total_tokens"))
    answer = F.struct(F.concat(F.lit("answer "), F.col("o_orderkey").cast("string")).alias("text"), F.array_sort("cited").alias("citations"), F.array_sort("invalid").alias("invalid"), F.when(F.col("o_custkey") % 2 == 0, "false").otherwise("supported").alias("premise"))
    return o.select(
        F.col("o_orderkey").alias("run_id"),
        F.when(F.col("o_orderpriority").startswith("1"), results.FALSE_PREMISE).otherwise(F.col("o_orderpriority")).alias("category"),
        F.when(F.col("o_orderstatus") == "F", results.COMPLETED).otherwise("turn_limit").alias("stop_reason"),
        answer.alias("answer"),
        "gold",
        needs.alias("coverage"),
        (F.col("o_custkey") % 4).alias("tool_errors"),
        "tool_calls",
        (F.col("o_custkey") % 9).alias("turns"),
        F.col("o_totalprice").alias("elapsed_ms"),
        usage.alias("usage"),
    )


def _calls(spark, d):
    tool = F.element_at(F.array(*map(F.lit, ["search_documents", "read_chunks", "get_document_outline"])), (F.col("l_linenumber") % 3 + 1).cast("int"))
    document = F.array(F.struct(F.col("l_suppkey").alias("doc_id"), F.concat(F.lit("T"), F.col("l_linenumber").cast("string")).alias("title")))
    chunk = F.array(F.struct(F.col("l_partkey").alias("chunk_id"), F.col("l_suppkey").alias("doc_id"), F.repeat(F.lit("x"), (F.col("l_quantity") * 50).cast("int")).alias("text")))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("call"), tool.alias("tool"), (F.col("l_returnflag") != "R").alias("ok"), document.alias("d"), chunk.alias("c"))
    searched = F.col("tool") == "search_documents"
    return rows.select("run_id", "call", "tool", "ok", F.when(searched, F.col("d")).otherwise(F.slice("d", 1, 0)).alias("documents"), F.when(searched, F.slice("c", 1, 0)).otherwise(F.col("c")).alias("chunks"))


def agent_metrics(spark, d):
    return results.agent_metrics(_runs(spark, d))


def public_evidence(spark, d):
    return results.public_evidence(_runs(spark, d), _calls(spark, d))


def public_documents(spark, d):
    return results.public_documents(_runs(spark, d), _calls(spark, d))


def public_results(spark, d):
    rows = results.public_results(_runs(spark, d))
    return rows.select("run_id", "text", F.array_join("citations", ",").alias("citations"), "premise", F.size("required").alias("required"), F.array_join("missing", ",").alias("missing"), "complete", F.array_join("warnings", ",").alias("warnings"))


def progress_projection(spark, d):
    rows = results.progress(_calls(spark, d))
    chunk = F.try_element_at("chunks", F.lit(1))
    return rows.select("run_id", "call", "tool", "ok", F.coalesce(F.size("documents"), F.lit(0)).alias("documents"), chunk["chunk_id"].alias("chunk_id"), F.length(chunk["excerpt"]).alias("shown"), chunk["truncated"].alias("truncated"), "result_count")


def answers_from_context(spark, d):
    """Model replies made of turns: some with an answer as JSON, some with a broken one, some with none."""
    t = table(spark, d, "conversations").withColumn("query_id", F.col("conv_id") * 100 + F.col("turn"))
    good = F.format_string('So: {"answer": " yes %d ", "citations": ["%d", "x", "%d", "%d"], "premise_status": "%s"} end', F.col("conv_id"), F.col("turn"), F.col("turn") + 1, F.col("turn"), F.when(F.col("conv_id") % 3 == 0, "false").otherwise("maybe"))
    reply = F.when(F.col("query_id") % 4 == 0, "nothing").when(F.col("query_id") % 4 == 1, F.concat(F.lit('{"answer": "cut '), F.col("role"))).otherwise(good)
    rows = results.answers_from_context(t.select("query_id", reply.alias("reply"), F.array(F.col("turn"), F.lit(0).cast("bigint")).alias("evidence")))
    return rows.select("query_id", "text", F.array_join("citations", ",").alias("citations"), F.array_join("invalid", ",").alias("invalid"), "premise")


QUERIES = {f.__name__: f for f in (chunk_metrics, evidence_recall, full_depth_mrr, first_per_category, agent_metrics, public_evidence, public_documents, public_results, progress_projection, answers_from_context)}

_CH = "ch AS (SELECT doc_id * 100000 + generate_subscripts(string_split(text, chr(10)), 1) - 1 AS doc_id, unnest(string_split(text, chr(10))) AS text FROM documents)"
_GOLD = f"""
    gq AS (SELECT item_id, ' ' || array_to_string({tokens_sql("text")}, ' ') || ' ' AS q FROM benchmark WHERE len({tokens_sql("text")}) >= 8),
    gl AS (SELECT doc_id AS chunk_id, ' ' || array_to_string({tokens_sql("text")}, ' ') || ' ' AS x FROM ch),
    gc AS (SELECT item_id, chunk_id, chunk_id // 100000 AS doc_id FROM gq JOIN gl ON contains(x, q))"""


def _chunked(k: int) -> str:
    return f"{_CH}, {bm25_sql('1', k, 'ch')}, {_GOLD}, rk AS (SELECT item_id, doc_id AS chunk_id, doc_id // 100000 AS doc_id, rank FROM best)"


def _recalls(side: str, has: str) -> str:
    return f"round(avg(CASE WHEN {has} THEN coalesce(1 / {side}_rank, 0) END), 6) AS {side}_mrr, " + ", ".join(f"round(avg(CASE WHEN {has} THEN CASE WHEN {side}_rank <= {k} THEN 1.0 ELSE 0.0 END END), 6) AS {side}_recall_{k}" for k in (1, 5, 10))


_RUNS = """
    li AS (SELECT l_orderkey, list(DISTINCT l_partkey) FILTER (l_linenumber <= 2) AS cited, list(DISTINCT l_partkey) FILTER (l_linenumber IN (1, 3)) AS gold, list(DISTINCT l_partkey) FILTER (l_linenumber = 6) AS invalid, count(*) AS tool_calls FROM lineitem GROUP BY l_orderkey),
    ru AS (SELECT o.*, coalesce(cited, []) AS cited, coalesce(gold, []) AS gold, coalesce(invalid, []) AS invalid, tool_calls, o_orderstatus = 'F' AS done,
                  CASE WHEN o_orderpriority LIKE '1%' THEN 'negative_false_premise' ELSE o_orderpriority END AS category, o_custkey % 3 <> 0 AS n1, o_orderkey % 7 <> 0 AS n2 FROM orders o JOIN li ON l_orderkey = o_orderkey),
    ca AS (SELECT l_orderkey AS run_id, l_linenumber AS call, CASE l_linenumber % 3 WHEN 0 THEN 'search_documents' WHEN 1 THEN 'read_chunks' ELSE 'get_document_outline' END AS tool, l_returnflag <> 'R' AS ok, l_suppkey AS doc_id, l_partkey AS chunk_id, CAST(l_quantity * 50 AS INTEGER) AS n FROM lineitem),
    ev AS (SELECT DISTINCT run_id, chunk_id, doc_id, list_contains(cited, chunk_id) AS cited FROM ca JOIN ru ON o_orderkey = run_id WHERE ok AND tool = 'read_chunks')"""

ORACLE = {
    "chunk_metrics": f"""WITH {_chunked(30)},
        f AS (SELECT item_id, min(chunk_id) AS first FROM gc GROUP BY item_id), g AS (SELECT item_id, first // 100000 AS doc_id, CASE WHEN item_id % 5 <> 0 THEN first END AS chunk_id FROM f),
        b AS (SELECT item_id, doc_id, min(rank) AS best FROM rk GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY best, doc_id) AS doc_rank FROM b),
        j AS (SELECT g.*, doc_rank, rk.rank AS chunk_rank FROM g LEFT JOIN p USING (item_id, doc_id) LEFT JOIN rk ON rk.item_id = g.item_id AND rk.chunk_id = g.chunk_id)
        SELECT count(*) AS n, count(chunk_id) AS n_chunks, {_recalls('doc', 'true')}, {_recalls('chunk', 'chunk_id IS NOT NULL')} FROM j""",
    "evidence_recall": f"""WITH {_chunked(30)},
        m AS (SELECT item_id, count(*) AS gold, """
    + ", ".join(f"count(CASE WHEN rank <= {k} THEN 1 END) AS h{k}" for k in (5, 10, 20))
    + " FROM gc LEFT JOIN rk USING (item_id, chunk_id) GROUP BY item_id) SELECT count(*) AS n, "
    + ", ".join(f"round(avg(h{k} / gold), 6) AS evidence_{k}, round(avg(CASE WHEN h{k} = gold THEN 1.0 ELSE 0.0 END), 6) AS all_evidence_{k}" for k in (5, 10, 20))
    + " FROM m",
    "full_depth_mrr": f"""WITH {_chunked(200)}, f AS (SELECT item_id, 'c' || item_id % 3 AS category, min(rank) AS first FROM gc LEFT JOIN rk USING (item_id, chunk_id) GROUP BY ALL)
        SELECT category, count(*) AS n, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(avg(CASE WHEN first IS NULL THEN 0.0 ELSE 1.0 END), 6) AS found FROM f GROUP BY ROLLUP (category)""",
    "first_per_category": "SELECT doc_id, source, CAST(n AS INTEGER) AS n FROM (SELECT doc_id, source, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC NULLS LAST, doc_id) AS k FROM documents) WHERE k = 1",
    "agent_metrics": f"""WITH {_RUNS}, x AS (SELECT *, len(list_intersect(cited, gold)) AS good FROM ru)
        SELECT category, count(*) AS n, count(CASE WHEN done THEN 1 END) AS completed, round(avg(CASE WHEN done THEN 1.0 ELSE 0.0 END), 6) AS completion_rate,
               round(avg(CASE WHEN o_custkey % 5 <> 0 THEN CASE WHEN n1 AND n2 THEN 1.0 ELSE 0.0 END END), 6) AS coverage_completion_rate,
               round(avg(CASE WHEN done THEN coalesce(good / nullif(len(cited), 0), 0) END), 6) AS citation_precision, round(avg(CASE WHEN done THEN good / nullif(len(gold), 0) END), 6) AS citation_recall,
               round(avg(CASE WHEN done AND category = 'negative_false_premise' THEN CASE WHEN o_custkey % 2 = 0 THEN 1.0 ELSE 0.0 END END), 6) AS false_premise_accuracy,
               CAST(sum(CASE WHEN done THEN o_custkey % 4 END) AS BIGINT) AS tool_errors, round(avg(CASE WHEN done THEN tool_calls END), 6) AS mean_tool_calls, round(avg(CASE WHEN done THEN o_custkey % 9 END), 6) AS mean_turns,
               round(avg(CASE WHEN done THEN o_totalprice END), 6) AS mean_elapsed_ms, CAST(sum(CASE WHEN done THEN o_custkey END) AS BIGINT) AS input_tokens,
               CAST(sum(CASE WHEN done THEN CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 100 ELSE 0 END END) AS BIGINT) AS output_tokens, CAST(sum(CASE WHEN done THEN o_custkey + 1 END) AS BIGINT) AS total_tokens
        FROM x GROUP BY ROLLUP (category)""",
    "public_evidence": f"WITH {_RUNS} SELECT run_id, chunk_id, doc_id, cited FROM ev",
    "public_documents": f"""WITH {_RUNS}, s AS (SELECT run_id, doc_id, 'T' || min(call) AS title FROM ca WHERE ok AND tool = 'search_documents' GROUP BY ALL), r AS (SELECT run_id, doc_id, bool_or(cited) AS cited FROM ev GROUP BY ALL)
        SELECT run_id, doc_id, title, r.cited IS NOT NULL AS used_as_evidence, coalesce(r.cited, false) AS cited FROM s FULL JOIN r USING (run_id, doc_id)""",
    "public_results": f"""WITH {_RUNS}, m AS (SELECT *, CASE WHEN o_custkey % 5 = 0 THEN [] ELSE list_filter([CASE WHEN NOT n2 THEN '2024' END, CASE WHEN NOT n1 THEN 'numeral 5.2' END], lambda x: x IS NOT NULL) END AS missing FROM ru)
        SELECT o_orderkey AS run_id, 'answer ' || o_orderkey AS text, array_to_string(list_sort(cited), ',') AS citations, CASE WHEN o_custkey % 2 = 0 THEN 'false' ELSE 'supported' END AS premise, CAST(CASE WHEN o_custkey % 5 = 0 THEN 0 ELSE 2 END AS INTEGER) AS required,
               array_to_string(missing, ',') AS missing, done AND len(missing) = 0 AS complete,
               concat_ws(',', CASE WHEN len(missing) > 0 THEN 'coverage_incomplete' END, CASE WHEN len(invalid) > 0 THEN 'invalid_citations_removed' END, CASE WHEN NOT done THEN 'turn_limit' END) AS warnings FROM m""",
    "progress_projection": f"""WITH {_RUNS} SELECT run_id, call, tool, ok, CAST(CASE WHEN ok AND tool = 'search_documents' THEN 1 ELSE 0 END AS INTEGER) AS documents, CASE WHEN ok AND tool = 'read_chunks' THEN chunk_id END AS chunk_id,
               CASE WHEN ok AND tool = 'read_chunks' THEN least(n, 1600) END AS shown, CASE WHEN ok AND tool = 'read_chunks' THEN n > 1600 END AS truncated, CAST(CASE WHEN ok THEN 1 ELSE 0 END AS INTEGER) AS result_count FROM ca""",
    "answers_from_context": """
        WITH t AS (SELECT *, conv_id * 100 + turn AS query_id FROM conversations)
        SELECT query_id, CASE WHEN query_id % 4 < 2 THEN '' ELSE 'yes ' || conv_id END AS text, CASE WHEN query_id % 4 < 2 THEN '' ELSE CAST(turn AS VARCHAR) END AS citations,
               CASE WHEN query_id % 4 < 2 THEN '' ELSE CAST(turn + 1 AS VARCHAR) END AS invalid, CASE WHEN query_id % 4 >= 2 AND conv_id % 3 = 0 THEN 'false' ELSE 'unclear' END AS premise FROM t""",
}
