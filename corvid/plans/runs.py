"""Queries of evaluation, the run store and event time. The event table stands for runs: users are runs, event types their states."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvid.operators import evaluate, lexical, runs, validation
from corvid.plans.common import bm25_sql, table, tokens_sql

def _events(spark, d):
    return table(spark, d, "events")


def _gold(spark, d):
    """Gold documents of a passage: those that quote it; the category is the passage's id modulo 3."""
    from corvid.plans.texts import quote_in_chunk

    return quote_in_chunk(spark, d).withColumn("category", F.concat(F.lit("c"), (F.col("item_id") % 3).cast("string")))


def _ranked(spark, d):
    return lexical.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), "item_id", 20)


def mrr_recall_ndcg(spark, d):
    first = evaluate.first_ranks(_ranked(spark, d), _gold(spark, d), "item_id", "doc_id")
    return evaluate.single_gold(first)


def metrics_rollup(spark, d):
    first = evaluate.first_ranks(_ranked(spark, d), _gold(spark, d), "item_id", "doc_id")
    return evaluate.single_gold(first, by="category")


def all_hop_recall(spark, d):
    return evaluate.multi_summary(evaluate.multi_gold(_ranked(spark, d), _gold(spark, d), "item_id", "doc_id"))


def all_hop_per_query(spark, d):
    return evaluate.multi_gold(_ranked(spark, d), _gold(spark, d), "item_id", "doc_id")


def citation_metrics(spark, d):
    """Each query's first five documents as citations, its first ten as what it may cite, its quoting documents as gold."""
    hits = _ranked(spark, d).groupBy("item_id").agg(F.collect_list(F.when(F.col("rank") <= 5, F.col("doc_id"))).alias("cited"), F.collect_list(F.when((F.col("rank") > 2) & (F.col("rank") <= 12), F.col("doc_id"))).alias("allowed"))
    gold = _gold(spark, d).groupBy("item_id").agg(F.collect_set("doc_id").alias("gold"))
    rows = hits.join(gold, "item_id", "left").withColumn("gold", F.coalesce("gold", F.array().cast("array<bigint>")))
    m = evaluate.citation_metrics(F.col("cited"), F.col("allowed"), F.col("gold"))
    return rows.select("item_id", m.alias("m")).select("item_id", "m.precision", "m.recall", "m.invalid")


def answer_metrics(spark, d):
    """Conditional shares over conversations, empty where there is nothing to divide by."""
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "assistant").alias("answers"), F.sum(F.length("text")).alias("chars"))
    return rows.groupBy((F.col("turns") > 3).alias("long")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.try_divide("answers", "turns")), 6).alias("answered"), F.sum("chars").alias("chars"), F.round(F.try_divide(F.sum("chars"), F.sum("answers")), 4).alias("chars_per_answer"))


def coverage_snapshot(spark, d):
    """Passages whose gold documents are all within an index that ends at half of the documents."""
    top = table(spark, d, "documents").agg(F.floor(F.max("doc_id") / 2).alias("top"))
    rows = _gold(spark, d).crossJoin(F.broadcast(top)).groupBy("item_id").agg(F.max("doc_id").alias("last"), F.bool_and(F.col("doc_id") <= F.col("top")).alias("eligible"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("eligible").alias("eligible"), F.max("last").alias("last"))


def contiguity(spark, d):
    """Count, range and whether ids leave no gap, by table."""
    out = None
    for name, key in (("documents", "doc_id"), ("events", "event_id"), ("orders", "o_orderkey")):
        r = table(spark, d, name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"), F.countDistinct(key).alias("ids"))
        out = r if out is None else out.union(r)
    return out.withColumn("contiguous", F.col("hi") - F.col("lo") + 1 == F.col("ids"))


def duplicate_ids(spark, d):
    """Texts that several documents have: how many, and the first of them."""
    return table(spark, d, "documents").groupBy(F.md5("text").alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).filter("n > 1")


def candidate_union(spark, d):
    """Candidates of two sources with the first source's priority: passages' best documents, then documents that quote them."""
    a = _ranked(spark, d).filter("rank <= 3").select("item_id", "doc_id", F.lit(0).alias("priority"))
    b = _gold(spark, d).select("item_id", "doc_id", F.lit(1).alias("priority"))
    return a.unionByName(b).groupBy("item_id", "doc_id").agg(F.min("priority").alias("priority"))


def missing_documents(spark, d):
    """Gold documents that are not the ranking's first."""
    return _gold(spark, d).join(_ranked(spark, d).filter("rank = 1"), ["item_id", "doc_id"], "left_anti").select("item_id", "doc_id")


def pareto_frontier(spark, d):
    """Customers' nations and segments that no other such pair beats in both customers and mean balance."""
    rows = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"))
    return evaluate.pareto(rows, "n", "mean")


def speed_quality_join(spark, d):
    """Two measures of one key from two tables."""
    speed = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count(F.lit(1)).alias("orders"))
    return speed.join(table(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_acctbal"), "key")


def latest_event(spark, d):
    return runs.latest(_events(spark, d).select("user_id", "ts", "event_id", "event_type", "value"), "user_id", ["ts", "event_id"])


def event_sequence(spark, d):
    return runs.sequenced(_events(spark, d).select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "sequence")


def replay_after(spark, d):
    """Of every run what came after its third event."""
    return event_sequence(spark, d).filter("sequence > 3")


def run_view(spark, d):
    return runs.run_view(_events(spark, d), "user_id", "ts", "event_type", "click", ["purchase", "error"])


def state_transition_check(spark, d):
    """Events that may not follow the one before: a type may not repeat at once, and 'purchase' may only follow 'click' or 'view'."""
    types = ["click", "view", "purchase", "signup", "error", "login", "logout"]
    follows = {t: [x for x in types if x != t and (x != "purchase" or t in ("click", "view"))] for t in types}
    return runs.illegal(_events(spark, d).select("user_id", "event_id", "ts", "event_type"), "user_id", "event_type", ["ts", "event_id"], follows, types).select("user_id", "event_id", "event_type", "before")


def quota_24h(spark, d):
    return runs.quota(_events(spark, d).select("user_id", "event_id", "ts"), "user_id", "ts").select("user_id", "event_id", "used")


def quota_admission(spark, d):
    """Events that come when their user has had three or more in the 24 hours before."""
    return quota_24h(spark, d).filter("used > 3").groupBy("user_id").agg(F.count(F.lit(1)).alias("refused"))


def dedupe_idempotent(spark, d):
    """The first request of each user and client id (the value's whole part), and whether another one differs in type."""
    rows = _events(spark, d).select("user_id", F.floor("value").alias("client_id"), "event_id", "event_type")
    return runs.admitted(rows, "user_id", "client_id", ["event_type"], ["event_id"])


def review_queue(spark, d):
    """Orders as runs, line items' suppliers as reviewers: what supplier 1 has not seen, the first 200 in the queue's order."""
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_suppkey").alias("reviewer"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), "o_orderdate", "o_orderstatus")
    q = runs.review_queue(orders, items, "run", 1)
    return q.orderBy(F.desc(F.col("o_orderstatus") == "F"), "reviews", "o_orderdate", "run").limit(200).select("run", "reviews", "o_orderstatus")


def feedback_gate(spark, d):
    """Users whose last purchase came after their last click: they may go on."""
    rows = _events(spark, d).groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("reviewed"), F.max(F.when(F.col("event_type") == "click", F.col("ts"))).alias("ran"))
    return rows.select("user_id", (F.col("ran").isNull() | F.coalesce(F.col("reviewed") > F.col("ran"), F.lit(False))).alias("admitted"))


def visibility(spark, d):
    """Orders that customer group 3 may see: its own, and those that are dear (published) and finished; and what an administrator may."""
    o = table(spark, d, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "F", "succeeded").otherwise("started"))
    shown = [runs.visible(F.col("status"), F.col("o_totalprice") > 200000, F.col("o_custkey") % 7, 3, admin).alias(n) for n, admin in (("visible", False), ("to_admin", True))]
    return o.select("o_orderkey", *shown).groupBy("visible", "to_admin").agg(F.count(F.lit(1)).alias("n"))


def admission(spark, d):
    """Users as they stand at the events' last time, and why a request of theirs would be refused."""
    kind = F.element_at(F.array(*map(F.lit, ["queued", "started", "succeeded", "failed"])), (F.col("event_id") % 4 + 1).cast("int"))
    rows = _events(spark, d).select("user_id", F.floor("value").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"))
    now = rows.agg(F.max("ts")).first()[0]
    stand = runs.standing(rows, "run_id", "user_id", "ts", "kind", F.lit(now), hours=240)
    return stand.select("user_id", "used", "active", F.coalesce(runs.refusal(F.col("used"), F.col("active"), F.col("user_id") % 3, daily=3, most_active=4), F.lit("taken")).alias("refusal"))


def feedback_check(spark, d):
    """Feedback made of conversations: ratings of several kinds, and texts as comments, ten times over for some."""
    rating = F.element_at(F.array(*map(F.lit, ["correct", "partial", "incorrect", "good"])), (F.col("conv_id") % 4 + 1).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(validation.feedback_error(rating, F.repeat("text", (F.col("turn") * 5 + 1).cast("int"))), F.lit("ok")).alias("error"))


def event_props(spark, d):
    """A JSON payload's field, by type."""
    return _events(spark, d).select("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"))


def tumbling_window(spark, d):
    rows = _events(spark, d).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding_window(spark, d):
    rows = _events(spark, d).groupBy(F.window("ts", "2 days", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").alias("window_start"), "n")


def session_window(spark, d):
    rows = _events(spark, d).groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("w.start").alias("window_start"), "n")


def _streamed(spark, rows, name, mode="append"):
    """The stream's whole output as a table: written with a checkpoint to the shared folder, then read."""
    from corvid.sources.store import scratch

    base = scratch(spark, name)
    from corvid.streaming import events as E

    E.drain(rows, f"{base}/out", f"{base}/checkpoint", mode)
    return spark.read.parquet(f"{base}/out")


def streaming_tumbling(spark, d):
    """The tumbling windows as a stream with a watermark; the last windows are still open when it ends."""
    from corvid.streaming import events as E

    source = spark.readStream.schema(_events(spark, d).schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    return _streamed(spark, E.tumbling(source, "1 day", "1 hour"), "tumbling")


def stateful_event_log(spark, d):
    """A stream of run events through the state machine: what was accepted, and in which place."""
    from corvid.streaming import events as E

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = spark.readStream.schema(_events(spark, d).schema).option("pathGlobFilter", "events.parquet").parquet(d)
    kind = F.element_at(F.array(*map(F.lit, ["queued", "started", "succeeded", "failed"])), (F.col("event_id") % 4 + 1).cast("int"))
    rows = source.select(F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("run_id"), "event_id", kind.alias("kind"), F.col("ts").cast("timestamp").alias("at"))
    return _streamed(spark, E.run_log(rows), "runs")


def coverage_requirements(spark, d):
    """What questions ask for by name; the questions are made of a few phrases and the passages here."""
    import pandas as pd

    from corvid.operators import coverage

    phrases = ["¿Qué cambió entre 2019 y 2021?", "Plan Nacional de Desarrollo 2013-2018 y 2019-2024", "la NOM-001-SSA1-2010, numerales 5.2 y 5.3 transitorios", "reforma de pensiones de marzo de 2020", "más de 15 y hasta 50, diario y mensual"]

    def run(texts):
        return texts.map(lambda t: [str(n) for n in coverage.needs(t)])

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    question = F.concat(F.element_at(F.array(*map(F.lit, phrases)), (F.col("item_id") % 5 + 1).cast("int")), F.lit(" "), F.col("text"))
    return table(spark, d, "benchmark").select("item_id", F.pandas_udf(run, "array<string>")(question).alias("requirements"))


def document_headers(spark, d):
    """Institution and title of each document, from its first lines."""
    from corvid.functions import headers

    return headers.with_headers(table(spark, d, "documents")).select("doc_id", "institution", "title")


QUERIES = {f.__name__: f for f in (mrr_recall_ndcg, metrics_rollup, all_hop_recall, all_hop_per_query, citation_metrics, answer_metrics, coverage_snapshot, contiguity, duplicate_ids, candidate_union, missing_documents, pareto_frontier, speed_quality_join, latest_event, event_sequence, replay_after, run_view, state_transition_check, quota_24h, quota_admission, dedupe_idempotent, review_queue, feedback_gate, visibility, admission, feedback_check, event_props, tumbling_window, sliding_window, session_window, streaming_tumbling, stateful_event_log, coverage_requirements, document_headers)}

_GOLD = f"""
    gb AS (SELECT item_id, array_to_string({tokens_sql("text")}, ' ') AS q, len({tokens_sql("text")}) AS n FROM benchmark),
    gd AS (SELECT doc_id, array_to_string({tokens_sql("text")}, ' ') AS x FROM documents),
    gold AS (SELECT item_id, doc_id, 'c' || item_id % 3 AS category FROM gb, gd WHERE n >= 8 AND contains(' ' || x || ' ', ' ' || q || ' '))"""
_EVAL = f"""{bm25_sql('1', 20)}, {_GOLD},
    firsts AS (SELECT g.item_id, g.category, min(b.rank) AS first FROM gold g LEFT JOIN best b USING (item_id, doc_id) GROUP BY ALL),
    f10 AS (SELECT *, CASE WHEN first <= 10 THEN first END AS r FROM firsts)"""
_SINGLE = """count(*) AS n, round(avg(coalesce(1 / r, 0)), 6) AS mrr, round(avg(coalesce(1 / log2(r + 1), 0)), 6) AS ndcg,
    round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_10"""
_MULTI = f"""{_EVAL},
    multi AS (SELECT g.item_id, count(*) AS gold, min(b.rank) AS first, count(CASE WHEN b.rank <= 5 THEN 1 END) AS hit_5, count(CASE WHEN b.rank <= 10 THEN 1 END) AS hit_10, count(CASE WHEN b.rank <= 20 THEN 1 END) AS hit_20
              FROM (SELECT DISTINCT item_id, doc_id FROM gold) g LEFT JOIN best b USING (item_id, doc_id) GROUP BY g.item_id)"""
_SEQ = "seq AS (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS sequence FROM events)"
_QUOTA = "q AS (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS used FROM events)"

ORACLE = {
    "mrr_recall_ndcg": f"WITH {_EVAL} SELECT {_SINGLE} FROM f10",
    "metrics_rollup": f"WITH {_EVAL} SELECT category, {_SINGLE} FROM f10 GROUP BY ROLLUP (category)",
    "all_hop_per_query": f"WITH {_MULTI} SELECT * FROM multi",
    "all_hop_recall": f"WITH {_MULTI} SELECT count(*) AS n, round(avg(coalesce(1 / first, 0)), 6) AS mrr, "
    + ", ".join(f"round(avg(CASE WHEN hit_{k} > 0 THEN 1.0 ELSE 0 END), 6) AS any_{k}, round(avg(hit_{k} / gold), 6) AS recall_{k}, round(avg(CASE WHEN hit_{k} = gold THEN 1.0 ELSE 0 END), 6) AS all_{k}" for k in (5, 10, 20))
    + " FROM multi",
    "citation_metrics": f"""WITH {_EVAL},
        h AS (SELECT item_id, count(CASE WHEN rank <= 5 THEN 1 END) AS cited, count(CASE WHEN rank <= 2 THEN 1 END) AS invalid FROM best GROUP BY item_id),
        g AS (SELECT item_id, count(*) AS gold FROM gold GROUP BY item_id), o AS (SELECT b.item_id, count(*) AS good FROM best b JOIN gold USING (item_id, doc_id) WHERE rank <= 5 GROUP BY b.item_id)
        SELECT item_id, round(coalesce(good, 0) / nullif(cited, 0), 6) AS precision, round(coalesce(good, 0) / nullif(coalesce(gold, 0), 0), 6) AS recall, CAST(invalid AS INTEGER) AS invalid FROM h LEFT JOIN g USING (item_id) LEFT JOIN o USING (item_id)""",
    "answer_metrics": """
        WITH c AS (SELECT conv_id, count(*) AS turns, count(CASE WHEN role = 'assistant' THEN 1 END) AS answers, sum(length(text)) AS chars FROM conversations GROUP BY conv_id)
        SELECT turns > 3 AS long, count(*) AS n, round(avg(answers / turns), 6) AS answered, CAST(sum(chars) AS BIGINT) AS chars, round(sum(chars) / nullif(sum(answers), 0), 4) AS chars_per_answer FROM c GROUP BY ALL""",
    "coverage_snapshot": f"""WITH {_GOLD}, t AS (SELECT max(doc_id) // 2 AS top FROM documents), r AS (SELECT item_id, max(doc_id) AS last, bool_and(doc_id <= top) AS eligible FROM gold, t GROUP BY item_id)
        SELECT count(*) AS n, count(CASE WHEN eligible THEN 1 END) AS eligible, max(last) AS last FROM r""",
    "contiguity": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n, min({k}) AS lo, max({k}) AS hi, count(DISTINCT {k}) AS ids, max({k}) - min({k}) + 1 = count(DISTINCT {k}) AS contiguous FROM {n}" for n, k in (("documents", "doc_id"), ("events", "event_id"), ("orders", "o_orderkey"))),
    "duplicate_ids": "SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY ALL HAVING count(*) > 1",
    "candidate_union": f"WITH {_EVAL} SELECT item_id, doc_id, CAST(min(p) AS INTEGER) AS priority FROM (SELECT item_id, doc_id, 0 AS p FROM best WHERE rank <= 3 UNION ALL SELECT item_id, doc_id, 1 FROM gold) GROUP BY ALL",
    "missing_documents": f"WITH {_EVAL} SELECT item_id, doc_id FROM gold ANTI JOIN (SELECT * FROM best WHERE rank = 1) USING (item_id, doc_id)",
    "pareto_frontier": """
        WITH r AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY ALL)
        SELECT c_nationkey, c_mktsegment, n, mean FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE (b.n > a.n AND b.mean >= a.mean) OR (b.n = a.n AND b.mean > a.mean))""",
    "speed_quality_join": "SELECT c_custkey AS key, count(*) AS orders, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
    "latest_event": "SELECT user_id, ts, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "event_sequence": f"WITH {_SEQ} SELECT * FROM seq",
    "replay_after": f"WITH {_SEQ} SELECT * FROM seq WHERE sequence > 3",
    "run_view": """
        WITH l AS (SELECT user_id, event_type AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1)
        SELECT user_id, any_value(status) AS status, min(CASE WHEN event_type = 'click' THEN ts END) AS started_at, max(CASE WHEN event_type IN ('purchase', 'error') THEN ts END) AS completed_at, count(*) AS n_events FROM events JOIN l USING (user_id) GROUP BY user_id""",
    "state_transition_check": """
        WITH b AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
        SELECT user_id, event_id, event_type, before FROM b WHERE before IS NOT NULL AND (event_type = before OR (event_type = 'purchase' AND before NOT IN ('click', 'view')))
           OR (before IS NULL AND event_type NOT IN ('click', 'view', 'purchase', 'signup', 'error', 'login', 'logout'))""",
    "quota_24h": f"WITH {_QUOTA} SELECT * FROM q",
    "quota_admission": f"WITH {_QUOTA} SELECT user_id, count(*) AS refused FROM q WHERE used > 3 GROUP BY user_id",
    "dedupe_idempotent": """
        WITH r AS (SELECT user_id, CAST(floor(value) AS BIGINT) AS client_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, floor(value) ORDER BY event_id) AS k FROM events),
        c AS (SELECT user_id, client_id, count(DISTINCT event_type) > 1 AS conflict FROM r GROUP BY ALL)
        SELECT user_id, client_id, event_id, event_type, conflict FROM r JOIN c USING (user_id, client_id) WHERE k = 1""",
    "review_queue": """
        WITH o AS (SELECT o_orderkey AS run, o_orderdate, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 1)),
        c AS (SELECT l_orderkey AS run, count(*) AS reviews FROM lineitem GROUP BY ALL)
        SELECT run, coalesce(reviews, 0) AS reviews, o_orderstatus FROM o LEFT JOIN c USING (run) ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, reviews, o_orderdate, run LIMIT 200""",
    "feedback_gate": """
        WITH r AS (SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN ts END) AS reviewed, max(CASE WHEN event_type = 'click' THEN ts END) AS ran FROM events GROUP BY user_id)
        SELECT user_id, ran IS NULL OR coalesce(reviewed > ran, false) AS admitted FROM r""",
    "visibility": "SELECT (o_orderstatus = 'F' AND o_totalprice > 200000) OR o_custkey % 7 = 3 AS visible, true AS to_admin, count(*) AS n FROM orders GROUP BY ALL",
    "admission": """
        WITH e AS (SELECT user_id, CAST(floor(value) AS BIGINT) AS run_id, ts, (['queued', 'started', 'succeeded', 'failed'])[event_id % 4 + 1] AS kind FROM events), n AS (SELECT max(ts) AS now FROM e),
        r AS (SELECT user_id, run_id, min(ts) AS asked, max_by(kind, (ts, kind)) AS status FROM e GROUP BY ALL),
        s AS (SELECT user_id, count(CASE WHEN asked > now - INTERVAL 240 HOUR THEN 1 END) AS used, count(CASE WHEN status IN ('queued', 'started') THEN 1 END) AS active FROM r, n GROUP BY user_id)
        SELECT *, CASE WHEN active >= 4 THEN 'active' WHEN used >= 3 THEN 'quota' WHEN user_id % 3 > 0 THEN 'unreviewed' ELSE 'taken' END AS refusal FROM s""",
    "feedback_check": "SELECT conv_id, turn, CASE WHEN conv_id % 4 = 3 THEN 'rating' WHEN length(text) * (turn * 5 + 1) > 2000 THEN 'comment' ELSE 'ok' END AS error FROM conversations",
    "event_props": "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY event_type",
    "streaming_tumbling": "SELECT * FROM (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL) WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
    "stateful_event_log": """
        WITH RECURSIVE e AS (SELECT user_id, event_id, (['queued', 'started', 'succeeded', 'failed'])[event_id % 4 + 1] AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
        r AS (SELECT user_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, '' AS kind, false AS accepted, '' AS last, CAST(0 AS BIGINT) AS n FROM (SELECT DISTINCT user_id FROM events)
              UNION ALL
              SELECT user_id, k, event_id, kind, good, CASE WHEN good THEN kind ELSE last END, n + CASE WHEN good THEN 1 ELSE 0 END FROM (
                  SELECT r.user_id, e.k, e.event_id, e.kind, r.last, r.n, (r.last = '' AND e.kind = 'queued') OR (r.last = 'queued' AND e.kind IN ('started', 'failed')) OR (r.last = 'started' AND e.kind IN ('succeeded', 'failed')) AS good
                  FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1))
        SELECT 'run' || user_id AS run_id, event_id, kind, accepted, CASE WHEN accepted THEN n END AS sequence FROM r WHERE k > 0""",
    "tumbling_window": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "sliding_window": """
        SELECT window_start, count(*) AS n FROM (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) - d * INTERVAL 1 DAY AS window_start FROM events, (SELECT unnest([0, 1]) AS d)) GROUP BY window_start""",
    "session_window": """
        WITH b AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
        s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM b)
        SELECT user_id, min(ts) AS window_start, count(*) AS n FROM s GROUP BY user_id, s""",
}
