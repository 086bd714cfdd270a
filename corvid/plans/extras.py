"""Queries of the smaller operators: images, validation, seeding, embeddings, context."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvid.functions import images
from corvid.functions import text as T
from corvid.operators import agent, coverage, embedding, lexical, search, validation
from corvid.plans.common import bm25_sql, table, tokens_sql
from corvid.plans.texts import _IMAGES, _prefixed_sql
from corvid.plans.vectors import _BASE, l2_topk


def _illustrated(spark, d):
    """Documents with two images: one in the text's middle, one that is described already or points elsewhere."""
    ref = F.concat(F.lit("img/"), F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, [".png", ".txt", ".JPG"])), (F.col("doc_id") % 3 + 1).cast("int")))
    other = F.when(F.col("doc_id") % 2 == 0, "<!-- IMAGE_DESCRIPTION: b.png\nx\n-->\n![](b.png)").otherwise("![b](https://x.org/b.png)")
    return table(spark, d, "documents").select("doc_id", F.concat("text", F.lit("\n![a]("), ref, F.lit(")\n"), "text", F.lit("\n"), other).alias("text"))


def image_tasks(spark, d):
    return images.tasks(_illustrated(spark, d)).select("doc_id", "position", "alt", "ref", F.md5("surrounding").alias("surrounding"))


def image_descriptions(spark, d):
    """Two descriptions put in one after another; of some texts the second image is not there."""
    text = F.concat(F.lit("x ![](a.png) y ![](a.png) "), F.col("text"), F.when(F.col("doc_id") % 3 != 0, "![Fig](b.png)").otherwise(""))
    found = F.array(F.struct(F.lit("a.png").alias("ref"), F.lit("").alias("alt"), F.lit("A chart. It rises.").alias("description")), F.struct(F.lit("b.png").alias("ref"), F.lit("Fig").alias("alt"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("description")))
    return table(spark, d, "documents").select("doc_id", F.md5(images.described_all(text, found)).alias("digest"))


def image_paths(spark, d):
    from corvid.plans.texts import _IMAGES, _prefixed

    return table(spark, d, "documents").select("doc_id", F.md5(images.rewritten(_prefixed(_IMAGES), "media")).alias("digest"))


def request_validation(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", F.when(F.col("turn") % 3 == 0, "2024-02-30").when(F.col("turn") % 3 == 1, "2024-02-28").alias("as_of"), (F.col("conv_id") % 7).alias("hops"), F.concat(F.lit("c"), F.when(F.col("conv_id") % 5 == 0, " ").otherwise(":"), F.col("conv_id").cast("string")).alias("client"))
    return rows.select("conv_id", "turn", F.coalesce(validation.request_error(F.col("text"), F.col("as_of"), F.col("hops"), F.col("client")), F.lit("ok")).alias("error"))


def fatal_errors(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ["AuthenticationError", "Timeout", "RateLimit"])), (F.col("event_id") % 3 + 1).cast("int"))
    details = F.when(F.col("event_id") % 4 == 0, "Insufficient_Quota for key").otherwise(F.col("event_type"))
    return table(spark, d, "events").groupBy(validation.fatal(kind, details).alias("fatal")).agg(F.count(F.lit(1)).alias("n"))


def gold_validation(spark, d):
    rows = table(spark, d, "benchmark").select((F.col("item_id") - (F.col("item_id") % 10 == 9).cast("int")).alias("id"), F.concat(F.lit("c"), (F.col("item_id") % 4).cast("string")).alias("category"), (F.col("item_id") % 3 + 1).alias("required_hops"), (F.col("item_id") % 2 + 1).alias("n_gold"), F.when(F.col("item_id") % 8 != 0, F.col("text")).alias("answer"))
    return validation.gold_errors(rows, ["c0", "c1", "c2"], 10)


def seed_plan(spark, d):
    questions = table(spark, d, "orders").select(F.col("o_orderkey").alias("client_id"))
    state = F.element_at(F.array(*map(F.lit, ["succeeded", "failed", "queued"])), (F.col("n") % 3 + 1).cast("int"))
    runs = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("client_id")).agg(F.count(F.lit(1)).alias("n")).select("client_id", state.alias("status"))
    return validation.seed_plan(questions, runs).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def published_runs(spark, d):
    action = F.element_at(F.array(*map(F.lit, ["publish", "unpublish", "publish", "delete"])), (F.col("event_id") % 4 + 1).cast("int"))
    return validation.published(table(spark, d, "events").select("user_id", "event_id", action.alias("action")), "user_id", ["event_id"])


def vector_bytes(spark, d):
    """Vectors stored as bytes and read back: their size, and the sum and the last of their values."""
    rows = table(spark, d, "embeddings").select("vec_id", embedding.to_bytes("embedding").alias("raw"))
    back = embedding.from_bytes("raw")
    return rows.select("vec_id", F.octet_length("raw").alias("bytes"), F.round(F.aggregate(back, F.lit(0.0), lambda s, x: s + x), 4).alias("total"), F.round(F.element_at(back, -1).cast("double"), 6).alias("last"))


def embed_documents(spark, d):
    """The stand-in model over all documents; every vector has unit length or is zero."""
    rows = embedding.embedded(table(spark, d, "documents"), agent.HashEmbedder, "doc_id", "text", prefix="Document: ")
    return rows.select("doc_id", F.size("embedding").alias("dims"), F.col("error"))


def nearest_with_context(spark, d):
    """The nearest vector (L2) of each query and its neighbours on both sides by id."""
    best = l2_topk(spark, d).filter("vec_id <> query_id")
    best = best.groupBy("query_id").agg(F.min_by("vec_id", "rank").alias("vec_id"))
    near = best.select("query_id", F.explode(F.sequence(F.col("vec_id") - 1, F.col("vec_id") + 1)).alias("vec_id"))
    return near.join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id").select("query_id", "vec_id", "label")


def evidence_context(spark, d):
    """The two best documents of each query as one text for a reader."""
    best = lexical.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), "item_id", 2).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    rows = search.context(best.select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("chunk_id"), "rank", "text"))
    return rows.select("query_id", F.md5("context").alias("digest"))


def answer_snippets(spark, d):
    """Passages' words in a row as a query, and the part of the best document around them, by the agent's rule."""
    import pandas as pd

    best = lexical.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), "item_id", 1)
    rows = best.join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").join(table(spark, d, "benchmark").select("item_id", F.col("text").alias("query")), "item_id")

    def run(text: pd.Series, query: pd.Series) -> pd.Series:
        return pd.Series([coverage.snippet(t, q, 400)[0] for t, q in zip(text, query, strict=True)])

    run.__annotations__ = {"text": pd.Series, "query": pd.Series, "return": pd.Series}
    return rows.select("item_id", "doc_id", F.pandas_udf(run, "string")("text", "query").alias("snippet"))


def title_resolution(spark, d):
    """A record's own title, else the text's first heading, else its id."""
    own = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("T"), F.col("doc_id").cast("string")))
    text = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("# H"), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text"))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", T.resolved_title(own, text, F.col("doc_id")).alias("title"))


def ordered_distinct(spark, d):
    """Words of a text, each at its first place."""
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.array_distinct(T.tokens("text")), " ").alias("words"))


QUERIES = {f.__name__: f for f in (image_tasks, image_descriptions, image_paths, request_validation, fatal_errors, gold_validation, seed_plan, published_runs, vector_bytes, embed_documents, nearest_with_context, evidence_context, answer_snippets, title_resolution, ordered_distinct)}

ORACLE = {
    "ordered_distinct": f"""
        WITH u AS (SELECT item_id, unnest({tokens_sql("text")}) AS term, generate_subscripts({tokens_sql("text")}, 1) AS pos FROM benchmark), f AS (SELECT item_id, term, min(pos) AS pos FROM u GROUP BY ALL),
        g AS (SELECT item_id, string_agg(term, ' ' ORDER BY pos) AS words FROM f GROUP BY item_id) SELECT b.item_id, coalesce(words, '') AS words FROM benchmark b LEFT JOIN g USING (item_id)""",
    "image_tasks": """
        SELECT doc_id, CAST(0 AS INTEGER) AS position, 'a' AS alt, 'img/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.png' ELSE '.JPG' END AS ref,
               md5(trim(right(text || chr(10), 800) || left(chr(10) || text || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '<!-- IMAGE_DESCRIPTION: b.png' || chr(10) || 'x' || chr(10) || '-->' || chr(10) ELSE '' END, 200))) AS surrounding
        FROM documents WHERE doc_id % 3 <> 1""",
    "image_descriptions": """SELECT doc_id, md5('x <!-- IMAGE_DESCRIPTION: a.png' || chr(10) || 'A chart. It rises.' || chr(10) || '-->' || chr(10) || '![A chart](a.png) y ![](a.png) ' || text
        || CASE WHEN doc_id % 3 <> 0 THEN '<!-- IMAGE_DESCRIPTION: b.png' || chr(10) || 'Doc ' || doc_id || chr(10) || '-->' || chr(10) || '![Fig](b.png)' ELSE '' END) AS digest FROM documents""",
    "image_paths": r"""SELECT doc_id, md5(regexp_replace(regexp_replace(@T, '!\[([^\]]*)\]\((?:[^)\s]*/)?([^)/\s]+)\)', '![\1](media/\2)', 'g'), '(!\[[^\]]*\]\([^)]*\))\{[^}]*\}', '\1', 'g')) AS digest FROM documents""".replace("@T", _prefixed_sql(_IMAGES)),
    "request_validation": """
        SELECT conv_id, turn, CASE WHEN length(trim(text)) NOT BETWEEN 3 AND 2000 THEN 'question' WHEN turn % 3 = 0 THEN 'as_of' WHEN conv_id % 7 NOT BETWEEN 1 AND 5 THEN 'required_hops'
               WHEN conv_id % 5 = 0 THEN 'client_request_id' ELSE 'ok' END AS error FROM conversations""",
    "fatal_errors": "SELECT event_id % 3 = 0 OR event_id % 4 = 0 AS fatal, count(*) AS n FROM events GROUP BY ALL",
    "gold_validation": """
        WITH r AS (SELECT item_id - CASE WHEN item_id % 10 = 9 THEN 1 ELSE 0 END AS id, 'c' || item_id % 4 AS category, item_id % 3 + 1 AS hops, item_id % 2 + 1 AS n_gold, item_id % 8 <> 0 AS answered FROM benchmark)
        SELECT id, 'category' AS problem FROM r WHERE category = 'c3' UNION ALL SELECT id, 'required_hops' FROM r WHERE hops > n_gold UNION ALL SELECT id, 'reference_answer' FROM r WHERE NOT answered
        UNION ALL SELECT id, 'repeated' FROM r GROUP BY id HAVING count(*) > 1 UNION ALL SELECT NULL, 'size of ' || category FROM r GROUP BY category HAVING count(*) <> 10""",
    "seed_plan": """
        WITH r AS (SELECT l_orderkey AS k, count(*) % 3 AS s FROM lineitem GROUP BY ALL)
        SELECT CASE s WHEN 0 THEN 'skip' WHEN 1 THEN 'retry' WHEN 2 THEN 'pending' ELSE 'create' END AS action, count(*) AS n FROM orders LEFT JOIN r ON k = o_orderkey GROUP BY ALL""",
    "published_runs": "SELECT user_id, max(event_id) % 4 IN (0, 2) AS published FROM events GROUP BY user_id HAVING max(event_id) % 4 <> 3",
    "vector_bytes": "SELECT vec_id, CAST(4 * len(embedding) AS INTEGER) AS bytes, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total, round(CAST(embedding[-1] AS DOUBLE), 6) AS last FROM embeddings",
    "nearest_with_context": f"""WITH {_BASE}, x AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(sqrt(dd), 6), vec_id) AS k FROM raw WHERE vec_id <> query_id), b AS (SELECT query_id, vec_id AS nearest FROM x WHERE k = 1)
        SELECT query_id, e.vec_id, e.label FROM b JOIN e ON e.vec_id BETWEEN nearest - 1 AND nearest + 1""",
    "evidence_context": f"""WITH {bm25_sql('1', 2)} SELECT item_id AS query_id, md5(string_agg('[CHUNK ' || doc_id || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS digest FROM best JOIN documents USING (doc_id) GROUP BY item_id""",
    "title_resolution": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'T' || doc_id WHEN 1 THEN 'H' || doc_id ELSE coalesce(nullif(trim(regexp_extract(text, '(?m)^# (.+)$', 1)), ''), CAST(doc_id AS VARCHAR)) END AS title FROM documents",
}
