"""What the query modules share: tables and pieces of the comparison SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dated(docs: DataFrame) -> DataFrame:
    """doc_id with a date and a section, which the tables don't have, made from the id."""
    return docs.select("doc_id", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 1500).cast("int")).alias("publication_date"), F.when(F.col("doc_id") % 2 == 0, "MAT").otherwise("VES").alias("section"))


def tokens_sql(column: str) -> str:
    return rf"regexp_extract_all(strip_accents(replace(lower({column}), 'ß', 'ss')), '[\p{{L}}\p{{N}}]+')"


DATED_SQL = "SELECT doc_id, CAST(DATE '2020-01-01' + CAST(doc_id % 1500 AS INTEGER) AS DATE) AS publication_date, CASE WHEN doc_id % 2 = 0 THEN 'MAT' ELSE 'VES' END AS section FROM documents"



def lexical_sql(docs: str = "documents", queries: str = "benchmark", key: str = "item_id") -> str:
    """Postings, document statistics, query terms and pruned terms of the queries (the benchmark passages) against the documents."""
    return f"""
    d AS (SELECT doc_id, {tokens_sql("text")} AS toks FROM {docs}),
    stats AS (SELECT doc_id, CAST(len(toks) AS BIGINT) AS dl FROM d),
    size AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM stats),
    occ AS (SELECT doc_id, unnest(toks) AS term FROM d),
    post AS (SELECT term, doc_id, count(*) AS tf FROM occ GROUP BY ALL),
    vocab AS (SELECT term, count(*) AS df FROM post GROUP BY ALL),
    qocc AS (SELECT {key}, unnest({tokens_sql("text")}) AS term FROM {queries}),
    qterms AS (SELECT {key}, term, count(*) AS weight FROM qocc GROUP BY ALL),
    qdf AS (SELECT q.{key}, q.term, q.weight, coalesce(v.df, 0) AS df, n_docs, avgdl,
                   coalesce(v.df, 0) <= floor(n_docs * 0.5) AS keep
            FROM qterms q LEFT JOIN vocab v USING (term), size),
    pruned AS (SELECT * FROM (SELECT *, max(CAST(keep AS INTEGER)) OVER (PARTITION BY {key}) AS any_kept FROM qdf) WHERE keep OR any_kept = 0)"""


LEXICAL_SQL = lexical_sql()
IDF_SQL = "CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) > 0 THEN ln((n_docs - df + 0.5) / (df + 0.5)) ELSE 1e-6 END"


def bm25_sql(weight: str, k: int, docs: str = "documents", queries: str = "benchmark", key: str = "item_id", kept: str = "true") -> str:
    """The ranking; ``kept`` is a condition on doc_id that takes effect after scoring and before the cut."""
    return f"""{lexical_sql(docs, queries, key)},
    scored AS (
        SELECT p.{key}, t.doc_id, round(sum({weight} * {IDF_SQL} * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
        FROM pruned p JOIN post t USING (term) JOIN stats s ON s.doc_id = t.doc_id GROUP BY ALL),
    best AS (
        SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {key} ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE {kept}) WHERE rank <= {k})"""
