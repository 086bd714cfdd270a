"""A persisted inverted index: postings, vocabulary and sizes as Parquet tables that grow by batches.

Postings lie in buckets of terms, so a search reads the buckets of its own terms only, and within them the row groups that hold
them. A batch counts once its row in the table of sizes is written, which comes last: what an append that failed left behind is
never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.operators import lexical
from corvid.sources.store import exists

#: Buckets of terms; terms up to which a search names them to the scan; postings in a file, about.
BUCKETS, NAMED_TERMS, FILE_ROWS = 64, 500, 5_000_000


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


#: Columns of each table beside the id and the folders' own.
SIZES, LENGTHS, POSTINGS, VOCABULARY = "batch string, n_docs bigint, tokens bigint", "{id} {kind}, dl bigint, batch string", "term string, {id} {kind}, tf bigint, dl bigint, batch string, bucket int", "term string, df bigint, batch string, bucket int"


def batches(spark: SparkSession, path: str) -> DataFrame:
    """(batch, n_docs, tokens) of every batch that is complete."""
    return spark.read.schema(SIZES).parquet(f"{path}/sizes") if exists(spark, f"{path}/sizes") else spark.createDataFrame([], SIZES)


def _complete(spark: SparkSession, path: str, name: str, schema: str, id_col: str = "doc_id", kind: str = "bigint") -> DataFrame:
    schema = schema.format(id=id_col, kind=kind)
    done = [r["batch"] for r in batches(spark, path).select("batch").collect()]  # one for each append
    if not exists(spark, f"{path}/{name}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{name}").filter(F.col("batch").isin(done))


def append(docs: DataFrame, path: str, id_col: str = "doc_id") -> int:
    """Index the documents (id, text) that the index doesn't have yet, each id once; returns their number. Repeating it adds
    nothing. Of rows that share an id within a batch the one with the greatest text counts."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    new = docs.select(id_col, "text")
    if not batches(spark, path).isEmpty():
        new = new.join(_complete(spark, path, "lengths", LENGTHS, id_col, kind).select(id_col), id_col, "left_anti")
    new = new.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("text").alias("text"))
    batch = uuid.uuid4().hex
    lexical.doc_stats(new, id_col).write.option("compression", "zstd").parquet(f"{path}/lengths/batch={batch}")
    lengths_ = spark.read.schema(f"{id_col} {kind}, dl bigint").parquet(f"{path}/lengths/batch={batch}")
    n, tokens = lengths_.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    if not n:
        return 0
    rows = lexical.postings(new, id_col).withColumn("bucket", bucket_of(F.col("term")))
    # Ranges, not hashes, so the postings of a frequent term are split by document.
    rows = rows.repartitionByRange("bucket", "term", id_col).sortWithinPartitions("bucket", "term", id_col)
    rows.write.option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS).partitionBy("bucket").parquet(f"{path}/postings/batch={batch}")
    written = spark.read.schema(POSTINGS.format(id=id_col, kind=kind)).parquet(f"{path}/postings/batch={batch}")
    written.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df")).write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/vocabulary/batch={batch}")
    spark.createDataFrame([(batch, n, tokens)], SIZES).write.mode("append").parquet(f"{path}/sizes")
    return n


def append_stream(source: DataFrame, path: str, checkpoint: str, id_col: str = "doc_id") -> None:
    """Index what is new in a stream of documents and stop; the next call goes on from there."""
    query = source.writeStream.foreachBatch(lambda df, _: append(df, path, id_col)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def postings(spark: SparkSession, path: str) -> DataFrame:
    return _complete(spark, path, "postings", POSTINGS).drop("batch", "bucket")


def lengths(spark: SparkSession, path: str) -> DataFrame:
    return _complete(spark, path, "lengths", LENGTHS).drop("batch")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(term, df) over all batches."""
    return _complete(spark, path, "vocabulary", VOCABULARY).groupBy("term").agg(F.sum("df").alias("df"))


def corpus_size(spark: SparkSession, path: str) -> DataFrame:
    """One row: n_docs and avgdl."""
    return batches(spark, path).agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.try_divide(F.sum("tokens"), F.sum("n_docs")).alias("avgdl"))


def matching(spark: SparkSession, path: str, terms: DataFrame) -> DataFrame:
    """The postings of the given terms: from their buckets only, and where they are few from the row groups that have them."""
    terms = terms.select("term").distinct()
    rows = _complete(spark, path, "postings", POSTINGS)
    named = [r["term"] for r in terms.limit(NAMED_TERMS + 1).collect()]
    if len(named) <= NAMED_TERMS:
        wanted = [r[0] for r in spark.createDataFrame([(t,) for t in named], "term string").select(bucket_of(F.col("term"))).distinct().collect()]
        return rows.filter(F.col("bucket").isin(wanted) & F.col("term").isin(named)).drop("batch", "bucket")
    wanted = [r[0] for r in terms.select(bucket_of(F.col("term")).alias("b")).distinct().collect()]
    return rows.filter(F.col("bucket").isin(wanted)).join(terms, "term", "left_semi").drop("batch", "bucket")


def bm25(spark: SparkSession, path: str, queries: DataFrame, query_id: str, k: int, id_col: str = "doc_id", distinct: bool = True, keep: DataFrame | None = None) -> DataFrame:
    """The ranking of ``lexical.bm25`` from the index: no document is read."""
    wanted = lexical.query_terms(queries, query_id, distinct)
    return lexical.scored(matching(spark, path, wanted), wanted, corpus_size(spark, path), query_id, k, id_col, keep)
