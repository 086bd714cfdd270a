"""The corpus store: append-only Parquet tables, written so that a run that is repeated adds nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a document beyond which it is kept in segments.
SEGMENT_CHARS = 4_000_000


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share. Where that is unset, a local session gets a
    temporary folder of its machine; on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corvid-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def held(rows: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows written to a new folder and read again, and the folder: what reads them has a plan of its own."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def append_new(rows: DataFrame, path: str, keys: list[str], partition_by: list[str] | None = None) -> DataFrame:
    """Append the rows whose keys the table doesn't have yet, one for each key; returns what was new."""
    spark = rows.sparkSession
    new = rows.dropDuplicates(keys)
    if exists(spark, path):
        new = new.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    writer = new.write.mode("append").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return new


def replace_partitions(rows: DataFrame, path: str, partition_by: list[str]) -> None:
    """Upsert by whole partitions: those that ``rows`` has are rewritten, the others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def append_documents(rows: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> int:
    """Append the documents that the table doesn't have yet, in a batch with a row in the log beside it; returns how many."""
    spark = rows.sparkSession
    batch = uuid.uuid4().hex
    new = rows.dropDuplicates([key])
    if exists(spark, f"{path}/documents"):
        new = new.join(spark.read.parquet(f"{path}/documents").select(key), key, "left_anti")
    new.withColumn("batch", F.lit(batch)).write.mode("append").option("compression", "zstd").partitionBy("batch").parquet(f"{path}/documents")
    n, size = spark.read.schema(rows.schema).parquet(f"{path}/documents/batch={batch}").agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first() if exists(spark, f"{path}/documents/batch={batch}") else (0, 0)
    if n:
        entry = spark.range(1).select(F.lit(batch).alias("batch"), F.current_timestamp().alias("finished_at"), F.lit(n).alias("docs_inserted"), F.lit(size).alias("bytes_inserted"))
        entry.write.mode("append").parquet(f"{path}/log")
    return n


def append_chunks(chunks: DataFrame, path: str, version: str, key: str = "doc_id") -> DataFrame:
    """Append the chunks that a chunker's version has not made yet, so a run that was broken off goes on; returns what was new."""
    return append_new(chunks.withColumn("chunker_version", F.lit(version)), path, [key, "chunk_index", "chunker_version"], ["chunker_version"])


def append_vectors(vectors: DataFrame, path: str, settings: dict[str, str], key: str = "chunk_id") -> DataFrame:
    """Append the vectors that the table doesn't have yet; a table that was made with other settings is an error."""
    spark = vectors.sparkSession
    if exists(spark, f"{path}/settings"):
        guard({r["key"]: r["value"] for r in spark.read.parquet(f"{path}/settings").collect()}, settings)
    else:
        spark.createDataFrame(list(settings.items()), "key string, value string").coalesce(1).write.parquet(f"{path}/settings")
    return append_new(vectors, f"{path}/vectors", [key])


#: Parts that a table of documents is kept in, so that a document can be replaced.
PARTS = 64


def upsert(rows: DataFrame, path: str, key: str = "doc_id", parts: int = PARTS) -> None:
    """Put the rows in place of all that the table has of their keys (a document's chunks, too); other keys stay as they are.

    The table is kept in parts by the key's hash. Only parts that a new key falls into are read and written anew, by way of a
    folder of their own, as a part can't be read and overwritten at once.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    if exists(spark, path):
        touched = [r[0] for r in rows.select("part").distinct().collect()]
        old = spark.read.parquet(path).filter(F.col("part").isin(touched)).join(rows.select(key).distinct(), key, "left_anti")
        between = scratch(spark, "upsert")
        rows.unionByName(old).write.parquet(between)
        rows = spark.read.parquet(between)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("part").parquet(path)


def segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SEGMENT_CHARS) -> DataFrame:
    """(id, segment_index, start_offset, end_offset, segment_text): a text in slices of ``size`` characters, none empty."""
    n = F.ceil(F.length(text_col) / size).cast("int")
    rows = docs.filter(F.length(text_col) > 0).select(id_col, text_col, F.explode(F.sequence(F.lit(0), n - 1)).alias("segment_index"))
    start = F.col("segment_index") * size
    return rows.select(id_col, "segment_index", start.alias("start_offset"), F.least(start + size, F.length(text_col)).alias("end_offset"), F.substr(F.col(text_col), start + 1, F.lit(size)).alias("segment_text"))


def reassembled(parts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("segment_index", "segment_text")))
    return parts.groupBy(id_col).agg(F.array_join(F.transform(ordered, lambda s: s["segment_text"]), "").alias("text"))


def pending(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that are still to be worked on."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def after(rows: DataFrame, key: str, last, most: int) -> DataFrame:
    """The next rows in key order behind ``last`` (None: from the first on): what a scan that was broken off goes on with."""
    return (rows if last is None else rows.filter(F.col(key) > last)).orderBy(key).limit(most)


def key_ranges(rows: DataFrame, key: str, size: int) -> DataFrame:
    """(part, low, high, n): ranges of a whole-number key that hold its values in steps of ``size``, for scans that run side by side."""
    part = F.floor(F.col(key) / size)
    return rows.groupBy(part.alias("part")).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("n"))


def latest_values(entries: DataFrame, key: str = "key", value: str = "value", version: str = "version") -> DataFrame:
    """A key-value table as its last writes."""
    return entries.groupBy(key).agg(F.max_by(value, version).alias(value))


def guard(stored: dict[str, str], wanted: dict[str, str]) -> None:
    """Refuse to go on with a table that was made under other settings."""
    wrong = {k: (stored.get(k), v) for k, v in wanted.items() if k in stored and stored[k] != v}
    if wrong:
        raise ValueError(f"the table was made with other settings: {wrong}")


def migrated(rows: DataFrame, renames: dict[str, str], added: dict[str, str]) -> DataFrame:
    """Rows of an older version under the present columns."""
    rows = rows.withColumnsRenamed(renames)
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in added.items() if c not in rows.columns})


def is_pdf(content: Column, least: int = 1000) -> Column:
    return (F.octet_length(content) >= least) & (F.substring(content, 1, 4) == F.lit(b"%PDF"))
