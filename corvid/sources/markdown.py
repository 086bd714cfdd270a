"""Reading trees of Markdown files and their manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "relpath string, size_bytes bigint, year int, section string, publication_date date"


def relative(path: Column, root: str) -> Column:
    return F.regexp_replace(path, r"^.*?" + root.rstrip("/").rsplit("/", 1)[-1] + "/", "")


def path_metadata(relpath: Column) -> list[Column]:
    """Year, section and date from ``year/MM/DDMMYYYY/SECTION/file.md``; null where a part is malformed."""
    parts = F.split(relpath, "/")
    year = F.try_element_at(parts, F.lit(1))
    day = F.try_element_at(parts, F.lit(3))
    section = F.try_element_at(parts, F.lit(4))
    deep = F.size(parts) >= 5
    return [
        F.when(year.rlike(r"^\d{4}$"), year.cast("int")).alias("year"),
        F.when(deep, F.upper(section)).alias("section"),
        F.when(day.rlike(r"^\d{8}$"), F.try_to_date(day, "ddMMyyyy")).alias("publication_date"),
    ]


#: The editions of a day.
EDITIONS = ("MAT", "VES")


def editions(rows: DataFrame, first: str, last: str) -> DataFrame:
    """(day, edition) of all days from one date to another."""
    days = rows.select(F.explode(F.sequence(first, last)).alias("day")).distinct()
    return days.select("day", F.explode(F.array(*map(F.lit, EDITIONS))).alias("edition"))


def scan(spark: SparkSession, root: str, years: list[int] | None = None) -> DataFrame:
    """A manifest row for every ``.md`` file under ``root``, backups left out, in the order of their paths. File contents are not
    read; folders that are links are followed, as the file system lists them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(root).select("path", "length")
    rows = files.filter(~F.col("path").contains(".bak")).select(relative(F.col("path"), root).alias("relpath"), F.col("length").alias("size_bytes"))
    rows = rows.select("relpath", "size_bytes", *path_metadata(F.col("relpath")))
    return (rows.filter(F.col("year").isin(years)) if years else rows).orderBy("relpath")


def texts(spark: SparkSession, root: str) -> DataFrame:
    """(relpath, text, byte_length, sha256) of every file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(root)
    return files.select(relative(F.col("path"), root).alias("relpath"), F.decode("content", "UTF-8").alias("text"), F.col("length").alias("byte_length"), F.sha2("content", 256).alias("sha256"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path)


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def strict_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def lenient_jsonl(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Malformed lines and records with an error are left out; of the others the last one of each key stays."""
    rows = spark.read.schema(f"{schema}, error string, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    # Lines are in the order of their files' names, then of their places in the file.
    rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    columns = [c for c in rows.columns if c not in ("error", "_bad", "_file", "_block", "_line")]
    good = rows.filter("_bad IS NULL AND error IS NULL")
    return good.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct("_file", "_block", "_line")).alias("r")).select("r.*")


def markdown_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of Markdown tables with that many columns, as strings; rules and header rows that repeat the names are left out."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    rows = spark.read.text(path).filter(F.trim("value").startswith("|")).select(cells.alias("c")).filter(F.size("c") == len(columns))
    rows = rows.filter(~F.array_join("c", "").rlike(r"^[-: ]*$"))
    return rows.select(*(F.col("c")[i].alias(n) for i, n in enumerate(columns))).filter(F.lower(columns[0]) != columns[0].lower())
