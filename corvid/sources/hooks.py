"""Outside programs over files: converters, page readers, downloads. Each file stands alone: what fails is a status, not the job.

The program itself is a function that is given; these say how it is run over a table, how often it is tried, and what is kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tries of one file, and the wait before the second (it grows with each).
TRIES, WAIT_S = 3, 0.5
#: Endings of documents and of vector pictures that are converted; least size of a download.
DOCUMENTS, METAFILES, LEAST_DOWNLOAD = (".doc", ".docx"), (".wmf", ".emf"), 1000
STATUS = "path string, status string, error string, tries int, size_bytes bigint, output {}"


def with_ending(path: Column, endings: tuple[str, ...]) -> Column:
    return F.lower(path).rlike(r"\.(?:" + "|".join(e.lstrip(".") for e in endings) + ")$")


def _run(files: DataFrame, program: Callable, kind: str, least: int, tries: int, wait: float) -> DataFrame:
    """One row of STATUS for each (path, content): ok, too_small or failed."""

    def one(path, content) -> tuple:
        error = None
        for attempt in range(1, tries + 1):
            if attempt > 1:
                time.sleep(wait * (attempt - 1))
            try:
                out = program(path, None if content is None else bytes(content))
                size = len(out if isinstance(out, bytes) else out.encode())
                return (path, "ok", None, attempt, size, out) if size >= least else (path, "too_small", f"{size} bytes", attempt, size, None)
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
        return path, "failed", error, tries, 0, None

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([one(p, c) for p, c in zip(batch["path"], batch["content"], strict=True)], columns=["path", "status", "error", "tries", "size_bytes", "output"])

    return files.select("path", "content").mapInPandas(run, STATUS.format(kind))


def converted(files: DataFrame, convert: Callable[[str, bytes], str], done: DataFrame | None = None, endings: tuple[str, ...] = DOCUMENTS, tries: int = TRIES, wait: float = WAIT_S) -> DataFrame:
    """Files (path, content) of the given endings as text. Those that ``done`` (path) has are skipped, not read."""
    wanted = files.filter(with_ending(F.col("path"), endings))
    todo = wanted.join(done.select("path").distinct(), "path", "left_anti") if done is not None else wanted
    out = _run(todo, convert, "string", 1, tries, wait)
    if done is None:
        return out
    skipped = wanted.select("path").join(done.select("path").distinct(), "path", "left_semi")
    return out.unionByName(skipped.select("path", F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("tries"), F.lit(0).cast("bigint").alias("size_bytes"), F.lit(None).cast("string").alias("output")))


def rastered(files: DataFrame, draw: Callable[[str, bytes], bytes], tries: int = TRIES, wait: float = WAIT_S) -> DataFrame:
    """Vector pictures as raster ones."""
    return _run(files.filter(with_ending(F.col("path"), METAFILES)), draw, "binary", 1, tries, wait)


def downloaded(urls: DataFrame, fetch: Callable[[str, None], bytes], least: int = LEAST_DOWNLOAD, tries: int = TRIES, wait: float = WAIT_S) -> DataFrame:
    """What is at addresses (path); less than ``least`` bytes is not kept."""
    return _run(urls.select("path", F.lit(None).cast("binary").alias("content")), fetch, "binary", least, tries, wait)


def read_pages(pages: DataFrame, read: Callable[[str, bytes], str], tries: int = TRIES, wait: float = WAIT_S) -> DataFrame:
    """(doc_id, text, failed): the texts of a document's page images (doc_id, page, content) in order, joined by blank lines; pages
    that can't be read are counted and left out."""
    keyed = pages.withColumn("path", F.concat_ws("#", F.col("doc_id").cast("string"), F.col("page").cast("string")))
    read_ = _run(keyed, read, "string", 0, tries, wait).join(keyed.select("path", "doc_id", "page"), "path")
    ordered = F.array_sort(F.collect_list(F.when(F.col("status") == "ok", F.struct("page", "output"))))
    return read_.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda p: p["output"]), "\n\n").alias("text"), F.count_if(F.col("status") != "ok").alias("failed"))
