"""What a result was made from, and tables that are reused only if they were made from the same."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.sources.store import exists


def revision(folder: str) -> dict[str, str | bool | None]:
    """The git revision of a folder and whether it has changes; nulls where there is none."""
    def git(*args: str) -> str | None:
        out = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True)
        return out.stdout.strip() if out.returncode == 0 else None

    status = git("status", "--porcelain")
    return {"revision": git("rev-parse", "HEAD"), "dirty": None if status is None else bool(status)}


def fingerprint(rows: DataFrame) -> str:
    """A digest of a table's rows that does not depend on their order: the sums of two row hashes and the count."""
    columns = [F.col(c) for c in sorted(rows.columns)]
    sums = [F.sum(F.xxhash64(*columns, F.lit(seed)).cast("decimal(38,0)")) for seed in (1, 2)]
    return "-".join(str(x) for x in rows.agg(F.count(F.lit(1)), *sums).first())


def cached(spark: SparkSession, path: str, meta: dict[str, str], make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path`` if its recorded settings are ``meta``, else a new one from ``make``. The settings are written last,
    so a table whose writing broke off is never reused."""
    record = f"{path}/_settings"
    data = f"{path}/data"
    text = json.dumps(meta, sort_keys=True)
    if exists(spark, record) and [r["value"] for r in spark.read.text(record).collect()] == [text]:
        return spark.read.parquet(data)
    make().write.mode("overwrite").parquet(data)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(record)
    return spark.read.parquet(data)
