"""The run store: an append-only log of events per run, seen as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last event of each key. One partial aggregate, no sort: the row itself is the value of the maximum."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last")).select(key, *(F.col(f"last.{c}").alias(c) for c in rest))


def sequenced(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Events numbered from 1 within their key."""
    return events.withColumn("sequence", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


#: Which event may follow which.
FOLLOWS = {"queued": ["started", "failed"], "started": ["succeeded", "failed"], "succeeded": [], "failed": []}


def illegal(events: DataFrame, key: str, kind: str, order: list[str], follows: dict[str, list[str]], first: list[str]) -> DataFrame:
    """Events that may not stand where they do, with the one before them."""
    allowed = F.create_map(*[x for k, v in follows.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    before = F.lag(kind).over(Window.partitionBy(key).orderBy(*order))
    rows = events.withColumn("before", before)
    good = F.when(F.col("before").isNull(), F.col(kind).isin(first)).otherwise(F.array_contains(F.coalesce(F.try_element_at(allowed, F.col("before")), F.array().cast("array<string>")), F.col(kind)))
    return rows.filter(~good)


def run_view(events: DataFrame, key: str, at: str, kind: str, started: str, finished: list[str]) -> DataFrame:
    """Status, first start, completion and number of events of every run."""
    return events.groupBy(key).agg(
        F.max_by(kind, F.struct(at, "event_id")).alias("status"),
        F.min(F.when(F.col(kind) == started, F.col(at))).alias("started_at"),
        F.max(F.when(F.col(kind).isin(finished), F.col(at))).alias("completed_at"),
        F.count(F.lit(1)).alias("n_events"),
    )


def quota(events: DataFrame, key: str, at: str, hours: int = 24) -> DataFrame:
    """Each event with how many its key had in the last hours, itself included."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-hours * 3_600_000_000, 0)
    return events.withColumn("used", F.count(F.lit(1)).over(w))


def admitted(requests: DataFrame, key: str, client: str, payload: list[str], order: list[str]) -> DataFrame:
    """The first request of each (user, client id), and whether a later one disagrees with it."""
    w = Window.partitionBy(key, client)
    rows = requests.withColumn("n", F.row_number().over(w.orderBy(*order))).withColumn("conflict", F.min(F.struct(*payload)).over(w) != F.max(F.struct(*payload)).over(w))
    return rows.filter("n = 1").drop("n")


def review_queue(runs: DataFrame, reviewed: DataFrame, key: str, reviewer: str) -> DataFrame:
    """Runs that a reviewer has not judged, by fewest reviews and age."""
    counts = reviewed.groupBy(key).agg(F.count(F.lit(1)).alias("reviews"))
    return runs.join(reviewed.filter(F.col("reviewer") == reviewer), key, "left_anti").join(counts, key, "left").withColumn("reviews", F.coalesce("reviews", F.lit(0)))


def visible(status: Column, published: Column, owner: Column, user: str | int | Column, admin: bool = False) -> Column:
    """Whether a user may see a run: an administrator all, others their own and those that are published and have succeeded."""
    return F.lit(True) if admin else F.coalesce((owner == user) | published & (status == "succeeded"), F.lit(False))


#: Requests that a user may make in 24 hours, and runs that may be under way for them at a time.
DAILY, ACTIVE = 20, 1
UNDER_WAY = ("queued", "started")


def refusal(used: Column, active: Column, unreviewed: Column, daily: int = DAILY, most_active: int = ACTIVE) -> Column:
    """Why a request is not taken: a run is still under way, the day's number is used up, or an answer waits to be judged; null for
    one that is."""
    return F.when(active >= most_active, "active").when(used >= daily, "quota").when(unreviewed > 0, "unreviewed")


def standing(events: DataFrame, key: str, user: str, at: str, kind: str, now: Column, hours: int = 24) -> DataFrame:
    """(user, used, active): the runs that a user asked for in the last hours, and those that are under way."""
    runs = events.groupBy(user, key).agg(F.min(at).alias("asked"), F.max_by(kind, F.struct(at, kind)).alias("status"))
    since = now - F.make_dt_interval(F.lit(0), F.lit(hours))
    return runs.groupBy(user).agg(F.count_if((F.col("asked") > since) & (F.col("asked") <= now)).alias("used"), F.count_if(F.col("status").isin(*UNDER_WAY)).alias("active"))


def of_run(events: DataFrame, key: str, run, order: list[str]) -> DataFrame:
    """One run's events in order."""
    return events.filter(F.col(key) == run).orderBy(*order)
