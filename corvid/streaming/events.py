"""Streams over event tables: windows with a watermark, a run log with state, and index files that grow."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
#: Which event may follow which; the empty state is a run that was not seen yet.
FOLLOWS = {"": {"queued"}, "queued": {"started", "failed"}, "started": {"succeeded", "failed"}, "succeeded": set(), "failed": set()}


def stream(spark: SparkSession, folder: str, schema: str = EVENTS, files: int = 20) -> DataFrame:
    """Parquet files of a folder as they come, a bounded number of them in each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def tumbling(events: DataFrame, size: str, late: str = "1 hour") -> DataFrame:
    return _flat(events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type"))


def sliding(events: DataFrame, size: str, step: str, late: str = "1 hour") -> DataFrame:
    return _flat(events.withWatermark("ts", late).groupBy(F.window("ts", size, step), "event_type"))


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("window"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select("user_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n", "total")


def _flat(grouped) -> DataFrame:
    rows = grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


class RunLog(StatefulProcessor):
    """Accepts a run's events only where they may follow; numbers what is accepted; a closed run takes nothing more."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "last string, sequence int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, sequence = self.state.get() if self.state.exists() else ("", 0)
        events = pd.concat(list(rows)).sort_values(["at", "event_id"])
        out = []
        for e in events.itertuples():
            good = e.kind in FOLLOWS.get(last, set())
            if good:
                last, sequence = e.kind, sequence + 1
            out.append((key[0], e.event_id, e.kind, good, sequence if good else None))
        self.state.update((last, sequence))
        frame = pd.DataFrame(out, columns=["run_id", "event_id", "kind", "accepted", "sequence"])
        frame["sequence"] = frame["sequence"].astype("Int64")
        yield frame

    def close(self) -> None:
        pass


def run_log(events: DataFrame) -> DataFrame:
    """(run_id, event_id, kind, accepted, sequence) of a stream of (run_id, event_id, kind, at). Needs the RocksDB state store."""
    return events.groupBy("run_id").transformWithStateInPandas(RunLog(), "run_id string, event_id bigint, kind string, accepted boolean, sequence bigint", "Append", "None")


def drain(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all that is there, write it to Parquet and stop: what a scheduled top-up of an index does."""
    query = rows.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


#: Events after which a run has no more.
TERMINAL = ("succeeded", "failed")


def server_sent(frames, kind: str = "kind", sequence: str = "sequence"):
    """Lines of a server-sent event stream from batches of a run's events: one message each with its number, a heartbeat where a
    batch has none, and the end after a terminal event."""
    import json

    for frame in frames:
        if not frame:
            yield ": heartbeat\n\n"
        for event in sorted(frame, key=lambda e: e[sequence]):
            yield f"id: {event[sequence]}\nevent: {event[kind]}\ndata: {json.dumps(event, default=str)}\n\n"
            if event[kind] in TERMINAL:
                return


def first_requests(requests: DataFrame, late: str = "1 day") -> DataFrame:
    """The first request of each user and client id, within the time that late ones may take."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "client_id"])


def tail(rows: DataFrame, deliver, key: str, sequence: str, cursors: dict, checkpoint: str):
    """Deliver each run's events after its cursor, in order, batch by batch: ``deliver(run, events)``. Events at or before the
    cursor are not given out again; the cursor moves with what is. ``cursors`` belongs to one client, so its runs are few."""

    def batch(df: DataFrame, _: int) -> None:
        wanted = df.filter(F.col(key).isin(list(cursors))).orderBy(key, sequence)
        held: dict = {}
        for row in wanted.toLocalIterator():
            if row[sequence] > cursors[row[key]]:
                cursors[row[key]] = row[sequence]
                held.setdefault(row[key], []).append(row.asDict())
        for run, events in held.items():
            deliver(run, events)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
