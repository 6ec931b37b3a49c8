"""Structured Streaming forms of the event, status and file-drop operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.StringType()), T.StructField("event", T.StringType())])


def log_tail(spark: SparkSession, path: str, schema: T.StructType = EVENT) -> DataFrame:
    """Access events from JSON lines as files arrive."""
    return spark.readStream.schema(schema).json(path)


def usage_windows(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per window and event; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event").agg(F.count(F.lit(1)).alias("n"))


def once(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Each event once, although it may be notified twice."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def rate_limited(events: DataFrame, most: int = 2, seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """Accepted events (user_id, event_id): fewer than `most` accepted ones in the seconds before. Only accepted events count,
    so each key keeps the times of its last `most` of them, until it has rested for `seconds` past the watermark. Events of
    a batch are judged in their order; one that comes in a later batch than its successors is judged after them."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        accepted = []
        for t, event in zip(rows["ts"], rows["event_id"], strict=True):
            now = int(t.timestamp())
            if len(times) < most or times[0] <= now - seconds:
                times = [*times, now][-most:]
                accepted.append((key[0], event))
        state.update((times,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), max(times, default=0) * 1000) + seconds * 1000 + 1)
        yield pd.DataFrame(accepted, columns=["user_id", "event_id"])

    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(fold, "user_id string, event_id bigint", "times array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def keeps_state(spark: SparkSession) -> None:
    """Processors with timers and time to live keep their state in the store that can end it. Their classes are made in functions, so
    that Spark sends them whole to the process that sets them up."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def latest_status(updates: DataFrame, ttl_seconds: int = 86_400, late: str = "10 minutes") -> DataFrame:
    """job_id, status: each change of the newest status of a job (job_id, ts, event_id, status); a failure outweighs later ones.
    A job that has had no update for ttl_seconds past the watermark is forgotten by a timer, so the state grows with the jobs of
    that time, not with all."""
    keeps_state(updates.sparkSession)

    class LatestStatus(StatefulProcessor):
        """The newest status of a job and when its last update was."""

        def __init__(self, ttl_ms: int):
            self.ttl_ms = ttl_ms

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.newest = handle.getValueState("newest", "failed boolean, ts bigint, event_id bigint, status string, last bigint")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            before = tuple(self.newest.get()) if self.newest.exists() else None
            best, last = (before[:4], before[4]) if before else (None, None)
            for b in rows:
                for ts, event, status in zip(b["ts"], b["event_id"], b["status"], strict=True):
                    at = int(ts.timestamp() * 1000)
                    own = (status == "failed", at, int(event), status)
                    best = own if best is None or own[:3] > best[:3] else best
                    last = at if last is None else max(last, at)
            if before is None or last != before[4]:
                if before is not None:
                    self.handle.deleteTimer(before[4] + self.ttl_ms)
                self.handle.registerTimer(last + self.ttl_ms)
            self.newest.update((*best, last))
            if before is None or best != before[:4]:
                yield pd.DataFrame({"job_id": [key[0]], "status": [best[3]]})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.newest.clear()
            yield from ()

        def close(self) -> None:
            pass

    kind = updates.schema["job_id"].dataType.simpleString()
    rows = updates.withWatermark("ts", late)
    return rows.groupBy("job_id").transformWithStateInPandas(LatestStatus(ttl_seconds * 1000), f"job_id {kind}, status string", "Update", "EventTime")


def expired_sessions(events: DataFrame, rest_minutes: int = 1440, late: str = "10 minutes") -> DataFrame:
    """user_id, last, n: sessions of users (user_id, ts) that have been inactive for rest_minutes past the watermark, once each;
    their state goes then. A later event begins a new session."""
    keeps_state(events.sparkSession)

    class Inactive(StatefulProcessor):
        """A user's session: its last event and number of events, until a timer finds it at rest."""

        def __init__(self, rest_ms: int):
            self.rest_ms = rest_ms

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.session = handle.getValueState("session", "last bigint, n bigint")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            last, n = tuple(self.session.get()) if self.session.exists() else (None, 0)
            before, ended = last, []
            for at in sorted(int(t.timestamp() * 1000) for b in rows for t in b["ts"]):
                if last is not None and at - last >= self.rest_ms:  # the session ended before its timer was due
                    ended.append((last, n))
                    last, n = None, 0
                last, n = at if last is None else max(last, at), n + 1
            if last != before:
                if before is not None:
                    self.handle.deleteTimer(before + self.rest_ms)
                self.handle.registerTimer(last + self.rest_ms)
            self.session.update((last, n))
            if ended:
                yield pd.DataFrame({"user_id": [key[0]] * len(ended), "last": pd.to_datetime([t for t, _ in ended], unit="ms"), "n": [k for _, k in ended]})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            last, n = tuple(self.session.get())
            self.session.clear()
            yield pd.DataFrame({"user_id": [key[0]], "last": pd.to_datetime([last], unit="ms"), "n": [n]})

        def close(self) -> None:
            pass

    rows = events.withWatermark("ts", late)
    return rows.groupBy("user_id").transformWithStateInPandas(Inactive(rest_minutes * 60_000), "user_id string, last timestamp, n bigint", "Append", "EventTime")


def csv_drops(spark: SparkSession, path: str, schema: T.StructType, archive: str | None, upsert: Callable[[DataFrame, int], None], checkpoint: str, invalid: str | None = None):
    """Starts a stream over a drop folder: the rows of each batch of new files that fit the schema go to `upsert`, lines that
    don't to the folder `invalid` (one for each batch, so that a batch that runs again replaces its own), done files to
    the archive."""
    source = spark.readStream.schema(schema.add("bad_", T.StringType())).option("header", True).option("columnNameOfCorruptRecord", "bad_")
    if archive:
        source = source.option("cleanSource", "archive").option("sourceArchiveDir", archive)

    def batch(rows: DataFrame, n: int) -> None:
        upsert(rows.where("bad_ is null").drop("bad_"), n)
        if invalid:
            rows.where("bad_ is not null").select("bad_").write.mode("overwrite").text(f"{invalid}/batch={n}")

    return source.csv(path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
