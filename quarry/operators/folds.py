"""Folds over the events of a key in order. Events are dealt out by key and sorted inside the tasks, which then run through
them with the state of one key at a time, so that a key's events are never one row or one array."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.scratch import written

#: Rows of a range of events, about.
RANGE_ROWS = 100_000


def _judged(keys: Sequence, times: Sequence[int], first_state: list[int], most: int, seconds: int) -> tuple[list[bool], list[int]]:
    """Which of the events of a range, in order, are accepted, and the last accepted times of its last key. first_state: those
    that the range's first key brings with it."""
    accepted, last, state = [], None, list(first_state)
    for n, (k, t) in enumerate(zip(keys, times, strict=True)):
        if n and k != last:
            state = []
        last = k
        fits = len(state) < most or state[0] <= t - seconds
        if fits:
            state = [*state, t][-most:]
        accepted.append(fits)
    return accepted, state


def rate_limited(events: DataFrame, key: str, most: int = 2, seconds: int = 3600, range_rows: int = RANGE_ROWS) -> DataFrame:
    """key, event_id of the accepted events (key, t in seconds, event_id): those with fewer than `most` accepted ones in
    the `seconds` before.

    Events are cut into ranges of about `range_rows` rows in the order of key and time, whatever the keys' sizes, so a busy
    key is many ranges. Each range is folded to a summary, a row: its first and last key and the last accepted times. A
    summary's times are what the next range of the same key begins with; ranges that were folded with other times are folded
    again, until all fit. Only ranges of one single key pass on what they got, so this ends after at most as many turns as
    the longest run of these; only the ranges in question are read again. The driver sees summaries only. Events without a key
    are left out."""
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(F.col(key).alias("key"), "t", "event_id")
    ranges = max(math.ceil(rows.count() / range_rows), 1)
    cut = written(rows.repartitionByRange(ranges, "key", "t", "event_id").withColumn("range", F.spark_partition_id()), "ranges")

    def summarised(some: DataFrame, states: dict[int, list[int]]) -> dict[int, tuple]:
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            r = rows.sort_values(["key", "t", "event_id"])
            k, n = r["key"].tolist(), int(r["range"].iloc[0])
            _, state = _judged(k, r["t"].tolist(), states.get(n, []), most, seconds)
            return pd.DataFrame({"range": [n], "first": [k[0]], "last": [k[-1]], "times": [state]})

        found = some.groupBy("range").applyInPandas(run, f"range int, first {kind}, last {kind}, times array<bigint>").collect()
        return {r["range"]: (r["first"], r["last"], list(r["times"])) for r in found}

    cut = cut.where(F.col("key").isNotNull())
    states: dict[int, list[int]] = {}
    summary = summarised(cut, states)
    order = sorted(summary)
    while True:
        needed = {b: summary[a][2] for a, b in zip(order, order[1:], strict=False) if summary[a][1] == summary[b][0]}
        again = [n for n, times in needed.items() if times != states.get(n, [])]
        if not again:
            break
        states = needed
        summary |= summarised(cut.where(F.col("range").isin(again)), states)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        r = rows.sort_values(["key", "t", "event_id"])
        accepted, _ = _judged(r["key"].tolist(), r["t"].tolist(), states.get(int(r["range"].iloc[0]), []), most, seconds)
        return r.loc[accepted, ["key", "event_id"]].rename(columns={"key": key})

    return cut.groupBy("range").applyInPandas(run, f"{key} {kind}, event_id bigint")


def first_of_day(events: DataFrame, key: str, day: Column, most: int) -> DataFrame:
    """event_id of the first `most` events (ts, event_id) of each key and day; tasks send no more than these of what they have of
    a key, so a busy key is no large group."""
    w = Window.partitionBy(key, "day_").orderBy("ts", "event_id")
    return events.withColumn("day_", day).withColumn("nth_", F.row_number().over(w)).where(F.col("nth_") <= most).select("event_id")


def over_daily_limit(events: DataFrame, keys: Sequence[str], day: Column, most: int = 2) -> DataFrame:
    """event_id, over_limit: whether an event comes after the first `most` of its day by one of the keys. Event ids are unique."""
    out = events
    for k in keys:
        out = out.join(first_of_day(events, k, day, most).withColumn(f"in_{k}", F.lit(True)), "event_id", "left")
    within = F.lit(True)
    for k in keys:
        within = within & F.coalesce(F.col(f"in_{k}"), F.lit(False))
    return out.select("event_id", (~within).alias("over_limit"))


def transitions(updates: DataFrame, moves: Mapping[str, Sequence[str]], start: str = "queued") -> DataFrame:
    """job_id, state, accepted, refused from updates (job_id, ts, event_id, status)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job, now, done = None, None, []
        for b in batches:
            for j, status in zip(b["job_id"], b["status"], strict=True):
                if now is None or j != job:
                    if now is not None:
                        done.append((job, *now))
                    job, now = j, [start, 0, 0]
                if status in moves.get(now[0], ()):
                    now[0], now[1] = status, now[1] + 1
                else:
                    now[2] += 1
            yield pd.DataFrame(done, columns=["job_id", "state", "accepted", "refused"])
            done = []
        if now is not None:
            yield pd.DataFrame([(job, *now)], columns=["job_id", "state", "accepted", "refused"])

    kind = updates.schema["job_id"].dataType.simpleString()
    ordered = updates.select("job_id", "ts", "event_id", "status").repartition("job_id").sortWithinPartitions("job_id", "ts", "event_id")
    return ordered.mapInPandas(run, f"job_id {kind}, state string, accepted int, refused int")
