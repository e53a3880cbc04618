"""Incremental discovery over an event stream: windows, first sightings and a keyed state machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Hours after which what waits is looked at again; after the last it is dropped.
RECHECK_HOURS = (1, 6, 24, 72)


def tumbling(events: DataFrame, ts: str = "ts", span: str = "1 hour", late: str = "6 hours", *keys: str) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, span), *keys).agg(F.count("*").alias("n"))


def sliding(events: DataFrame, ts: str = "ts", span: str = "6 hours", step: str = "1 hour", late: str = "6 hours") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, span, step)).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "2 hours", late: str = "6 hours") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))


def first_seen(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "72 hours") -> DataFrame:
    """The first event of each key; the state of a key goes when the watermark has passed it."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def recheck(events: DataFrame, key: str = "user_id", ts: str = "ts", ready: str = "ready", late: str = "1 hour") -> DataFrame:
    """(key, state, checks, at): waiting until an event is ready, looked at again after 1, 6, 24 and 72 hours, then dropped.

    Timers run on event time, so a replay gives the same rows.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, checks = state.get if state.exists else (None, 0)
        if state.hasTimedOut:
            checks += 1
            at = first + RECHECK_HOURS[checks - 1] * 3_600_000
            if checks == len(RECHECK_HOURS):
                state.remove()
                yield pd.DataFrame({key: [k[0]], "state": ["dropped"], "checks": [checks], "at": [at]})
                return
            state.update((first, checks))
            state.setTimeoutTimestamp(max(first + RECHECK_HOURS[checks] * 3_600_000, state.getCurrentWatermarkMs() + 1))
            yield pd.DataFrame({key: [k[0]], "state": ["rechecked"], "checks": [checks], "at": [at]})
            return
        rows = pd.concat(list(frames))
        times = rows[ts].astype("datetime64[ms]").astype("int64")
        if rows[ready].any():
            if state.exists:
                state.remove()
            yield pd.DataFrame({key: [k[0]], "state": ["scanned"], "checks": [checks], "at": [int(times[rows[ready]].min())]})
            return
        first = int(times.min()) if first is None else min(first, int(times.min()))
        state.update((first, checks))
        state.setTimeoutTimestamp(max(first + RECHECK_HOURS[checks] * 3_600_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]], "state": ["waiting"], "checks": [checks], "at": [first]})

    kind = events.schema[key].dataType.simpleString()
    return events.withWatermark(ts, late).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, state string, checks int, at long", "first long, checks int", "append", GroupStateTimeout.EventTimeTimeout)


def upsert_batches(stream: DataFrame, keys: list[str], version: str, path: str, checkpoint: str):
    """Keeps a table of the newest row of each key; each batch writes only the buckets that its rows fall in."""
    from tallyward.sources.sinks import upsert_buckets

    def merge(batch: DataFrame, number: int) -> None:
        upsert_buckets(batch.sparkSession, path, batch, keys, version)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tag_sightings(stream: DataFrame, late: str = "72 hours") -> DataFrame:
    """(repo, tag, first_sha, sha, moved) whenever a tag is seen: the commit it was first seen at is kept as state.

    stream: (repo, tag, sha, at).  The state of a tag goes when it was not seen for the watermark's delay.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["at", "sha"])
        first = state.get[0] if state.exists else rows["sha"].iloc[0]
        state.update((first,))
        state.setTimeoutTimestamp(max(int(rows["at"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"repo": k[0], "tag": k[1], "first_sha": first, "sha": rows["sha"], "moved": rows["sha"] != first})

    kinds = ", ".join(f"{c} {stream.schema[c].dataType.simpleString()}" for c in ("repo", "tag"))
    return stream.withWatermark("at", late).groupBy("repo", "tag").applyInPandasWithState(step, f"{kinds}, first_sha string, sha string, moved boolean", "first_sha string", "append", GroupStateTimeout.EventTimeTimeout)


def within_budget(calls: DataFrame, key: str, ts: str, most: int, span: str = "1 hour", *then: str) -> DataFrame:
    """Adds ``allowed``: whether a call is among the first ``most`` of its key and window; the others wait."""
    from pyspark.sql import Window

    w = Window.partitionBy(key, "window_").orderBy(ts, *then)
    return calls.withColumn("window_", F.window(ts, span)["start"]).withColumn("allowed", F.row_number().over(w) <= most).drop("window_")


def resumed(events: DataFrame, ts: str, cursor: str | None, lookback: str = "1 hour") -> DataFrame:
    """Events from a cursor on, and those of a time before it that may have come late; all without a cursor."""
    return events if cursor is None else events.filter(F.col(ts) >= F.lit(cursor).cast("timestamp") - F.expr(f"interval {lookback}"))
