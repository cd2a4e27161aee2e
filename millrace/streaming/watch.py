"""Watching polled jobs: those that make no progress, can't be reached, or end."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..sources.shared import shared_folder

OUT = "outcome string, last_active timestamp, noticed timestamp"
#: Columns of a poll beside key and time: what it saw (null: the poll failed), and whether the job had ended.
POLL = ("progress", "done")


class Watch(StatefulProcessor):
    """One job's polls in order of time, whatever order they come in.

    Polls later than the watermark are kept until it has passed them, so that none can come between; a timer then
    replays them. All of a job's state is one value, the polls as arrays in it, as each reading and writing of state is a
    trip out of the worker: the last progress, when it was made, how many polls failed since, and the timer that is set.
    """

    def __init__(self, timeout_ms: int, failures: int):
        self.timeout, self.failures = timeout_ms, failures

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "watched boolean, progress string, active long, failed int, wake long, at array<long>, seen array<string>, done array<boolean>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = []
        for df in rows:
            at = df["time"].astype("datetime64[ms]").astype("int64")
            new += [(int(t), None if p is None else str(p), bool(d)) for t, p, d in zip(at, df["progress"].astype(object).where(df["progress"].notna(), None), df["done"].fillna(False))]
        yield from self.replay(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self.replay(key, [], timerValues.getCurrentWatermarkInMs())

    def replay(self, key: Any, new: list[tuple], now: int) -> Iterator[pd.DataFrame]:
        kept = self.job.get()
        watched, progress, active, failed, before, *waiting = kept or (False, None, 0, 0, None, [], [], [])
        polls = sorted([*zip(*waiting), *new], key=lambda p: (p[0], p[1] is not None, p[1] or "", p[2]))
        out = []
        for at, seen, done in (p for p in polls if p[0] <= now):
            if watched and at >= active + self.timeout:
                out.append(("stalled", active, active + self.timeout))
                watched = False
            if seen is None:
                failed += 1
                if watched and failed >= self.failures:
                    out.append(("unreachable", active, at))
                    watched = False
                continue
            failed = 0
            if done:
                out.append(("finished", active if watched else at, at))
                watched, progress = False, None
            elif not watched or seen != progress:
                watched, progress, active = True, seen, at
        if watched and active + self.timeout <= now:
            out.append(("stalled", active, active + self.timeout))
            watched = False
        later = [p for p in polls if p[0] > now]
        waking = [p[0] for p in later[:1]] + ([active + self.timeout] if watched else [])
        wake = max(min(waking), now + 1) if waking else None
        if watched or failed or later:
            self.job.update((watched, progress, active, failed, wake, *(map(list, zip(*later)) if later else ([], [], []))))
        elif kept:
            self.job.clear()
        if before is not None and before != wake:
            self.handle.deleteTimer(before)
        if wake is not None and before != wake:
            self.handle.registerTimer(wake)
        if not out:
            return
        stamp = lambda i: pd.to_datetime([r[i] for r in out], unit="ms")
        plain = lambda values: pd.Series(values, dtype=object)
        yield pd.DataFrame({"key": plain([key[0]] * len(out)), "outcome": plain([r[0] for r in out]), "last_active": stamp(1), "noticed": stamp(2)})

    def close(self) -> None:
        pass


def watched(polls: DataFrame, timeout_ms: int, delay: str, failures: int = 5) -> DataFrame:
    """(key, outcome, last_active, noticed) as they are found in a stream of polls (key, time, progress, done).

    stalled: no progress was seen for timeout_ms after last_active; unreachable: so many polls in a row failed
    (progress null) before that; finished: a poll said so. A job is watched again with its next poll that is no failure.
    Polls may come late by `delay`; later ones, and those without a time, are dropped. Times count by milliseconds.
    """
    kind = polls.schema["key"].dataType.simpleString()
    rows = polls.select("key", F.col("time").cast("timestamp").alias("time"), F.col("progress").cast("string").alias("progress"), "done").withWatermark("time", delay)
    return rows.groupBy("key").transformWithStateInPandas(Watch(timeout_ms, failures), StructType.fromDDL(f"key {kind}, {OUT}"), "append", "eventTime")


def watched_so_far(spark: SparkSession, polls: DataFrame, timeout_ms: int, delay: str, failures: int = 5) -> DataFrame:
    """What watched finds in all that a stream holds now, as a table in the shared folder."""
    folder = shared_folder(spark, "watch")
    provider, stores = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(provider)
    spark.conf.set(provider, stores)
    try:
        found = watched(polls, timeout_ms, delay, failures)
        found.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(found.schema).parquet(f"{folder}/rows")
