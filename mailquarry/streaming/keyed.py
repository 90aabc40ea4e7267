"""Windows that open with the first event of a key, as keyed state with timers.

One value of two numbers is held for each key in the RocksDB store: the start of its open window and how many events
it has admitted. An event-time timer clears it once the watermark has passed the window's end, so the state has
only keys that were active within the lateness, and a batch touches only the keys it holds.

A key's events of one batch go to one task, which keeps eight bytes for each time and id and decides them with sorted arrays; the
files taken in one batch bound that. Every call of the state is a message to the JVM and every frame costs milliseconds, so that many keys of
a few events each cost more than the events: rows come and go without frames, a key's decisions of a batch are a row of arrays, and its
timer is the end of the window that the state holds. An event later than the lateness is dropped by the watermark, as in any stream. One
from before its key's open window counts in that window.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MICROS = 1_000_000
INPUT = ["id", "key", "allowance", "at", "micros"]
OUTPUT = "key string, id array<long>, start array<long>, admitted array<boolean>"
#: Decisions in an array at most.
MOST_IN_ARRAY = 100_000


def decide(seconds: np.ndarray, window: int, limit: int, start: int | None, used: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(start of the window, whether admitted) of events in order, and the open window after them."""
    times, stops, opened, admitted = seconds.tolist(), [0], [], np.zeros(len(seconds), dtype=bool)
    while (at := stops[-1]) < len(times):
        if start is None or times[at] >= start + window:
            start, used = times[at], 0
        stop = bisect.bisect_left(times, start + window, at)
        n = min(stop - at, max(limit - used, 0))
        admitted[at: at + n] = True
        used += n
        opened.append(start)
        stops.append(stop)
    starts = np.repeat(np.array(opened, dtype=np.int64), np.diff(stops))
    return starts, admitted, start, used


class AnchoredWindows(StatefulProcessor):
    """Admits the first events of each window of a key, up to the limit in column ``allowance``."""

    def __init__(self, window: int):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start long, used long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = next(rows)
        limit, wanted = first[INPUT.index("allowance")], itemgetter(INPUT.index("micros"), INPUT.index("id"))
        events = np.fromiter(map(wanted, itertools.chain([first], rows)), dtype=[("micros", np.int64), ("id", np.int64)])
        events = events[np.lexsort((events["id"], events["micros"]))]
        was, used = self.open.get() or (None, 0)
        starts, admitted, start, used = decide(events["micros"] // MICROS, self.window, limit, was, used)
        self.open.update((start, used))
        if start != was:
            if was is not None:
                self.handle.deleteTimer((was + self.window) * 1000)
            self.handle.registerTimer((start + self.window) * 1000)
        for at in range(0, len(events), MOST_IN_ARRAY):
            part = slice(at, at + MOST_IN_ARRAY)
            yield Row(key=key[0], id=events["id"][part], start=starts[part], admitted=admitted[part])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.open.clear()
        return iter([])


def admitted(events: DataFrame, window: int, lateness: str) -> DataFrame:
    """(id, key, start, admitted) of a stream with id, key, allowance and ts; events without a time come back undecided."""
    timed = events.select("id", "key", "allowance", F.col("ts").cast("timestamp").alias("at")).withColumn("micros", F.unix_micros("at")).select(INPUT)
    decided = timed.where("at IS NOT NULL").withWatermark("at", lateness).groupBy("key").transformWithState(
        statefulProcessor=AnchoredWindows(window), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
    decided = decided.select("key", F.inline(F.arrays_zip("id", "start", "admitted"))).select("id", "key", "start", "admitted")
    none = F.lit(None)
    undecided = timed.where("at IS NULL").select("id", "key", none.cast("long").alias("start"), none.cast("boolean").alias("admitted"))
    return decided.unionByName(undecided)


def drained(stream: DataFrame, base: str) -> DataFrame:
    """Runs the stream over everything that has arrived, with its state under ``base``, and returns all rows written so far."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        query = (
            stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
            .option("checkpointLocation", f"{base}/checkpoint").start(f"{base}/rows"))
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def by_class(column: Column, limits: dict[str, int]) -> Column:
    """The limit of each class, 0 for others."""
    allowance = F.lit(0)
    for name, n in limits.items():
        allowance = F.when(column == name, F.lit(n)).otherwise(allowance)
    return allowance
