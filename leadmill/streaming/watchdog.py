"""Heartbeats watched as a stream: each run has one mark and one timer, both in the state store.

A beat moves its run's timer; a timer that goes off says that the run is stale, with no beat needed to
find out. A beat that is older than one already seen, in whatever order they come, moves nothing. A run
that ended, or was not heard of for KEPT, leaves the store.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from leadmill.operators.activity import STALE_SECONDS

KEPT = datetime.timedelta(days=1)
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "run long, state string, beat long"  # beats in microseconds inside


class _Watch(StatefulProcessor):
    def __init__(self, seconds: float, kept: datetime.timedelta):
        self.wait, self.kept = int(seconds * 1000), int(kept.total_seconds() * 1000)

    def init(self, handle) -> None:
        self.handle = handle
        self.mark = handle.getValueState("mark", "beat long, stale boolean", self.kept)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.mark.get() if self.mark.exists() else None
        newest, ended = None, False
        for row in rows:
            ended = ended or row.ended
            newest = row.beat if newest is None or row.beat > newest else newest
        if ended:
            self._stop()
            self.mark.clear()
            yield Row(run=key[0], state="ENDED", beat=newest)
        elif held is None or newest > held[0]:
            self._stop()
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)
            self.mark.update((newest, False))
            if held is None or held[1]:
                yield Row(run=key[0], state="ALIVE", beat=newest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.mark.exists():
            beat = self.mark.get()[0]
            self.mark.update((beat, True))
            yield Row(run=key[0], state="STALE", beat=beat)

    def _stop(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def close(self) -> None:
        pass


def watch(beats: DataFrame, seconds: float = STALE_SECONDS, kept: datetime.timedelta = KEPT) -> DataFrame:
    """A stream of changes (run, state, beat): ALIVE at a run's first beat and when it comes back, STALE once none came
    for ``seconds``, ENDED. ``beats``: run, beat, ended (null: false). Beats without run or time are passed over.

    Timers and marks need the RocksDB state store, which is set for the session here."""
    beats.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = beats.select(F.col("run").cast("long").alias("run"), F.unix_micros("beat").alias("beat"), F.coalesce("ended", F.lit(False)).alias("ended")).where("run is not null and beat is not null")
    changes = rows.groupBy("run").transformWithState(_Watch(seconds, kept), CHANGES, "Update", "processingTime")
    return changes.withColumn("beat", F.timestamp_micros("beat"))
