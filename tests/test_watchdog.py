"""Heartbeats as a stream: timers, a late beat, a run that ended, and a restart from the checkpoint."""

import datetime
import time

from leadmill.streaming import watchdog

START = datetime.datetime(2024, 1, 1)


def at(second):
    return START + datetime.timedelta(seconds=second)


def test_stale_runs_are_found_and_come_back_after_a_restart(spark, tmp_path):
    def beat(*rows):
        spark.createDataFrame([(run, at(s) if s is not None else None, ended) for run, s, ended in rows], "run long, beat timestamp, ended boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    batches: dict[int, list[tuple]] = {}  # a batch that was cut off by a stop is given again under its number

    def seen():
        return [row for nth in sorted(batches) for row in batches[nth]]

    def start():
        beats = spark.readStream.schema("run long, beat timestamp, ended boolean").parquet(f"{tmp_path}/in")
        sink = lambda frame, nth: batches.update({nth: [(r["run"], r["state"], (r["beat"] - START).seconds) for r in frame.collect()]})
        return watchdog.watch(beats, seconds=3).writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="300 milliseconds").start()

    def until(test):
        for _ in range(600):
            if test():
                return
            assert running.exception() is None
            time.sleep(0.1)
        raise AssertionError(seen())

    beat((1, 10, None), (1, 5, None), (2, 7, False), (3, 1, True), (None, 1, False), (4, None, False))
    running = start()
    try:
        until(lambda: {(1, "STALE", 10), (2, "STALE", 7)} <= set(seen()))
        assert sorted(seen()) == [(1, "ALIVE", 10), (1, "STALE", 10), (2, "ALIVE", 7), (2, "STALE", 7), (3, "ENDED", 1)]
    finally:
        running.stop()
    beat((1, 20, None), (2, 6, None))  # run 2's comes late and is older than one that was seen
    running = start()
    try:
        until(lambda: (1, "STALE", 20) in seen())
        assert seen()[5:] == [(1, "ALIVE", 20), (1, "STALE", 20)]
        beat((1, 30, True), (2, 40, None))
        until(lambda: {(1, "ENDED", 30), (2, "STALE", 40)} <= set(seen()))
        assert (2, "ALIVE", 40) in seen() and len(seen()) == 10
    finally:
        running.stop()
