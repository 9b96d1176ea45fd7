"""The event log as streams: append, latest state per entity, and the delta since a cursor."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

STATE = "revision timestamp, event_id long"
LATEST = "user_id long, event_id long, revision timestamp, event_type string"


def read_events(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def append(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Every event once into a Parquet log; runs until what is there now has been read."""
    return events.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Emits an entity's row when one with a higher revision comes; late, lower ones are ignored."""
    held = state.get if state.exists else None
    best = None
    for frame in frames:
        row = frame.sort_values(["ts", "event_id"]).iloc[-1]
        mark = (row["ts"].to_pydatetime(), int(row["event_id"]))
        if held is None or mark > (held[0], held[1]):
            held, best = mark, row
    if best is not None:
        state.update(held)
        yield pd.DataFrame([{"user_id": key[0], "event_id": best["event_id"], "revision": best["ts"], "event_type": best["event_type"]}])


def latest_state(events: DataFrame) -> DataFrame:
    """A stream of changes of each user's latest event; state is one mark per user."""
    return events.select("user_id", "event_id", "ts", "event_type").groupBy("user_id").applyInPandasWithState(_advance, LATEST, STATE, "update", GroupStateTimeout.NoTimeout)


def into(changes: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    return changes.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def delta(events: DataFrame, since) -> DataFrame:
    """Rows changed after a cursor, oldest first, 200 at most."""
    return events.where(F.col("ts") > F.lit(since)).orderBy("ts", "event_id").limit(200)
