"""Sharding by sampled splitters, under the law of near equal bytes.

Each record gets a 64-bit key: the high bits hash its text, so equal texts lie side by side, and
the low bits hash its id, so that a group of copies of any size can still be cut. A size-weighted
sample of keys gives quantile boundaries; every range is then counted exactly, ranges that came
out overfull are sampled again and subdivided, and records are cut into shards by their exact
place inside the ranges. Only the sample (about ``24 * 32 * 16`` keys) and the counts of the
ranges come to the driver, however large the input is.

Records larger than a 1/16 of a shard (at most 16 per shard exist) are dealt first, largest to
the emptiest shard; the others fill what room is left.

Defined results: a null text has size 8 and crc32 0; null and repeated ids are records like any
other; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from leadmill.storage import materialise, scratch

_TIE_BITS = 24


def record_keys(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the long ``key`` that orders the records."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    high = F.shiftleft(F.xxhash64(text), _TIE_BITS)
    # Rows equal in text and id are told apart by their place, so that any number of them can be subdivided.
    low = F.xxhash64(F.col("doc_id"), F.monotonically_increasing_id(), F.lit(7)).bitwiseAND((1 << _TIE_BITS) - 1)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        high.bitwiseOR(low).alias("key"),
    )


def _draw(keys: DataFrame, rate: Column, salt: int) -> list[tuple[int, float]]:
    """A sample in which a record of size s stands with chance min(1, s * rate), as (key, weight)."""
    chance = F.least(F.col("size") * rate, F.lit(1.0))
    u = F.shiftrightunsigned(F.xxhash64("key", "doc_id", F.lit(salt)), 11) / F.lit(float(1 << 53))
    rows = keys.where(u < chance).select("key", (F.col("size") / chance).alias("w")).collect()
    return sorted((r["key"], r["w"]) for r in rows)


def _quantiles(sample: list[tuple[int, float]], ranges: int) -> list[int]:
    if not sample:
        return []
    keys, weights = np.array([k for k, _ in sample], dtype=np.int64), np.cumsum([w for _, w in sample])
    cuts = keys[np.searchsorted(weights, weights[-1] * np.arange(1, ranges) / ranges).clip(0, len(keys) - 1)]
    return sorted(set(cuts.tolist()))


def _in_range(keys: DataFrame, bounds: list[int]) -> DataFrame:
    """Adds ``range``: how many boundaries lie at or below the key."""
    table = np.array(bounds, dtype=np.int64)

    @F.pandas_udf(T.IntegerType())
    def place(key):
        import pandas as pd

        return pd.Series(np.searchsorted(table, key.to_numpy(), side="right").astype("int32"))

    return keys.withColumn("range", place("key"))


def _deal_large(sizes: list[int], shards: int, total: int) -> tuple[list[int], list[float]]:
    """Shard of each large record, and the bytes that each shard still has room for."""
    heap = [(0, s) for s in range(shards)]
    where = []
    for size in sizes:
        load, s = heapq.heappop(heap)
        where.append(s)
        heapq.heappush(heap, (load + size, s))
    loads = dict((s, load) for load, s in heap)
    rest, level = total - sum(sizes), total / shards
    for _ in range(60):  # the common level up to which the rest fills the shards
        room = [max(0.0, level - loads[s]) for s in range(shards)]
        level += (rest - sum(room)) / max(1, sum(1 for r in room if r > 0))
    return where, [max(0.0, level - loads[s]) for s in range(shards)]


def shard_by_bytes(docs: DataFrame, shards: int = 24, ranges_per_shard: int = 32, sample_per_range: int = 16, rounds: int = 6) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard)."""
    with scratch(docs.sparkSession) as made:
        table = made.keep(_places(docs, shards, ranges_per_shard, sample_per_range, rounds))
    # Records of one shard are consecutive in ``at``; its large records come before them.
    first = table.groupBy("shard").agg(F.min(F.when(F.col("at") > 0, F.col("at"))).alias("first"), F.count(F.when(F.col("at") < 0, 1)).alias("n_large"))
    slot_large = Window.partitionBy("shard").orderBy(F.col("at").desc())
    light_slots = table.where("at > 0").join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("first") + F.col("n_large")).alias("slot"))
    large_slots = table.where("at < 0").select("doc_id", "size", "text_crc32", "shard", (F.row_number().over(slot_large) - 1).cast("long").alias("slot"))
    return light_slots.unionByName(large_slots)


def _places(docs: DataFrame, shards: int, ranges_per_shard: int, sample_per_range: int, rounds: int) -> DataFrame:
    """Each record's shard and place ``at``; large records have negative places."""
    spark = docs.sparkSession
    keys = materialise(record_keys(docs), "shard_keys")
    total, count = keys.agg(F.sum("size"), F.count(F.lit(1))).first()
    total = total or 0
    large_at = total / shards / 16
    large = [(r["doc_id"], r["size"], r["text_crc32"], r["key"]) for r in keys.where(F.col("size") > large_at).collect()] if count else []
    large.sort(key=lambda r: (-r[1], r[3], r[0] if r[0] is not None else -1))
    where, room = _deal_large([r[1] for r in large], shards, total)
    light = keys.where(F.col("size") <= large_at)
    schema = "doc_id long, size long, text_crc32 long, shard int, at long"
    dealt = spark.createDataFrame([(r[0], r[1], r[2], s, -1 - i) for i, (r, s) in enumerate(zip(large, where, strict=True))], schema)

    n_ranges = shards * ranges_per_shard
    goal = max(1.0, (total - sum(r[1] for r in large)) / n_ranges)
    bounds = _quantiles(_draw(light, F.lit(sample_per_range / goal), 0), n_ranges)
    for again in range(1, rounds + 1):
        counts = {r["range"]: r for r in _in_range(light, bounds).groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("key").alias("low"), F.max("key").alias("high")).collect()}
        full = [r for r, c in counts.items() if c["bytes"] > 4 * goal and c["low"] < c["high"]]
        if not full or again == rounds:
            break
        within = _in_range(light, bounds).where(F.col("range").isin(full))
        added: list[int] = []
        drawn: dict[int, list] = {}
        for key, w in _draw(within, F.lit(sample_per_range / goal), again):
            drawn.setdefault(int(np.searchsorted(bounds, key, side="right")), []).append((key, w))
        for r, sample in drawn.items():
            added += _quantiles(sample, int(counts[r]["bytes"] / goal) + 1)
        if not set(added) - set(bounds):
            break
        bounds = sorted({*bounds, *added})

    before, places = [0, 0], []
    for r in sorted(counts):
        places.append((r, before[0], before[1]))
        before = [before[0] + counts[r]["bytes"], before[1] + counts[r]["rows"]]
    starts = spark.createDataFrame(places, "range int, bytes_before long, rows_before long")  # one row a range
    inside = Window.partitionBy("range").orderBy("key", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = _in_range(light, bounds).withColumns({"upto": F.sum("size").over(inside), "nth": F.count(F.lit(1)).over(inside)})
    placed = placed.join(F.broadcast(starts), "range")
    middle = F.col("bytes_before") + F.col("upto") - F.col("size") / 2
    caps = np.cumsum(room)[:-1].tolist()
    shard = F.size(F.filter(F.array(*map(F.lit, caps)), lambda c: c <= middle)) if caps else F.lit(0)
    placed = placed.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), (F.col("rows_before") + F.col("nth")).alias("at"))
    return materialise(placed.unionByName(dealt), "shard_places")
