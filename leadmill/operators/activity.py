"""The activity log: pages by key, retention, latest state per entity, liveness, error classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadmill.functions.compat import yes

# Order of levels, days kept, rows kept, and error patterns in their order.
LEVELS = ("DEBUG", "INFO", "WARN", "ERROR")
KEPT_DAYS = {"INFO": 3, "WARN": 7, "ERROR": 7}
KEPT_ROWS = 50_000
STALE_SECONDS = 90
RETRYABLE = r"(?i)(timeout|ECONNRESET|ECONNREFUSED|socket hang up|net::ERR_NETWORK|temporar)"
SECRET = r"(?i)(password|secret|token|authorization|cookie|api[_-]?key)"


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), level)


def page(events: DataFrame, before: Column | None = None, level: str | None = None, module: str | None = None, limit: int = 200) -> DataFrame:
    """The newest rows before a moment, given oldest first; the limit is held inside 1..500."""
    out = events
    if before is not None:
        out = out.where(F.col("ts") < before)
    if level:
        out = out.where(level_rank(F.col("level")) >= LEVELS.index(level) + 1)
    if module:
        out = out.where(F.col("module") == module)
    newest = out.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(min(500, max(1, limit)))
    return newest.orderBy("ts", "event_id")


def replay(events: DataFrame, last_id: int | None = None, most: int = 50) -> DataFrame:
    """What a reader that comes back gets, oldest first: all rows after the last one it saw, else the ``most`` newest."""
    if last_id is not None:
        return events.where(F.col("event_id") > last_id).orderBy("event_id")
    return events.orderBy(F.col("event_id").desc()).limit(most).orderBy("event_id")


def retained(events: DataFrame, as_of: Column, most: int = KEPT_ROWS) -> DataFrame:
    """What retention leaves: no row past its level's age, and of the rest the ``most`` newest.

    The newest are found by a threshold, not by numbering all rows in one task: rows are counted
    by moment, and only the moment at the cut is looked at row by row.
    """
    aged = F.lit(False)
    for level, days in KEPT_DAYS.items():
        aged = aged | ((F.col("level") == level) & (F.col("ts") < as_of - F.make_dt_interval(days=F.lit(days))))
    young = events.where(~yes(aged))
    cut = young.select("ts", "event_id").orderBy(F.col("ts").desc(), F.col("event_id").desc()).offset(most).limit(1).select(F.col("ts").alias("cut_ts"), F.col("event_id").alias("cut_id"))
    joined = young.join(F.broadcast(cut), F.lit(True), "left")  # one row at most
    return joined.where("cut_ts is null or ts > cut_ts or (ts = cut_ts and event_id > cut_id)").select(*events.columns)


def latest_per_entity(events: DataFrame, key: str = "user_id", revision: str = "ts") -> DataFrame:
    """Each entity's row of the highest revision, by id where revisions are equal; arrival order does not count."""
    others = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(revision, "event_id")).alias("row")).select(key, "row.*")


def alive(runs: DataFrame, as_of: Column) -> DataFrame:
    """Adds ``alive``: a heartbeat in the last 90 s, or none yet and created in the last 90 s."""
    since = as_of - F.make_dt_interval(secs=F.lit(STALE_SECONDS))
    return runs.withColumn("alive", yes(F.coalesce("heartbeat_at", "created_at") >= since))


def error_class(message: Column) -> Column:
    return F.when(F.rlike(message, F.lit(RETRYABLE)), "RETRYABLE").otherwise("HARD")


def redacted(details: Column) -> Column:
    """A string map with secrets blanked: by key, and wherever a value names one."""
    return F.transform_values(details, lambda k, v: F.when(F.rlike(k, F.lit(SECRET)) | F.rlike(v, F.lit(SECRET)), "[REDACTED]").otherwise(v))


def recent_counts(events: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """provider, runs in the last ``days``."""
    return events.where((F.col("ts") >= as_of - F.make_dt_interval(days=F.lit(days))) & (F.col("ts") <= as_of)).groupBy("provider").agg(F.count(F.lit(1)).alias("runs"))


def numbered_runs(runs: DataFrame, key: str) -> DataFrame:
    """Adds run_number: 1 for a key's oldest run."""
    return runs.withColumn("run_number", F.row_number().over(Window.partitionBy(key).orderBy("created_at", "id")))
