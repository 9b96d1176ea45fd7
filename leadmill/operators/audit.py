"""Checks that must find nothing, audits of a site's content, guards of runs and revisions, caches by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.functions.compat import yes
from leadmill.operators.leads import ready_for_review


def broken_invariants(leads: DataFrame, active: DataFrame) -> DataFrame:
    """rule, n, allowed: how many leads fall under each rule. ``active``: lead_id of operations that are queued or run.

    A lead marked BAD must not be worked on. The others are counted only: a stage beyond the start without GOOD, and
    a review before all automatic checks are through."""
    busy = active.select(F.col("lead_id").alias("id")).distinct().withColumn("busy", F.lit(True))
    rows = leads.join(busy, "id", "left")
    rules = {
        "bad-still-working": yes(F.col("manual_review_status") == "BAD") & yes(F.col("busy")),
        "pipeline-without-good": yes(F.col("redesign_stage") != "NOT_SELECTED") & ~yes(F.col("manual_review_status") == "GOOD"),
        "early-reviewed": yes(F.col("manual_review_status") != "UNREVIEWED") & ~yes(ready_for_review()),
    }
    counts = rows.agg(*(F.count_if(test).alias(name) for name, test in rules.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.col(f"`{name}`").alias("n"), F.lit(name != "bad-still-working").alias("allowed")) for name in rules))).alias("r")).select("r.*")


def graph_audit(entities: DataFrame, rejected: DataFrame) -> DataFrame:
    """finding, key, n over a site graph: titles that several entities of a type have, addresses that are both an index
    and a detail page, how many entities each type has, and why collections were rejected.

    ``entities``: kind, title, url, is_index. ``rejected``: reason.
    """
    title = F.lower(F.trim("title"))
    twice = entities.groupBy("kind", title.alias("t")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 and t <> ''").select(F.lit("duplicate-title").alias("finding"), F.concat_ws(":", "kind", "t").alias("key"), "n")
    both = entities.where("url is not null").groupBy("url").agg(F.bool_or("is_index").alias("a"), F.bool_or(~F.col("is_index")).alias("b"), F.count(F.lit(1)).alias("n")).where("a and b").select(F.lit("index-and-detail").alias("finding"), F.col("url").alias("key"), "n")
    kinds = entities.groupBy(F.col("kind").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("type").alias("finding"), "key", "n")
    reasons = rejected.groupBy(F.coalesce("reason", F.lit("UNKNOWN")).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("rejected").alias("finding"), "key", "n")
    return twice.unionByName(both).unionByName(kinds).unionByName(reasons)


def longest(rows: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """Of each key the row with the longest text, the first on ties."""
    others = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(F.length(F.coalesce(text, F.lit(""))), -F.col(order))).alias("r"))
    return best.select(key, "r.*")


def one_marked(rows: DataFrame, key: str, mark: Column, order: str) -> DataFrame:
    """key, n, first: keys whose rows are marked by none or by several, and the first marked one (null if none)."""
    counts = rows.groupBy(key).agg(F.count_if(yes(mark)).alias("n"), F.min(F.when(yes(mark), F.col(order))).alias("first"))
    return counts.where("n <> 1")


def backfill(leads: DataFrame, verdicts: DataFrame, field: str) -> DataFrame:
    """Leads whose ``field`` a new verdict (id, verdict) changes: id, before, after. Nulls equal each other."""
    rows = leads.select("id", F.col(field).alias("before")).join(verdicts.select("id", F.col("verdict").alias("after")), "id")
    return rows.where(~F.col("before").eqNullSafe(F.col("after")))


def snapshot_hash(parts: Column) -> Column:
    """Hash of a dependency list (array of struct(name, version)) whatever its order."""
    return F.sha2(F.array_join(F.array_sort(F.transform(parts, lambda p: F.concat_ws("@", p["name"], p["version"]))), "\n"), 256)


def new_snapshots(snapshots: DataFrame, stored: DataFrame) -> DataFrame:
    """Snapshots (product, hash, taken_at) whose content the store lacks, one of each content: the first taken."""
    first = snapshots.groupBy("product", "hash").agg(F.min("taken_at").alias("taken_at"))
    return first.join(stored.select("product", "hash").distinct(), ["product", "hash"], "left_anti")


def promotions(revisions: DataFrame, missing: DataFrame) -> DataFrame:
    """The revision that is active after a request to promote: the newest candidate with no screenshot missing takes
    over, else the active one stays. site, active_revision, promoted, blocked (candidates that lack something).

    ``revisions``: site, revision, status (ACTIVE, CANDIDATE or other). ``missing``: site, revision.
    """
    lacks = missing.select("site", "revision").distinct().withColumn("lacks", F.lit(True))
    rows = revisions.join(lacks, ["site", "revision"], "left")
    candidate, ready = F.col("status") == "CANDIDATE", (F.col("status") == "CANDIDATE") & F.col("lacks").isNull()
    out = rows.groupBy("site").agg(F.max(F.when(ready, F.col("revision"))).alias("ready"), F.max(F.when(F.col("status") == "ACTIVE", F.col("revision"))).alias("held"), F.count_if(candidate & yes(F.col("lacks"))).alias("blocked"))
    return out.select("site", F.coalesce("ready", "held").alias("active_revision"), F.col("ready").isNotNull().alias("promoted"), "blocked")


def startable(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Requests (id, operation, entity) with ``started``: not while a run of the same operation and entity is queued or
    runs, and of equal requests only the first."""
    active = runs.where("status in ('QUEUED', 'RUNNING')").select("operation", "entity").distinct().withColumn("busy", F.lit(True))
    first = requests.groupBy("operation", "entity").agg(F.min("id").alias("first"))
    rows = requests.join(first, ["operation", "entity"]).join(active, ["operation", "entity"], "left")
    return rows.select("id", "operation", "entity", (F.col("busy").isNull() & (F.col("id") == F.col("first"))).alias("started"))


def cached_decisions(inputs: DataFrame, cache: DataFrame) -> DataFrame:
    """Inputs (id, key) with the decision that the cache (key, decision, made_at) holds for their content: the latest;
    ``hit`` says whether there is one, so that only the rest is asked for."""
    latest = cache.groupBy("key").agg(F.max_by("decision", "made_at").alias("decision"))
    return inputs.join(latest, "key", "left").withColumn("hit", F.col("decision").isNotNull())


def contacts(rows: DataFrame) -> DataFrame:
    """A site's phones (site, ord, value), one of each number, full numbers first: an 8 in front is a 7."""
    digits = F.regexp_replace("value", "[^0-9]", "")
    keyed = rows.withColumns({"digits": digits, "key": F.regexp_replace(digits, "^8", "7")}).where("key <> ''")
    one = keyed.groupBy("site", "key").agg(F.min_by(F.struct("ord", "value", "digits"), "ord").alias("r"))
    every = one.groupBy("site").agg(F.array_sort(F.collect_list(F.struct((-F.length("r.digits")).alias("short"), F.col("r.ord").alias("ord"), F.col("r.value").alias("value")))).alias("all"))
    return every.select("site", F.transform("all", lambda x: x["value"]).alias("phones"))
