"""Relational upkeep: upsert, versions, stale rows, nested includes, usage counts, evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadmill.storage import broadcast_if_small


def upsert(old: DataFrame, new: DataFrame, keys: list[str], kept: tuple[str, ...] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key, and ``action``: created, updated or kept.

    A null field of ``new`` leaves what was there; ``kept`` columns are never overwritten. Of rows of ``new``
    with one key, the last by all columns counts. Null keys equal each other.
    """
    others = [c for c in old.columns if c not in keys]
    new = new.groupBy(*keys).agg(F.max(F.struct(*others)).alias("new"))
    held = old.select(*keys, F.struct(*others).alias("old"))
    key = reduce(lambda a, b: a & b, (held[k].eqNullSafe(new[k]) for k in keys))
    both = held.join(new, key, "full_outer")
    value = lambda c: F.coalesce(F.col("old")[c], F.col("new")[c]) if c in kept else F.coalesce(F.col("new")[c], F.col("old")[c])
    action = F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "kept").otherwise("updated")
    return both.select(*(F.when(F.col("old").isNull(), new[k]).otherwise(held[k]).alias(k) for k in keys), *(value(c).alias(c) for c in others), action.alias("action")).select(*old.columns, "action")


def next_versions(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` (key, ord) numbered on from the highest version of each key."""
    last = old.groupBy(key).agg(F.max("version").alias("last"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("ord"))
    return new.withColumn("nth", nth).join(last, key, "left").withColumn("version", (F.coalesce("last", F.lit(0)) + F.col("nth")).cast("long")).drop("last", "nth")


def drop_stale(old: DataFrame, seen: DataFrame, keys: list[str], protected: Column) -> DataFrame:
    """``old`` without rows that an import no longer has, but for protected ones (edited by hand)."""
    stale = old.join(seen.select(*keys).distinct(), keys, "left_anti").where(~F.coalesce(protected, F.lit(False))).select(*keys)
    return old.join(stale, keys, "left_anti")


def latest_children(parents: DataFrame, children: DataFrame, key: str, order: list[Column], n: int, fields: list[str], name: str = "children") -> DataFrame:
    """Parents with an ordered array of their first ``n`` children; none gives an empty array."""
    ranked = children.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= n)
    nested = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_n", *fields))).alias("_all"))
    nested = nested.select(key, F.transform("_all", lambda c: F.struct(*(c[f].alias(f) for f in fields))).alias(name))
    out = parents.join(nested, key, "left")
    return out.withColumn(name, F.coalesce(name, F.array().cast(nested.schema[name].dataType)))


def child_counts(parents: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """Parents with the number of rows that each child table has for them. Counted first, then joined."""
    out = parents
    for name, table in children.items():
        out = out.join(table.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def missing_combinations(wanted: list[DataFrame], present: DataFrame) -> DataFrame:
    """Combinations of small lists that a table lacks."""
    every = reduce(lambda a, b: a.crossJoin(broadcast_if_small(b)), wanted)  # what is wanted is all of these
    return every.join(present, every.columns, "left_anti")


def usage(references: list[DataFrame], key: str = "media_id") -> DataFrame:
    """How often each id is referred to over several tables."""
    rows = reduce(lambda a, b: a.unionByName(b), (r.select(key) for r in references))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("uses"))


def quality(rows: DataFrame, expected: Column, found: Column) -> DataFrame:
    """Accuracy, precision, recall and F1 of a yes/no verdict; 0 where a share has no base."""
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(expected & found).alias("tp"), F.count_if(~expected & found).alias("fp"), F.count_if(expected & ~found).alias("fn"), F.count_if(expected == found).alias("right"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select("n", "tp", "fp", "fn", share(F.col("right"), F.col("n")).alias("accuracy"), p.alias("precision"), r.alias("recall"), share(2 * p * r, p + r).alias("f1"))


def conflicting_values(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one distinct value."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("n_values"), F.min(value).alias("low"), F.max(value).alias("high")).where("n_values > 1")


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that must be unique and are not."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def weighted_vote(votes: DataFrame, key: str, value: str, confidence: str) -> DataFrame:
    """The value with most weight per key: confident votes (0.75 or more) count twice; ties go to the smaller value."""
    weight = F.when(F.col(confidence) >= 0.75, 2).otherwise(1)
    sums = votes.groupBy(key, value).agg(F.sum(weight).alias("weight"))
    order = Window.partitionBy(key).orderBy(F.desc("weight"), value)
    return sums.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def follow_survivors(leads: DataFrame, depth: int = 5) -> DataFrame:
    """id, survivor_id: where a chain of merges ends, followed over at most 2 ** depth steps.

    ``leads``: id, merged_into (null at the end). Each round doubles the steps taken.
    """
    to = leads.select("id", F.coalesce("merged_into", "id").alias("survivor_id"))
    for _ in range(depth):
        to = to.join(to.select(F.col("id").alias("survivor_id"), F.col("survivor_id").alias("further")), "survivor_id", "left").select("id", F.coalesce("further", "survivor_id").alias("survivor_id"))
    return to
