"""The lead model, projected from the relational sample tables so that every query has real input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _by_rest(modulus: int, values: dict[int, str], otherwise: str) -> Column:
    out = None
    for rest, value in values.items():
        test = F.col("id") % modulus == rest
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(otherwise)


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer in the shape of a lead; reports come from its orders, its website from ``pages``."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("city"))
    base = table(spark, sf_dir, "customer").join(F.broadcast(nation), "c_nationkey", "left")  # nations are 25
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(*(F.bool_or(F.col("o_orderstatus") == s).alias(s) for s in "FOP"))
    pages = table(spark, sf_dir, "pages")
    n_pages = pages.agg(F.count(F.lit(1)).alias("n_pages"))
    out = base.withColumn("id", F.col("c_custkey")).join(orders, "id", "left").crossJoin(F.broadcast(n_pages))  # one row
    out = out.withColumn("page_id", F.when(F.col("n_pages") > 0, F.col("id") % F.col("n_pages")))
    out = out.join(pages.select("page_id", F.col("url").alias("website")), "page_id", "left")
    report = lambda ok: F.when(F.col(ok), "SUCCESS").when(F.col(ok).isNotNull(), "FAILED")
    return out.select(
        "id",
        F.col("c_name").alias("company_name"),
        "city",
        "website",
        F.lpad((F.col("id") % 500).cast("string"), 9, "3").alias("phone"),
        F.concat("c_mktsegment", F.lit(" st "), (F.col("id") % 97).cast("string")).alias("address"),
        _by_rest(4, {0: "NOT_FOUND", 1: "UNKNOWN"}, "FOUND").alias("website_status"),
        _by_rest(5, {0: "FAILED", 1: "PENDING"}, "SUCCESS").alias("audit_status"),
        _by_rest(7, {0: "FAILED", 1: "PENDING"}, "SUCCESS").alias("score_status"),
        _by_rest(3, {0: "SUCCESS"}, "PENDING").alias("enrichment_status"),
        _by_rest(6, {0: "GOOD", 1: "BAD", 2: "UNSURE"}, "UNREVIEWED").alias("manual_review_status"),
        _by_rest(8, {0: "SELECTED_FOR_REDESIGN", 1: "CRAWL_READY", 2: "DEMO_GENERATED", 3: "CRAWL_FAILED"}, "NOT_SELECTED").alias("redesign_stage"),
        _by_rest(50, {0: "MERGED"}, "NONE").alias("merge_status"),
        _by_rest(12, {0: "NO_WEBSITE", 1: "DIRECTORY", 2: "GOVERNMENT", 3: "SOCIAL_NETWORK", 4: "MARKETPLACE", 5: "INVALID_URL"}, "NONE").alias("ineligibility_reason"),
        (F.col("id") % 41 == 0).alias("archived"),
        F.when(F.col("id") % 10 != 0, F.floor(F.abs("c_acctbal")).cast("long") % 101).alias("lead_score"),
        F.when(F.col("id") % 9 != 0, (F.col("id") * 37) % 101).alias("lead_score_v2"),
        ((F.col("id") * 13) % 101).alias("business_score"),
        ((F.col("id") * 29) % 101).alias("website_quality_score"),
        report("F").alias("lighthouse_status"),
        report("O").alias("visual_status"),
        F.coalesce(F.col("P"), F.lit(False)).alias("has_site"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=(F.col("id") % 100000).cast("int"))).alias("created_at"),
    )


#: The same projection for the oracle, as a common table expression named ``leads``.
LEADS_SQL = """
leads AS (
  SELECT c_custkey AS id, c_name AS company_name, n_name AS city, url AS website,
    lpad(CAST(c_custkey % 500 AS VARCHAR), 9, '3') AS phone,
    c_mktsegment || ' st ' || CAST(c_custkey % 97 AS VARCHAR) AS address,
    CASE c_custkey % 4 WHEN 0 THEN 'NOT_FOUND' WHEN 1 THEN 'UNKNOWN' ELSE 'FOUND' END AS website_status,
    CASE c_custkey % 5 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'PENDING' ELSE 'SUCCESS' END AS audit_status,
    CASE c_custkey % 7 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'PENDING' ELSE 'SUCCESS' END AS score_status,
    CASE c_custkey % 3 WHEN 0 THEN 'SUCCESS' ELSE 'PENDING' END AS enrichment_status,
    CASE c_custkey % 6 WHEN 0 THEN 'GOOD' WHEN 1 THEN 'BAD' WHEN 2 THEN 'UNSURE' ELSE 'UNREVIEWED' END AS manual_review_status,
    CASE c_custkey % 8 WHEN 0 THEN 'SELECTED_FOR_REDESIGN' WHEN 1 THEN 'CRAWL_READY' WHEN 2 THEN 'DEMO_GENERATED'
      WHEN 3 THEN 'CRAWL_FAILED' ELSE 'NOT_SELECTED' END AS redesign_stage,
    CASE c_custkey % 50 WHEN 0 THEN 'MERGED' ELSE 'NONE' END AS merge_status,
    CASE c_custkey % 12 WHEN 0 THEN 'NO_WEBSITE' WHEN 1 THEN 'DIRECTORY' WHEN 2 THEN 'GOVERNMENT' WHEN 3 THEN 'SOCIAL_NETWORK'
      WHEN 4 THEN 'MARKETPLACE' WHEN 5 THEN 'INVALID_URL' ELSE 'NONE' END AS ineligibility_reason,
    c_custkey % 41 = 0 AS archived,
    CASE WHEN c_custkey % 10 <> 0 THEN CAST(floor(abs(c_acctbal)) AS BIGINT) % 101 END AS lead_score,
    CASE WHEN c_custkey % 9 <> 0 THEN (c_custkey * 37) % 101 END AS lead_score_v2,
    (c_custkey * 13) % 101 AS business_score, (c_custkey * 29) % 101 AS website_quality_score,
    CASE WHEN f THEN 'SUCCESS' WHEN f IS NOT NULL THEN 'FAILED' END AS lighthouse_status,
    CASE WHEN o THEN 'SUCCESS' WHEN o IS NOT NULL THEN 'FAILED' END AS visual_status,
    coalesce(p, FALSE) AS has_site,
    TIMESTAMP '2024-01-01' + to_minutes(c_custkey % 100000) AS created_at
  FROM customer
  LEFT JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS f, bool_or(o_orderstatus = 'O') AS o, bool_or(o_orderstatus = 'P') AS p
             FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey
  LEFT JOIN pages ON page_id = c_custkey % (SELECT count(*) FROM pages)
)"""
