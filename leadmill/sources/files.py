"""Sources and sinks: raw provider JSON, manual lists, lockfiles, sitemaps, CSV and JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "id string, name string, address_name string, rubrics array<struct<name:string>>, point struct<lat:double,lon:double>, url string, contacts array<struct<type:string,value:string,url:string,text:string>>, contact_groups array<struct<name:string,contacts:array<struct<type:string,value:string,url:string,text:string>>>>"


def provider_items(spark: SparkSession, path: str) -> DataFrame:
    """Landed provider responses, one item a line, with a declared schema; broken lines are kept in ``_broken``."""
    return spark.read.schema(ITEM + ", _broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)


def contact(items: DataFrame, kind: str) -> Column:
    """The first contact of a kind: groups before flat contacts, and of one its url, value or text."""
    none = F.array().cast("array<struct<type:string,value:string,url:string,text:string>>")
    grouped = F.flatten(F.transform(F.coalesce("contact_groups", F.array().cast("array<struct<name:string,contacts:array<struct<type:string,value:string,url:string,text:string>>>>")), lambda g: F.coalesce(g["contacts"], none)))
    told = F.transform(F.filter(F.concat(grouped, F.coalesce("contacts", none)), lambda c: c["type"] == kind), lambda c: F.coalesce(F.nullif(F.trim(c["url"]), F.lit("")), F.nullif(F.trim(c["value"]), F.lit("")), F.nullif(F.trim(c["text"]), F.lit(""))))
    return F.get(F.filter(told, lambda v: v.isNotNull()), 0)


def leads_from_items(items: DataFrame) -> DataFrame:
    return items.select(F.col("id").alias("source_id"), F.col("name").alias("company_name"), F.col("address_name").alias("address"), F.transform("rubrics", lambda r: r["name"]).alias("categories"), F.col("point.lat").alias("latitude"), F.col("point.lon").alias("longitude"), contact(items, "website").alias("website"), contact(items, "phone").alias("phone"), F.col("url").alias("source_url"))


def manual_leads(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file: name, website, phone, address split at tabs, bars or semicolons; the id hashes the line."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parts = F.transform(F.split("value", r"[\t|;]"), lambda p: F.trim(p))
    field = lambda i: F.nullif(F.get(parts, i), F.lit(""))
    return lines.select(F.substring(F.sha1("value"), 1, 16).alias("source_id"), field(0).alias("company_name"), field(1).alias("website"), field(2).alias("phone"), field(3).alias("address"))


def lockfile_packages(spark: SparkSession, path: str) -> DataFrame:
    """name, version, dev of every package of a lockfile (JSON keyed by path)."""
    schema = "packages map<string,struct<version:string,dev:boolean,optional:boolean>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("packages").alias("place", "p"))
    return rows.where("place <> ''").select(F.substring_index("place", "node_modules/", -1).alias("name"), "p.version", F.coalesce("p.dev", F.lit(False)).alias("dev"))


def sitemap_urls(documents: DataFrame) -> DataFrame:
    """``documents`` (url, body) of sitemaps: url, loc of each entry."""
    return documents.select("url", F.explode(F.regexp_extract_all("body", F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), 1)).alias("loc"))


def robots_sitemaps(documents: DataFrame) -> DataFrame:
    return documents.select("url", F.explode(F.regexp_extract_all("body", F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), 1)).alias("sitemap"))


def write_csv(frame: DataFrame, path: str) -> None:
    """Flat columns with a header, quotes doubled; of an array its first value; null is empty."""
    flat = [F.get(c, 0).alias(c) if t.startswith("array") else F.col(c) for c, t in frame.dtypes]
    frame.select(*flat).write.option("header", True).option("quote", '"').option("escape", '"').option("nullValue", "").csv(path)


def append_json_lines(frame: DataFrame, path: str) -> None:
    frame.write.mode("append").json(path)
