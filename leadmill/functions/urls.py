"""URLs as Spark expressions: canonical identity, site policy, crawl keys, link classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadmill.functions.compat import bound

# Query parameters that never tell two websites apart.
TRACKING = r"(?i)^(utm_|fbclid$|gclid$|yclid$|dclid$|mc_cid$|mc_eid$|igshid$|_ga$|_gl$|spm$|ref$|ref_|source$|campaign|medium$|sourceid$|from$|openstat|roistat|ymclid|erid$)"
#: Suffixes under which names are registered one level deeper: a stated subset of the public list.
DEEP_SUFFIXES = ("com.by", "co.uk", "org.uk", "com.ru", "com.ua", "com.tr", "com.br", "com.au", "co.jp", "co.kr", "com.cn", "gov.by")
# The site policy, first match wins. (kind, host, reason, category)
POLICY = (
    ("suffix", "ibiz.by", "DIRECTORY", "AGGREGATOR"),
    ("suffix", "jsprav.ru", "DIRECTORY", "AGGREGATOR"),
    ("suffix", "spr.by", "DIRECTORY", "AGGREGATOR"),
    ("suffix", "spisok.by", "DIRECTORY", "AGGREGATOR"),
    ("suffix", "rubrikator.org", "DIRECTORY", "AGGREGATOR"),
    ("suffix", "by.spr.ru", "DIRECTORY", "AGGREGATOR"),
    ("suffix", "cataloxy-by.ru", "DIRECTORY", "AGGREGATOR"),
    ("suffix", "cataloxy.ru", "DIRECTORY", "AGGREGATOR"),
    ("exact", "yell.ru", "DIRECTORY", "AGGREGATOR"),
    ("exact", "yell.by", "DIRECTORY", "AGGREGATOR"),
    ("exact", "zoon.ru", "DIRECTORY", "AGGREGATOR"),
    ("suffix", "gmc.by", "DIRECTORY", "AGGREGATOR"),
    ("suffix", "deal.by", "MARKETPLACE", "MARKETPLACE"),
    ("suffix", "rubrikator.by", "DIRECTORY", "AGGREGATOR"),
    ("suffix", "minsk-city.by", "DIRECTORY", "AGGREGATOR"),
    ("suffix", "domovita.by", "DIRECTORY", "AGGREGATOR"),
    ("suffix", "gov.by", "GOVERNMENT", "GOVERNMENT"),
    ("suffix", "2gis.ru", "MAP_PROVIDER", "MAP_PROVIDER"),
    ("suffix", "2gis.by", "MAP_PROVIDER", "MAP_PROVIDER"),
    ("suffix", "2gis.com.by", "MAP_PROVIDER", "MAP_PROVIDER"),
    ("suffix", "2gis.kz", "MAP_PROVIDER", "MAP_PROVIDER"),
    ("suffix", "2gis.com", "MAP_PROVIDER", "MAP_PROVIDER"),
    ("exact", "yandex.ru", "SEARCH_ENGINE", "SEARCH_ENGINE"),
    ("exact", "yandex.by", "SEARCH_ENGINE", "SEARCH_ENGINE"),
    ("exact", "yandex.com", "SEARCH_ENGINE", "SEARCH_ENGINE"),
    ("suffix", "yandex.ru", "SEARCH_ENGINE", "SEARCH_ENGINE"),
    ("suffix", "yandex.by", "SEARCH_ENGINE", "SEARCH_ENGINE"),
    ("suffix", "yandex.com", "SEARCH_ENGINE", "SEARCH_ENGINE"),
    ("exact", "google.com", "SEARCH_ENGINE", "SEARCH_ENGINE"),
    ("suffix", "google.com", "SEARCH_ENGINE", "SEARCH_ENGINE"),
    ("exact", "vk.com", "SOCIAL_NETWORK", "SOCIAL_NETWORK"),
    ("exact", "facebook.com", "SOCIAL_NETWORK", "SOCIAL_NETWORK"),
    ("exact", "instagram.com", "SOCIAL_NETWORK", "SOCIAL_NETWORK"),
    ("exact", "linkedin.com", "SOCIAL_NETWORK", "SOCIAL_NETWORK"),
    ("exact", "ok.ru", "SOCIAL_NETWORK", "SOCIAL_NETWORK"),
    ("exact", "youtube.com", "SOCIAL_NETWORK", "SOCIAL_NETWORK"),
    ("exact", "tiktok.com", "SOCIAL_NETWORK", "SOCIAL_NETWORK"),
    ("exact", "wildberries.ru", "MARKETPLACE", "MARKETPLACE"),
    ("exact", "ozon.ru", "MARKETPLACE", "MARKETPLACE"),
    ("exact", "aliexpress.com", "MARKETPLACE", "MARKETPLACE"),
    ("exact", "market.yandex.ru", "MARKETPLACE", "MARKETPLACE"),
    ("exact", "minsk.jsprav.ru", "DIRECTORY", "AGGREGATOR"),
    ("exact", "rubrikator.org", "DIRECTORY", "AGGREGATOR"),
    ("exact", "spisok.by", "DIRECTORY", "AGGREGATOR"),
    ("exact", "spr.by", "DIRECTORY", "AGGREGATOR"),
    ("exact", "by.spr.ru", "DIRECTORY", "AGGREGATOR"),
)


def with_scheme(raw: Column) -> Column:
    """Trimmed, with https in front where no scheme is given; null where nothing is left."""
    raw = F.nullif(F.trim(raw), F.lit(""))
    return F.when(F.contains(raw, F.lit("://")), raw).otherwise(F.concat(F.lit("https://"), raw))


def host(raw: Column) -> Column:
    """Lower-cased host without one leading www; null unless it has a dot and is a host."""
    name = F.regexp_extract(with_scheme(raw), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    name = F.regexp_replace(F.lower(name), r"^www\.", "")
    good = F.contains(name, F.lit(".")) & ~F.rlike(name, F.lit(r"\s"))
    return F.when(good, name)


def registrable(name: Column) -> Column:
    """The registered domain of a host: the last two labels, three under a deep suffix."""
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(*DEEP_SUFFIXES), F.substring_index(name, ".", -3)).otherwise(two)


def clean_path(raw: Column) -> Column:
    """The path with doubled slashes folded and no slash at its end; the root stays."""
    path = F.regexp_extract(with_scheme(raw), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, "/{2,}", "/"), "(?<=.)/$", "")
    return F.coalesce(F.nullif(path, F.lit("")), F.lit("/"))


def clean_query(raw: Column) -> Column:
    """Parameters without those that only track, sorted by name; equal names keep their order."""
    query = F.regexp_extract(with_scheme(raw), r"^[^?#]*\?([^#]*)", 1)
    parts = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.rlike(F.substring_index(p, "=", 1), F.lit(TRACKING)))
    keyed = F.array_sort(F.transform(parts, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("name"), i.alias("i"), F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))).alias("part"))))
    return F.array_join(F.transform(keyed, lambda k: k["part"]), "&")


def canonical(raw: Column) -> Column:
    """struct(url, host, domain, url_key): what one website is known by; fields are null for no website."""
    parts = F.struct(host(raw).alias("host"), clean_path(raw).alias("path"), F.regexp_replace(clean_query(raw), "^(?=.)", "?").alias("query"))
    named = lambda p: F.struct(F.concat(F.lit("https://"), p["host"], p["path"], p["query"]).alias("url"), p["host"].alias("host"), registrable(p["host"]).alias("domain"), F.concat(registrable(p["host"]), p["path"]).alias("url_key"))
    return bound(parts, named)


def policy_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, kind, name, reason, f"{kind}:{name} ({category})") for i, (kind, name, reason, category) in enumerate(POLICY)], "ord int, kind string, name string, reason string, rule string")


def eligibility(sites: DataFrame, key: str, website: str) -> DataFrame:
    """``key``, canonical_url, canonical_domain, eligible, reason, matched_rule for each row of ``sites``.

    The policy is a table: every suffix of a host joins it, and the first rule in order decides.
    """
    raw = F.trim(F.coalesce(F.col(website), F.lit("")))
    rows = sites.select(key, raw.alias("raw")).withColumn("domain", host(F.col("raw")))
    labels = F.split("domain", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = rows.where("domain is not null").select("domain").distinct()
    tried = hosts.select("domain", F.explode(suffixes).alias("name"))
    hits = tried.join(F.broadcast(policy_table(sites.sparkSession)), "name").where("kind = 'suffix' or name = domain")  # a fixed list
    first = hits.groupBy("domain").agg(F.min_by(F.struct("reason", "rule"), "ord").alias("hit"))
    out = rows.join(first, "domain", "left")
    reason = F.when(F.col("raw") == "", "NO_WEBSITE").when(F.col("domain").isNull(), "INVALID_URL").otherwise(F.col("hit.reason"))
    url = F.when(F.col("raw") != "", F.when(F.rlike("raw", F.lit("^https?://")), F.col("raw")).otherwise(F.concat(F.lit("https://"), "raw")))
    return out.select(key, url.alias("canonical_url"), F.col("domain").alias("canonical_domain"), reason.isNull().alias("eligible"), reason.alias("reason"), F.col("hit.rule").alias("matched_rule"))


def first_per(frame: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return frame.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
