"""Lead scores as column arithmetic. ``as_of`` stands for now, so results repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.functions.compat import clamp, round_half_up, yes

# Weights of the two scores.
LIGHTHOUSE_WEIGHTS = {"performance": 0.55, "seo": 0.20, "accessibility": 0.15, "best_practices": 0.10}
V2_WEIGHTS = {"visual": 0.65, "technical": 0.2, "potential": 0.15}


def tokens(text: Column) -> Column:
    """Distinct lower-cased runs of letters and digits, three characters or longer."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays of distinct values; 0 if either is empty."""
    either = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def _points(*rules: tuple[Column, int]) -> Column:
    out = F.lit(0)
    for condition, points in rules:
        out = out + F.when(yes(condition), points).otherwise(0)
    return out


def _present(name: str, least: int) -> Column:
    return F.length(F.trim(F.coalesce(F.col(name), F.lit("")))) >= least


def lead_score_v1(rows: DataFrame, as_of: Column) -> DataFrame:
    """Adds website_quality_score, business_score, lead_score and primary_weakness.

    Columns: performance, seo, accessibility, best_practices; company_name, website, phone, address;
    has_crawl, title, meta_description, h1, viewport, footer_years, latest_content_date (timestamp),
    has_news, n_forms, n_buttons, n_links, n_tel, n_mailto, n_social. Without a crawl none of its rules apply.
    """
    crawl, year = yes(F.col("has_crawl")), F.year(as_of)
    footer = F.coalesce(F.array_max("footer_years"), F.lit(0))
    age = (F.unix_micros(as_of) - F.unix_micros("latest_content_date")) / 86_400_000_000
    n = lambda name: F.coalesce(F.col(name), F.lit(0))
    lighthouse = sum((F.col(k) * F.lit(w) for k, w in LIGHTHOUSE_WEIGHTS.items()), F.lit(0.0))
    penalty = _points((~_present("title", 5), 6), (~_present("meta_description", 20), 6), (~_present("h1", 3), 4), (~_present("viewport", 1), 8), (n("n_links") < 5, 3), ((n("n_buttons") == 0) & (n("n_forms") == 0), 2), ((footer > 0) & (footer <= year - 5), 2), (age >= 365 * 3, 2))
    bonus = _points((n("n_tel") > 0, 2), (n("n_mailto") > 0, 1), (n("n_social") > 0, 1), (n("n_forms") > 0, 2), (footer >= year, 3), (footer == year - 1, 2), (age <= 120, 3), ((age > 120) & (age <= 365), 2), (F.col("has_news"), 1))
    quality = clamp(lighthouse + F.when(crawl, bonus - penalty).otherwise(0), 0, 100)
    alike = jaccard(tokens(F.coalesce("company_name", F.lit(""))), tokens(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("h1", F.lit("")))))
    own = _points((_present("website", 1), 15), (_present("phone", 1), 25), (_present("address", 1), 20))
    seen = _points((n("n_tel") > 0, 10), (n("n_mailto") > 0, 8), (n("n_social") > 0, 7), (n("n_forms") > 0, 5), (n("n_links") >= 15, 5), (n("n_links") >= 40, 5), (alike >= 0.12, 10), (alike >= 0.20, 5), (footer >= year - 1, 5), (age <= 365, 5), (F.col("has_news"), 2))
    business = clamp(own + F.when(crawl, seen).otherwise(0), 0, 100)
    rest = (F.col("seo") + F.col("accessibility") + F.col("best_practices")) / 3
    weakness = F.when(F.col("performance") < 40, "performance").when(rest < 70, "quality").otherwise("unknown")
    out = rows.withColumns({"website_quality_score": quality, "business_score": business, "primary_weakness": weakness})
    return out.withColumn("lead_score", clamp((100 - F.col("website_quality_score")) * F.col("business_score") / 100, 0, 100))


def lead_score_v2(rows: DataFrame) -> DataFrame:
    """Adds lead_score_v2, redesign_opportunity and reasons, from technical_quality, visual_quality,
    business_confidence and redesign_potential (all 0..100)."""
    out = rows.withColumns({"technical_opportunity": clamp(100 - F.col("technical_quality"), 0, 100), "visual_opportunity": clamp(100 - F.col("visual_quality"), 0, 100)})
    weighed = F.col("visual_opportunity") * V2_WEIGHTS["visual"] + F.col("technical_opportunity") * V2_WEIGHTS["technical"] + F.col("redesign_potential") * V2_WEIGHTS["potential"]
    out = out.withColumn("redesign_opportunity", clamp(weighed, 0, 100))
    reasons = F.array(
        F.when(F.col("business_confidence") >= 60, "active-looking business"),
        F.when(F.col("visual_opportunity") >= 60, "visually outdated or weak design"),
        F.when(F.col("technical_opportunity") >= 60, "technical issues / low lighthouse"),
        F.when(F.col("redesign_potential") >= 70, "high redesign potential"),
    )
    return out.withColumns({"lead_score_v2": clamp(F.col("redesign_opportunity") * F.col("business_confidence") / 100, 0, 100), "reasons": F.array_compact(reasons)})


def v2_inputs(rows: DataFrame) -> DataFrame:
    """Fallbacks of the second score's inputs: visual scores of 1..10 count tenfold, Lighthouse its mean."""
    mean = round_half_up((F.col("performance") + F.col("seo") + F.col("accessibility") + F.col("best_practices")) / 4)
    return rows.withColumns({
        "technical_quality": F.coalesce(F.col("website_quality_score"), mean, F.lit(0)),
        "visual_quality": F.coalesce(F.col("visual_quality_score"), F.col("overall_visual") * 10, F.lit(0)),
        "business_confidence": F.coalesce(F.col("business_score"), F.col("trust") * 10, F.lit(0)),
        "redesign_potential": F.coalesce(F.col("redesign_potential_score") * 10, F.lit(0)),
    })
