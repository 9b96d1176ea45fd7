"""Pictures of a page: one address for all copies of a picture, what is no picture, and the choice of a cover with its log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.functions.compat import bound, yes

# Hosts of resized copies, hosts that only count visitors, names of placeholders and of what is no cover.
COPIES = r"(?i)(^|\.)(thb|optim|static|static-files)\.tildacdn\.[A-Za-z0-9_]+$"
ORIGINALS = "https://static.tildacdn.biz"
COUNTERS = r"(?i)(^|\.)(mc\.yandex\.|mc\.webvisor\.|google-analytics\.com|googletagmanager\.com|stats\.g\.doubleclick\.net|doubleclick\.net|googleadservices\.com|connect\.facebook\.net|facebook\.com|counter\.|metrika)"
PLACEHOLDERS = r"(?i)^(spacer|blank|pixel|1x1|transparent)\.(gif|png)$"
NO_COVER_ROLES = ("LOGO", "UTILITY_ICON", "LANGUAGE_ICON", "ADVERTISEMENT")
NO_COVER_NAMES = r"(?i)logo|icon|лого|favicon|fav-|removebg|placeholder|spinner|avatar|thumb(?!nail-?large)"
BASE = {"HERO_CANDIDATE": 0.85, "SERVICE_IMAGE": 0.8, "PROJECT_IMAGE": 0.8, "ARTICLE_IMAGE": 0.8, "TEAM_IMAGE": 0.6}
LEAST = 0.5


def _host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def original(src: Column) -> Column:
    """The address of the picture that resized copies are made of, so that copies meet by it; others stay."""
    whole = F.when(F.startswith(src, F.lit("//")), F.concat(F.lit("https:"), src)).otherwise(src)

    def settled(url: Column) -> Column:
        path = _path(url)
        file = F.regexp_replace(F.substring_index(F.substring_index(path, "/-/", -1), "/", -1), r"(?i)\.webp$", "")
        copy = F.rlike(_host(url), F.lit(COPIES)) & F.contains(path, F.lit("/-/")) & (file != "")
        return F.when(copy, F.concat(F.lit(ORIGINALS), F.substring_index(path, "/-/", 1), F.lit("/"), file)).otherwise(url)

    return bound(whole, settled)


def droppable(src: Column, width: Column, height: Column) -> Column:
    """No address, data in place of one, counters, placeholders, and pictures of one dot."""
    named = F.rlike(_host(src), F.lit(COUNTERS)) | F.rlike(F.substring_index(_path(src), "/", -1), F.lit(PLACEHOLDERS))
    dot = F.coalesce(width.between(1, 1) & height.between(1, 1), F.lit(False))
    return F.coalesce(src, F.lit("")).isin("") | yes(F.startswith(src, F.lit("data:"))) | yes(named) | dot


def suitability(src: Column, alt: Column, width: Column, height: Column, role: Column) -> Column:
    """struct(score, suitable, reasons) of a picture as a cover."""
    w, h = F.coalesce(width, F.lit(0)), F.coalesce(height, F.lit(0))
    name = F.concat_ws(" ", F.coalesce(alt, F.lit("")), F.substring_index(src, "/", -1))
    known = (w > 0) & (h > 0)
    ratio = F.when(known, w / h)
    rounded = F.format_string("%.2f", ratio)
    size = F.concat(w.cast("string"), F.lit("x"), h.cast("string"))
    refused = (
        F.when(yes(role.isin(*NO_COVER_ROLES)), F.concat(F.lit("role:"), role))
        .when(F.rlike(name, F.lit(NO_COVER_NAMES)), F.lit("logo/icon filename or alt"))
        .when(known & ((w < 320) | (h < 200)), F.concat(F.lit("too-small:"), size))
        .when(known & ((ratio > 4) | (ratio < 0.25)), F.concat(F.lit("extreme-aspect:"), rounded))
    )
    noted = F.when(~known, F.lit("unknown-dimensions")).when(ratio < 0.8, F.concat(F.lit("portrait:"), rounded))
    base = F.lit(0.5)
    for kind, value in BASE.items():
        base = F.when(role == kind, value).otherwise(base)
    more = F.when(w >= 1200, 0.1).otherwise(0.0) + F.when(w >= 2000, 0.05).otherwise(0.0) + F.when(yes(ratio.between(1.2, 2.2)), 0.05).otherwise(0.0) - F.when(yes(ratio < 0.8), 0.15).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + more))
    reasons = lambda *r: F.array_compact(F.array(*r))
    return bound(refused, lambda no: F.when(no.isNotNull(), F.struct(F.lit(0.0).alias("score"), F.lit(False).alias("suitable"), reasons(no).alias("reasons"))).otherwise(F.struct(score.alias("score"), (score >= LEAST).alias("suitable"), reasons(noted).alias("reasons"))))


def covers(images: DataFrame, key: str) -> DataFrame:
    """``key``, cover, score, mode and candidates (ord, src, score, suitable, reasons) for each key.

    ``images``: key, ord, src, alt, width, height, role. What is no picture drops out; of copies of one picture the first
    counts. The best suitable one is the cover, the first on ties; every candidate is kept with its reasons.
    """
    rows = images.where(~droppable(F.col("src"), F.col("width"), F.col("height"))).withColumn("src", original(F.col("src")))
    once = rows.groupBy(key, "src").agg(F.min_by(F.struct("ord", "alt", "width", "height", "role"), "ord").alias("i")).select(key, "src", "i.*")
    scored = once.select(key, "ord", "src", suitability(F.col("src"), F.col("alt"), F.col("width"), F.col("height"), F.col("role")).alias("s"))
    best = F.max_by(F.struct("src", "s.score"), F.when(F.col("s.suitable"), F.struct("s.score", -F.col("ord"))))
    found = scored.groupBy(key).agg(best.alias("best"), F.array_sort(F.collect_list(F.struct("ord", "src", "s.score", "s.suitable", "s.reasons"))).alias("candidates"))
    return found.select(key, F.col("best.src").alias("cover"), F.col("best.score").alias("score"), F.when(F.col("best").isNotNull(), "SELECTED").otherwise("TEXT_ONLY").alias("mode"), "candidates")
