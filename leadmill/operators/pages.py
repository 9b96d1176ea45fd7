"""Web pages: signals, links, crawl plan, classification and backlinks, as joins over extracted rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadmill.functions import urls
from leadmill.functions.compat import one_space

# What a crawl leaves out, what counts as little value, and how sources rank.
BLOCKED_SEGMENTS = ("login", "admin", "wp-admin", "cart", "checkout", "privacy", "cookie", "cookies", "terms", "search", "wp-login", "logout", "account", "register", "auth", "authentication", "authorization", "wp-content", "wp-includes", "wp-json", "xmlrpc", "feed", "comments", "trackback")
BLOCKED_EXTENSIONS = ("pdf", "jpg", "jpeg", "png", "gif", "svg", "webp", "ico", "zip", "rar", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "mp3", "mp4", "avi", "mov", "css", "js", "xml", "rss", "json")
BLOCKED_QUERY = ("fbclid", "gclid", "action", "feed", "share", "replytocom")
KEPT_QUERY = ("page", "p", "category", "tag")
LOW_VALUE = r"(login|logout|signin|signup|register|auth|account|cart|basket|checkout|search|print|share|feed|trackback|xmlrpc|wp-|tag|tags|archive|filter|sort|compare|wishlist|subscribe|unsubscribe|sitemap|impressum|privacy|cookie|terms|policy|soglasie|politika|личный|кабинет|корзина|поиск)"
SOURCE_PRIORITY = {"root": -1000, "nav": -100, "sitemap": -50, "collection": -10, "body": 0, "footer": 10}
INDEX_PRIORITY, LOW_VALUE_PRIORITY = -75, 50
# Types, their words in a path or heading, their points there, and the type of one entry.
PAGE_TYPES = (
    ("ABOUT", "about|company", 5, 6, "ABOUT"),
    ("SERVICES_INDEX", "service|leistung|servic", 6, 7, "SERVICE_DETAIL"),
    ("PROJECTS_INDEX", "project|portfolio", 6, 7, "PROJECT_DETAIL"),
    ("NEWS_INDEX", "news|blog|article", 7, 8, "NEWS_DETAIL"),
    ("VACANCIES_INDEX", "vacanc|career|jobs", 6, 7, "VACANCY_DETAIL"),
    ("PRODUCTS_INDEX", "product|catalog|shop", 6, 7, "PRODUCT_DETAIL"),
    ("REVIEWS_INDEX", "review|testimonial", 6, 7, "REVIEW_DETAIL"),
    ("CONTACTS", "contact|kontakt", 8, 9, "CONTACTS"),
    ("LEGAL", "privacy|terms|legal|impressum", 9, 10, "LEGAL"),
)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def parameter_names(url: Column) -> Column:
    return F.transform(F.filter(F.split(query_of(url), "&"), lambda p: p != ""), lambda p: F.lower(F.element_at(F.split(p, "=", 2), 1)))


def page_key(url: Column) -> Column:
    """Host without www and path without index file or slash at its end: what a page is compared by."""
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"(?i)/index\.html?$", ""), "/+$", "")
    return F.concat(urls.host(url), F.coalesce(F.nullif(path, F.lit("")), F.lit("/")))


def crawl_url(url: Column) -> Column:
    """The URL without fragment, index file and parameters that do not choose content."""
    root = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_replace(path_of(url), r"(?i)/index\.html?$", "")
    path = F.when(F.rlike(path, F.lit(".+/$")), F.concat(F.regexp_replace(path, "/+$", ""), F.lit("/"))).otherwise(path)
    kept = F.array_join(F.filter(F.split(query_of(url), "&"), lambda p: F.lower(F.element_at(F.split(p, "=", 2), 1)).isin(*KEPT_QUERY)), "&")
    return F.concat(F.lower(root), F.coalesce(F.nullif(path, F.lit("")), F.lit("/")), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def should_crawl(url: Column) -> Column:
    """False for other schemes, blocked path segments, file types and parameters."""
    path = F.lower(path_of(url))
    blocked = F.exists(parameter_names(url), lambda k: F.startswith(k, F.lit("utm_")) | k.isin(*BLOCKED_QUERY))
    segment = F.exists(F.split(path, "/"), lambda s: s.isin(*BLOCKED_SEGMENTS) | (s == "print"))
    return F.rlike(url, F.lit("^https?://")) & ~blocked & ~segment & ~F.regexp_extract(path, r"\.([a-z0-9]+)$", 1).isin(*BLOCKED_EXTENSIONS)


def low_value(url: Column) -> Column:
    path, names = F.lower(path_of(url)), parameter_names(url)
    number = F.regexp_extract(F.lower(query_of(url)), r"(?:^|&)(?:page|p)=([0-9]+)", 1)
    return F.rlike(path, F.lit(LOW_VALUE)) | F.rlike(path, F.lit(r"/(page|stranica|str|p)/[0-9]{2,}/?$")) | F.exists(names, lambda k: k.isin("sort", "order", "filter")) | F.coalesce(F.nullif(number, F.lit("")).cast("decimal(38,0)") > 2, F.lit(False))


def crawl_plan(found: DataFrame, budget: int) -> DataFrame:
    """``found``: url, source, depth, ord. One row per page key: url, source, depth, priority, result.

    The strongest evidence for a key counts; a page that is the ancestor of two or more others is a
    hub. The ``budget`` first in order are PLANNED; each other one is BUDGET_EXHAUSTED, none is lost.
    """
    base = F.lit(0)
    for source, priority in SOURCE_PRIORITY.items():
        base = F.when(F.col("source") == source, priority).otherwise(base)
    rows = found.where(should_crawl(F.col("url"))).withColumn("key", page_key(F.col("url")))
    rows = rows.withColumn("priority", base + 10 * F.col("depth") + F.when(low_value(F.col("url")), LOW_VALUE_PRIORITY).otherwise(0))
    best = rows.groupBy("key").agg(F.min_by(F.struct("url", "source", "depth"), F.struct("priority", "ord")).alias("page"), F.min("priority").alias("priority"), F.min("ord").alias("ord")).select("key", "page.*", "priority", "ord")
    parts = F.split("key", "/")
    ancestors = F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    hubs = best.where(F.size(parts) > 2).select(F.explode(ancestors).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("below")).where("below >= 2")
    best = best.join(hubs, "key", "left").withColumn("priority", F.when(F.col("below").isNotNull(), F.least("priority", F.lit(INDEX_PRIORITY) + F.col("depth"))).otherwise(F.col("priority")))
    planned = best.select("key", "priority", "ord").orderBy("priority", "ord").limit(budget).select("key", F.lit("PLANNED").alias("planned"))  # the budget bounds it
    return best.join(planned, "key", "left").select("key", "url", "source", "depth", "priority", F.coalesce("planned", F.lit("BUDGET_EXHAUSTED")).alias("result"))


def tag_text(html: Column, tag: str) -> Column:
    """Text of the first element of a kind, mark-up removed; empty where there is none."""
    return one_space(F.regexp_replace(F.regexp_extract(html, f"(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>", 1), "<[^>]*>", ""))


def links(pages: DataFrame) -> DataFrame:
    """page_id, ord, href, text of every anchor."""
    anchors = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r'(?is)<a\s[^>]*href="[^"]*"[^>]*>.*?</a>'), 0)
    rows = pages.select("page_id", F.posexplode(anchors).alias("ord", "a"))
    return rows.select("page_id", "ord", F.regexp_extract("a", r'(?i)href="([^"]*)"', 1).alias("href"), one_space(F.regexp_replace("a", "<[^>]*>", "")).alias("text"))


def absolute(href: Column, base: Column) -> Column:
    """An href against its page's URL, for plain forms; dot segments are not resolved."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"^([^?#]*)", 1), "[^/]*$", "")
    return F.when(F.rlike(href, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")), href).when(F.startswith(href, F.lit("//")), F.concat(F.substring_index(base, "//", 1), href)).when(F.startswith(href, F.lit("/")), F.concat(root, href)).otherwise(F.concat(folder, href))


def link_class(href: Column, known: Column) -> Column:
    """Class of a link; ``known`` says whether an internal one leads to a page that answers (null: unknown)."""
    h = F.trim(F.coalesce(href, F.lit("")))
    return (
        F.when(h == "", "EMPTY").when(h == "#", "PLACEHOLDER").when(F.rlike(h, F.lit("(?i)^(javascript:|vbscript:|data:|file:)")), "BAD_PROTOCOL").when(F.rlike(h, F.lit("^(tel:|mailto:|sms:)")), "VALID_ACTION")
        .when(F.rlike(h, F.lit("^(https?:)?//")), "EXTERNAL").when(F.startswith(h, F.lit("/#")), "VALID_HOME_ANCHOR").when(F.startswith(h, F.lit("#")), "ANCHOR").when(known, "VALID_INTERNAL").when(~known, "BROKEN").otherwise("UNKNOWN")
    )


def signals(pages: DataFrame) -> DataFrame:
    """Counts and years that scoring looks at, from one pass over the html."""
    html = F.coalesce(F.col("html"), F.lit(""))
    n = lambda pattern: F.regexp_count(html, F.lit(pattern)).cast("long")
    years = F.transform(F.regexp_extract_all(F.regexp_replace(html, "<[^>]*>", " "), F.lit(r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)"), 1), lambda y: y.cast("int"))
    return pages.select(
        "page_id", "url",
        tag_text(html, "title").alias("title"),
        tag_text(html, "h1").alias("h1"),
        F.regexp_extract(html, r'(?i)<html[^>]*\slang="([^"]*)"', 1).alias("lang"),
        n(r"(?i)<form[\s>]").alias("n_forms"), n(r"(?i)<button[\s>]").alias("n_buttons"), n(r"(?i)<a\s").alias("n_links"), n(r"(?i)<img[\s>]").alias("n_images"),
        n(r'(?i)href="tel:').alias("n_tel"), n(r'(?i)href="mailto:').alias("n_mailto"),
        F.array_max(years).alias("latest_year"),
        F.rlike(html, F.lit(r'(?i)href="[^"]*(news|blog)')).alias("has_news"),
    )


def documents(pages: DataFrame) -> DataFrame:
    """A page's own fields: title, description, h1, paragraphs, headings, list items, OpenGraph, JSON-LD."""
    html = F.coalesce(F.col("html"), F.lit(""))
    texts = lambda pattern: F.filter(F.transform(F.regexp_extract_all(html, F.lit(pattern), 1), lambda x: one_space(F.regexp_replace(x, "<[^>]*>", ""))), lambda x: x != "")
    graph = F.regexp_extract_all(html, F.lit(r'(?i)<meta\s+property="og:([^"]+)"\s+content="[^"]*"'), 1), F.regexp_extract_all(html, F.lit(r'(?i)<meta\s+property="og:[^"]+"\s+content="([^"]*)"'), 1)
    entries = F.transform(F.arrays_zip(graph[0].alias("k"), graph[1].alias("v")), lambda e: F.struct(e["k"], e["v"]))
    first = F.filter(entries, lambda e, i: F.array_position(graph[0], e["k"]) == i + 1)
    return pages.select(
        "page_id", "url",
        tag_text(html, "title").alias("title"),
        tag_text(html, "h1").alias("h1"),
        F.regexp_extract(html, r'(?i)<meta\s+name="description"\s+content="([^"]*)"', 1).alias("meta_description"),
        texts(r"(?is)<p(?:\s[^>]*)?>(.*?)(?:</p>|<p[\s>]|\z)").alias("paragraphs"),
        texts(r"(?is)<h[2-6](?:\s[^>]*)?>(.*?)</h[2-6]>").alias("headings"),
        texts(r"(?is)<li(?:\s[^>]*)?>(.*?)</li>").alias("items"),
        F.map_from_entries(first).alias("open_graph"),
        F.transform(F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), 1), lambda j: F.lower(F.regexp_extract(j, r'"@type"\s*:\s*"([^"]+)"', 1))).alias("structured_types"),
    )


def classify(docs: DataFrame) -> DataFrame:
    """page_id, page_type, points, confidence, band: additive signals, the highest type wins, the first on ties.

    ``docs``: page_id, url, title, h1, meta_description.
    """
    path = F.lower(path_of(F.col("url")))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    heading = F.lower(F.concat_ws(" ", "title", "h1", "meta_description"))
    found = [F.struct(F.lit("HOME").alias("page_type"), F.when(F.size(segments) == 0, 20).otherwise(0).alias("points"), F.lit(0).alias("ord"))]
    for i, (kind, words, in_path, in_heading, detail) in enumerate(PAGE_TYPES, 1):
        deep = F.size(segments) >= 2
        hit = F.rlike(path, F.lit(f"/[^/]*({words})"))
        bonus = F.when(deep, 10).otherwise(0) + F.when(F.rlike(F.lower(F.concat_ws(" ", "h1", "title")), F.lit(words)), 8).otherwise(0)
        found.append(F.struct(F.when(deep, detail).otherwise(kind).alias("page_type"), F.when(hit, in_path + bonus).otherwise(0).alias("points"), F.lit(2 * i).alias("ord")))
        found.append(F.struct(F.lit(kind).alias("page_type"), F.when(F.rlike(heading, F.lit(words)), in_heading).otherwise(0).alias("points"), F.lit(100 + i).alias("ord")))
    # All signals of a page are in its row: the greatest of them is found there, with no shuffle.
    ranked = [F.struct(f["points"].alias("points"), (-f["ord"]).alias("ord"), f["page_type"].alias("page_type")) for f in found]
    best = docs.select("page_id", F.array_max(F.array(*ranked)).alias("b")).select("page_id", "b.page_type", "b.points")
    confidence = F.when(F.col("points") == 0, 0.3).otherwise(F.least(F.lit(0.98), 0.5 + F.col("points") / 40))
    best = best.withColumn("page_type", F.when(F.col("points") == 0, "OTHER").otherwise(F.col("page_type"))).withColumn("confidence", confidence)
    return best.withColumn("band", confidence_band(F.col("confidence")))


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "HIGH").when(confidence >= 0.6, "MEDIUM").when(confidence > 0.3, "LOW").otherwise("UNKNOWN")


def backlinks(pages: DataFrame, chrome_pages: int = 3) -> DataFrame:
    """target_id, source_id, n_links: pages of one site that link to each other, by page key.

    A link list that ``chrome_pages`` pages or more share is chrome, not evidence, and drops out.
    """
    found = links(pages)
    lists = found.groupBy("page_id").agg(F.array_sort(F.collect_set("href")).alias("hrefs")).withColumn("signature", F.sha2(F.to_json("hrefs"), 256))
    common = lists.groupBy("signature").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= chrome_pages)
    content = found.join(lists.join(common, "signature", "left_anti").select("page_id"), "page_id")
    keyed = pages.select(F.col("page_id").alias("target_id"), page_key(F.col("url")).alias("key"))
    sources = content.join(pages.select("page_id", "url"), "page_id").select(F.col("page_id").alias("source_id"), page_key(absolute(F.col("href"), F.col("url"))).alias("key"))
    return sources.join(keyed, "key").where("source_id <> target_id").groupBy("target_id", "source_id").agg(F.count(F.lit(1)).alias("n_links"))


def inherit_from_pagination(pages: DataFrame, types: DataFrame) -> DataFrame:
    """Types (page_id, page_type) where a page like ``.../page/N`` takes its parent's."""
    rows = pages.select("page_id", page_key(F.col("url")).alias("key")).join(types, "page_id")
    rows = rows.withColumn("parent", F.when(F.rlike("key", F.lit("/page/[0-9]+$")), F.regexp_replace("key", "/page/[0-9]+$", "")))
    parent = rows.groupBy(F.col("key").alias("parent")).agg(F.min_by("page_type", "page_id").alias("parent_type"))
    return rows.join(parent, "parent", "left").select("page_id", F.coalesce("parent_type", "page_type").alias("page_type"))


def homepage(candidates: DataFrame) -> DataFrame:
    """One page per site: points summed by page, the crawled one first on ties. Columns: site, url, points, crawled."""
    total = candidates.groupBy("site", "url").agg(F.sum("points").alias("points"), F.bool_or("crawled").alias("crawled"))
    order = Window.partitionBy("site").orderBy(F.desc("points"), F.desc("crawled"), "url")
    return total.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
