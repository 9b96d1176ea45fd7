"""Text for HTML and scripts, outside HTML as data, stable hashes, colours and the roles of images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadmill.functions.compat import round_half_up, yes

# Marks of advertisements, tools and languages, domains of advertisers.
AD_DOMAINS = r"(?iu)(adform|doubleclick|googleads|googlesyndication|adsystem|amazon-adsystem|yandex\.ru/ads|mc\.yandex\.ru|adservice|evocontrols\.com|adfox|banners|banner|реклама|adriver|adnxs|openx|pubmatic|rubicon)"
AD_MARKS = ("реклама", "advertisement", "ad", "ads", "banner", "promo", "promotion", "sponsored", "рекламный", "баннер", "publicidad", "publicité", "werbung", "anzeige")
TOOL_MARKS = ("translate", "translation", "language", "flag", "search", "cart", "basket", "checkout", "login", "account", "profile", "user", "social", "share", "menu", "hamburger", "close", "expand", "dropdown", "scroll", "back", "arrow", "icon", "svg", "sprite", "widget")
LANGUAGES = ("ru", "by", "en", "de", "pl", "ua", "kz", "uz", "az", "рос", "бел", "eng", "deu", "рус", "беларуская", "english", "deutsch", "polski", "українська", "o'zbek", "français", "español", "italiano")
DEFAULT_COLOUR = "#2563EB"


def word(words: tuple[str, ...]) -> str:
    """A pattern for any of some words that stands alone."""
    return r"(?iu)(^|[^\p{L}\p{N}_])(" + "|".join(words) + r")($|[^\p{L}\p{N}_])"


def escaped(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def script_json(value: Column) -> Column:
    """JSON that cannot close the script element around it."""
    return F.replace(F.to_json(value), F.lit("<"), F.lit("\\u003c"))


def as_data(html: Column) -> Column:
    """Outside HTML without scripts, styles, comments and handlers."""
    out = html
    for pattern, by in ((r"(?is)<script\b[^>]*>.*?</script\s*>", ""), (r"(?is)<style\b[^>]*>.*?</style\s*>", ""), (r"(?s)<!--.*?-->", ""), (r"(?i)on\w+\s*=\s*[\"'][^\"']*[\"']", ""), (r"(?i)javascript:", "blocked:")):
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def stable_hash(parts: Column) -> Column:
    """SHA-256 of an array of strings whatever their order."""
    return F.sha2(F.to_json(F.array_sort(F.array_distinct(parts))), 256)


def colour(text: Column) -> Column:
    """struct(r, g, b) of #rgb, #rrggbb or rgb(...); null if it is none."""
    part = lambda x: F.conv(x, 16, 10).cast("int")
    short, long = F.regexp_extract(text, "^#([0-9a-fA-F]{3})$", 1), F.regexp_extract(text, "^#([0-9a-fA-F]{6})$", 1)
    rgb = [F.regexp_extract(text, r"(?i)rgba?\s*\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)", i) for i in (1, 2, 3)]
    made = lambda r, g, b: F.struct(r.alias("r"), g.alias("g"), b.alias("b"))
    return (
        F.when(short != "", made(*(part(F.repeat(F.substring(short, i, 1), 2)) for i in (1, 2, 3))))
        .when(long != "", made(*(part(F.substring(long, i, 2)) for i in (1, 3, 5))))
        .when(rgb[0] != "", made(*(x.cast("int") for x in rgb)))
    )


def plain_label(text: Column) -> Column:
    """Lower-cased, with white space, hyphens and underscores as single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\s\x{00A0}\-_]+", " "))


def neutral(c: Column) -> Column:
    low, high = F.least(c["r"], c["g"], c["b"]), F.greatest(c["r"], c["g"], c["b"])
    return (high - low < 30) | (low > 240) | (high < 40)


def as_hex(c: Column, share: float = 1.0) -> Column:
    """#rrggbb of a colour whose parts are multiplied by ``share``."""
    part = lambda x: F.lower(F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), round_half_up(x * F.lit(share)))).cast("long")), 2, "0"))
    return F.concat(F.lit("#"), part(c["r"]), part(c["g"]), part(c["b"]))


def theme(marks: Column, html: Column) -> Column:
    """struct(primary, secondary, source): the first colour of the marks that is not neutral, else of the page's text."""
    first = lambda colours: F.get(F.filter(F.transform(colours, colour), lambda c: c.isNotNull() & ~neutral(c)), 0)
    extracted = first(F.array_compact(marks))
    inferred = first(F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit("(#([0-9a-fA-F]{6}|[0-9a-fA-F]{3}))"), 1)))
    default = colour(F.lit(DEFAULT_COLOUR))
    c = F.coalesce(extracted, inferred, default)
    source = F.when(extracted.isNotNull(), "extracted").when(inferred.isNotNull(), "inferred").otherwise("default")
    return F.struct(F.when(source == "default", F.lit(DEFAULT_COLOUR)).otherwise(as_hex(c)).alias("primary"), as_hex(c, 0.8).alias("secondary"), source.alias("source"))


def image_role(src: Column, alt: Column, selector: Column, width: Column, height: Column, is_logo: Column, is_hero: Column, section_order: Column) -> Column:
    """struct(role, confidence): the first rule that fits. Words are sought in the alternative text, lower-cased and
    with hyphens and underscores as spaces, and in the image's own classes (``selector``) only."""
    alt, selector = plain_label(alt), F.lower(F.coalesce(selector, F.lit("")))
    w, h = F.coalesce(width, F.lit(0)), F.coalesce(height, F.lit(0))
    label = F.concat_ws(" ", alt, selector)
    has = lambda x, pattern: F.rlike(x, F.lit(pattern))
    out = lambda role, confidence: F.struct(F.lit(role).alias("role"), F.lit(confidence).alias("confidence"))
    small = (w > 0) & (h > 0) & (w <= 200) & (h <= 200)
    inside = section_order.isNotNull()
    return (
        F.when(has(label, word(AD_MARKS)) | has(F.coalesce(src, F.lit("")), AD_DOMAINS), out("ADVERTISEMENT", 0.85))
        .when(has(label, word(TOOL_MARKS)) & ((w < 64) | (h < 64)), out("UTILITY_ICON", 0.85))
        .when(has(label, word(LANGUAGES)) | has(selector, "lang|language|translate|flag|gtranslate|weglot|wpml"), out("LANGUAGE_ICON", 0.88))
        .when(yes(is_logo) | has(label, "logo|brand|логотип|лого"), out("LOGO", 0.85))
        .when(small & has(label, "icon|logo|лого|thumb|avatar|removebg|cropped"), out("UTILITY_ICON", 0.7))
        .when(yes(is_hero) | (yes(section_order == 0) & (w > 600) & (h > 300)), out("HERO_CANDIDATE", 0.7))
        .when(inside & has(label, "service"), out("SERVICE_IMAGE", 0.6))
        .when(inside & has(label, "project|portfolio"), out("PROJECT_IMAGE", 0.6))
        .when(inside & has(label, "news|article"), out("ARTICLE_IMAGE", 0.6))
        .otherwise(out("UNKNOWN", 0.35))
    )
