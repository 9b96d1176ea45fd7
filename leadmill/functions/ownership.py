"""Who owns a web site: a company itself, or a directory or market place that lists it; and what kind of page one is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadmill.functions import urls
from leadmill.functions.compat import bound

# Known hosts, patterns of paths and texts with their weights, and keywords of page kinds in their order.
KNOWN = (("gmc.by", "AGGREGATOR"), ("deal.by", "MARKETPLACE"), ("rubrikator.by", "DIRECTORY"), ("minsk-city.by", "DIRECTORY"))
PATHS = (
    ("url:company-listing-pattern", r"(?i)/(companies|company|firms?|org|orgs|organizations|place|places|catalog-companies|spravochnik|katalog-kompanij)/[\w-]+"),
    ("url:numbered-company-page", r"(?i)/\d{3,}-[\w-]+\.(html?|php)$"),
    ("url:seller-storefront", r"(?i)/cs/\d+/"),
    ("url:tag-directory", r"(?i)/(tag|tags|rubric|rubrics|category-directory|razdel)/[\w-]+"),
)
TEXTS = (
    ("text:add-company-flow", 3, r"добавить\s+(компанию|организацию|фирму|предприятие)"),
    ("text:add-product-service-flow", 2, r"добавить\s+(товар|услугу|объявление|продукцию)"),
    ("text:company-catalog", 3, r"каталог\s+(компаний|организаций|предприятий|фирм)"),
    ("text:org-directory", 3, r"справочник\s+(организаций|предприятий|компаний)"),
    ("text:business-registration-flow", 3, r"(разместить|зарегистрировать)\s+(компанию|организацию|свою фирму)"),
    ("text:directory-search", 2, r"(все|поиск)\s+(компании|организации|поставщики|продавцы)\s+(в|по)\s+(рубрик|категор|город)"),
    ("text:free-listing-offer", 2, r"бесплатн[0-9A-Za-z_]*\s+(размещени|добавлени)[0-9A-Za-z_]*"),
    ("text:en-directory", 3, r"organizations?\s+catalog|business\s+directory|add\s+(your\s+)?(company|business|listing)"),
    ("text:seller-attribution", 2, r"(поставщик|продавец|компания|организация|смотреть все (товары|услуги) (компании|продавца))\s*[::]"),
)
ORG_FORMS = r"оао|ооо|зао|ип\s|чтуп|уп\s|llc|ltd"
PAGE_KINDS = (
    ("vacancies", ("vacancies", "vacancy", "career", "careers", "job", "jobs", "вакансии", "вакансия", "rabota", "работа", "vakansii")),
    ("contacts", ("contact", "contacts", "контакты", "контакт", "kontakty", "kontakt")),
    ("about", ("about", "about-us", "о компании", "о нас", "о предприятии", "o-kompanii", "o-nas")),
    ("news", ("news", "blog", "press", "новости", "новость", "novosti", "novost")),
    ("service", ("service", "услуга", "usluga", "прайс", "preiskurant")),
    ("services", ("services", "catalog", "all-services", "услуги", "каталог", "каталог услуг", "uslugi")),
    ("project", ("project", "portfolio", "object", "objects", "проект", "проекты", "объект", "объекты", "портфолио", "proekty", "obekty")),
)
_MARKET = ("url:seller-storefront", "text:seller-attribution")


def ownership(url: Column, text: Column) -> Column:
    """struct(decision, confidence, signals): a known host settles it, else the weight of what path and text show.

    A weight of 4 or more is a directory (a market place if sellers show), 2 or more uncertain, and a listing-like
    path alone uncertain too; what is left is the company's own site.
    """
    parts = urls.canonical(url)
    where = bound(parts, lambda p: F.struct(F.coalesce(p["domain"], p["host"]).alias("host"), F.coalesce(F.regexp_extract(F.coalesce(p["url"], url), r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), F.lit("")).alias("path")))
    return bound(where, lambda w: bound(_hits(w["path"], F.coalesce(text, F.lit(""))), lambda h: bound(_weighed(h), lambda s: _decided(w["host"], s["names"], s["weight"]))))


def _hits(path: Column, text: Column) -> Column:
    """array of struct(name, weight): the signals that show, each pattern tried once."""
    hit = lambda name, weight, found: F.when(found, F.struct(F.lit(name).alias("name"), F.lit(weight).alias("weight")))
    forms = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"(?iu)({ORG_FORMS})"), 1), F.lower))
    return F.array_compact(F.array(
        *(hit(name, 1, F.rlike(path, F.lit(pattern))) for name, pattern in PATHS),
        *(hit(name, weight, F.rlike(text, F.lit(f"(?iu){pattern}"))) for name, weight, pattern in TEXTS),
        hit("text:many-distinct-org-forms", 1, F.size(forms) >= 4),
    ))


def _weighed(hits: Column) -> Column:
    return F.struct(F.transform(hits, lambda h: h["name"]).alias("names"), F.aggregate(hits, F.lit(0), lambda acc, h: acc + h["weight"]).alias("weight"))


def _decided(host: Column, names: Column, weight: Column) -> Column:
    out = lambda decision, confidence, signals: F.struct(decision.alias("decision"), confidence.cast("double").alias("confidence"), signals.alias("signals"))
    known = None
    for domain, decision in KNOWN:
        test = (host == domain) | F.endswith(host, F.lit(f".{domain}"))
        rule = out(F.lit(decision), F.lit(0.98), F.array(F.lit(f"policy:{domain}")))
        known = F.when(test, rule) if known is None else known.when(test, rule)
    return (
        known.when(weight >= 4, out(F.when(F.arrays_overlap(names, F.array(*map(F.lit, _MARKET))), "MARKETPLACE").otherwise("DIRECTORY"), F.least(F.lit(0.9), 0.5 + weight * 0.08), names))
        .when(weight >= 2, out(F.lit("UNCERTAIN"), F.lit(0.4), names))
        .when(F.exists(names, lambda n: F.startswith(n, F.lit("url:"))), out(F.lit("UNCERTAIN"), F.lit(0.35), names))
        .otherwise(out(F.lit("DIRECT_COMPANY_SITE"), F.when(host.isNotNull(), 0.8).otherwise(0.5), names))
    )


def page_kind(url: Column, title: Column, h1: Column, home: Column) -> Column:
    """The first kind with a keyword in the address or the titles; ``home`` says that it is the start page."""
    address = F.lower(F.coalesce(F.try_url_decode(url), url, F.lit("")))
    titles = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(h1, F.lit(""))))
    out = F.when(home, "home")
    for kind, words in PAGE_KINDS:
        held = [F.contains(x, F.lit(w)) for w in words for x in (address, titles)]
        test = held[0]
        for one in held[1:]:
            test = test | one
        out = out.when(test, kind)
    return out.otherwise("page")
