"""Short texts of cards, titles, brands and sections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadmill.functions.compat import bound, one_space

# What a card's summary must not hold, words of section headings, marks of internal names.
JUNK = r"(?iu)запросить|оставьте заявку|позвоните|звоните|закажите|заказать|записаться|получить консультац|узнать (цену|стоимость)|подробнее|читать далее|порядок выполнения|наши контакты|все права|последние (выполненные |реализованные )?(работы|проекты)|другие (проекты|работы)|cookie|карта сайта|политика конфиденциальности|✔|➔|✓|тариф|menu|меню|наверх|call us|order now|read more"
TAIL = r"(?iu)(получить консультац\S*|заказать|закажите|узнать (цену|стоимость)|оставить заявку|подробнее|читать далее|✔|➔|✓|тариф\s*«[^»]*»).*$"
PHONE = r"\+?\d[\d\s()\-]{6,}"
SECTION_KINDS = (
    ("FAQ", "вопрос|часто спрашивают|faq|q&a"),
    ("REVIEWS", "отзыв|review|testimonial"),
    ("PRICING", "цен|прайс|стоимост|тариф|price|pricing|cost"),
    ("PROCESS", "этап|как мы работаем|порядок|процесс|стадии|process|how we work"),
    ("TEAM", "команда|сотрудник|team"),
    ("PARTNERS", "партнер|partner|клиенты"),
    ("ADVANTAGES", "преимуществ|почему мы|advantage|benefit|наши плюсы"),
    ("PROMOTION", "акци|скидк|promo|promotion|спецпредлож"),
)
STATS = r"(?iu)([₽$€Br%]|\d+\s*\+?\s*(м2|м²|лет|год|проект|домов|объект|опыт))"
PRICE = r"(?iu)(руб|₽|\$|€|br(?![A-Za-z0-9_])|р\.)"
GENERIC = r"(?iu)^\s*(home|about(?:\s+us)?|contacts?|services?|projects?|news|careers?|vacancies?|главная|о компании|о нас|контакты|услуги|проекты|новости|вакансии|о-нас|о-компании)\s*$"
INTERNAL = r"(?i)(^|[^A-Za-z0-9_])(clean\s*room|qa\s*build|test\s*site|fixture|regen(?:erat[A-Za-z0-9_]*)?|generated\s*site|demo\s*site|smoke\s*test|e2e[-\s]?test|sandbox)($|[^A-Za-z0-9_])"


def shortened(text: Column, most: int) -> Column:
    """At most ``most`` characters, cut behind a sentence or a word that ends beyond the 30th, with "…" behind."""
    raw = one_space(F.coalesce(text, F.lit("")))
    head = F.substring(raw, 1, max(0, most - 1))
    # Places count from 0; -1 where there is none.
    last = lambda mark: F.length(head) - F.instr(F.reverse(head), mark[::-1]) - len(mark) + 1
    found = lambda mark: F.when(F.contains(head, F.lit(mark)), last(mark)).otherwise(-1)
    sentence, word = F.greatest(*(found(m) for m in (". ", "! ", "? "))), found(" ")
    cut = F.greatest(F.when(sentence > 30, sentence + 1).otherwise(-1), F.when(word > 30, word).otherwise(-1))
    return F.when(F.length(raw) <= most, raw).otherwise(F.concat(F.rtrim(F.when(cut > 0, F.substr(head, F.lit(1), cut)).otherwise(head)), F.lit("…")))


def summary_repeated(summary: Column, body: Column) -> Column:
    """A summary (12 characters or more) that the first block holds, or that holds it."""
    s, b = (F.lower(one_space(F.coalesce(x, F.lit("")))) for x in (summary, body))
    return (F.length(s) >= 12) & (F.length(b) >= 12) & (F.contains(b, s) | F.contains(s, b))


def plain_title(title: Column) -> Column:
    """Lower-cased, ё as е, without quotes, with single spaces."""
    return one_space(F.regexp_replace(F.replace(F.lower(F.coalesce(title, F.lit(""))), F.lit("ё"), F.lit("е")), "[«»\"“”'‘’`]", ""))


def without_brand(title: Column, brand: Column) -> Column:
    """A plain title without the brand behind it and without prefixes of feeds."""
    t, b = plain_title(title), plain_title(brand)
    behind = F.length(b) >= 3
    bare = F.when(behind & F.endswith(t, b), F.substr(t, F.lit(1), F.length(t) - F.length(b)))
    stripped = F.when(F.rlike(bare, F.lit(r"[\s\-–—|]$")), F.regexp_replace(bare, r"[\s\-–—|]+$", "")).otherwise(t)
    return F.regexp_replace(stripped, r"(?iu)^(от\s+\S+\s+|жк\s+\S+\s+|тренды\s+)", "")


def card_summary(raw: Column, title: Column) -> Column:
    """Two clean sentences at most, 200 characters; null if fewer than 20 are left."""
    cut = F.split(F.regexp_replace(F.coalesce(raw, F.lit("")), r"([.!?])\s+", "$1\n"), "\n+")
    whole = plain_title(title)
    clean = lambda s: (F.length(s) >= 12) & ~F.rlike(s, F.lit(JUNK)) & ~F.rlike(s, F.lit(PHONE)) & ~F.contains(plain_title(s), whole) & ~F.rlike(s, F.lit(r"^\d+\s*[.)]"))
    taken = lambda held, s: bound(F.trim(F.regexp_replace(F.trim(s), TAIL, "")), lambda c: F.when(clean(c), F.concat(held, F.array(c))).otherwise(held))
    # What stands behind the second clean sentence is not looked at.
    out = F.array_join(F.aggregate(cut, F.array().cast("array<string>"), lambda held, s: F.when(F.size(held) >= 2, held).otherwise(taken(held, s))), " ")
    return F.when(F.length(out) >= 20, F.substring(out, 1, 200))


def section_kind(heading: Column, titles: Column, prices: Column, rated: Column) -> Column:
    """Kind of a section: by its heading, else by the shape of its items."""
    out = None
    for kind, pattern in SECTION_KINDS:
        test = F.rlike(F.coalesce(heading, F.lit("")), F.lit(f"(?iu){pattern}"))
        out = F.when(test, kind) if out is None else out.when(test, kind)
    texts = F.filter(F.transform(titles, lambda t: F.trim(F.coalesce(t, F.lit("")))), lambda t: t != "")
    n = F.size(texts)
    asked = F.size(F.filter(texts, lambda t: F.endswith(t, F.lit("?"))))
    told = F.size(F.filter(texts, lambda t: F.rlike(t, F.lit(r"\d")) & (F.rlike(t, F.lit(STATS)) | F.rlike(t, F.lit(r"^\d+\s*\+$")))))
    priced = F.size(F.filter(prices, lambda p: F.rlike(F.coalesce(p, F.lit("")), F.lit(PRICE))))
    return out.when((n >= 2) & (asked >= F.ceil(n / 2)), "FAQ").when((n >= 2) & (told >= n / 2), "STATS").when(rated, "REVIEWS").when((F.size(prices) >= 2) & (priced >= F.size(prices) / 2), "PRICING").otherwise("OTHER")


def generic_name(name: Column) -> Column:
    return F.coalesce((F.length(name) < 2) | F.rlike(name, F.lit(GENERIC)), F.lit(True))


def name_like(name: Column) -> Column:
    t = F.trim(name)
    return F.coalesce(F.length(t).between(2, 48) & ~F.rlike(t, F.lit(r"[.!?…]")) & (F.size(F.split(t, r"\s+")) <= 5), F.lit(False))


def public_brand(lead: Column, extracted: Column, branding: Column, domain: Column, site: Column) -> Column:
    """struct(name, source): the first usable of the lead's name, the extracted one, the lead's without internal marks,
    the branding's, the domain's first label, the site's."""
    lead, extracted, branding = F.trim(lead), F.trim(extracted), F.trim(branding)
    internal = lambda x: F.coalesce(F.rlike(x, F.lit(INTERNAL)), F.lit(False))
    usable = lambda x: name_like(x) & ~generic_name(x) & ~internal(x)
    stripped = one_space(F.regexp_replace(F.regexp_replace(lead, INTERNAL, "$1 $3"), r"\s*[-–—_|/]\s*", " "))
    label = F.substring_index(F.regexp_replace(F.trim(F.coalesce(domain, F.lit(""))), r"^www\.", ""), ".", 1)
    out = lambda name, source: F.struct(name.alias("name"), F.lit(source).alias("source"))
    named = F.concat(F.upper(F.substring(label, 1, 1)), F.substr(label, F.lit(2)))
    return (
        F.when(F.coalesce(lead != "", F.lit(False)) & ~generic_name(lead) & ~internal(lead), out(lead, "lead"))
        .when(usable(extracted), out(extracted, "extracted"))
        .when(name_like(stripped) & ~generic_name(stripped), out(stripped, "lead-stripped"))
        .when(usable(branding), out(branding, "branding"))
        .when(label != "", out(named, "domain"))
        .otherwise(out(F.coalesce(site, F.lit("")), "fallback"))
    )
