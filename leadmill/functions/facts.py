"""Fact candidates and their gate: each type has an ordered cascade that gives a value or a reason.

Word edges are written out, because runtimes disagree about them beside Cyrillic letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.functions.compat import bound, once, one_space, yes

# Contexts and forms that the cascades look for.
YEAR_RANGE = r"(?<![\p{L}\p{N}])(18|19|20)[0-9]{2}\s*[-–—/]\s*(?:(18|19|20)[0-9]{2}|[0-9]{2})(?![\p{L}\p{N}])"
REGISTRATION = r"(?iu)(унп|инн|учнп|регистрац|рег\.?\s*№|рег\.?\s*номер|registration|tax\s*id|tax\s*number|vat|идентификац)"
BANK = r"(?iu)(iban|bic|swift|р/с|расч[её]тный|сч[её]т|account|банк|банковск|корр\.?\s*сч)"
EMPLOYEES = r"(?iu)(сотрудник|работник|человек|персонал|persone|mitarbeiter|employee|staff|team\s*member|dipendente|collaborator)"
DAYS = r"(?iu)(пн|вт|ср|чт|пт|сб|вс|понедельник|вторник|среда|четверг|пятница|суббота|воскресенье|mon|tue|wed|thu|fri|sat|sun)"
TIME_LIKE = r"(?iu)[0-9]{1,2}[:.][0-9]{2}|[0-9]{1,2}[-–—][0-9]{2}\s*(до|[-–—])\s*[0-9]{1,2}[-–—][0-9]{2}"
TIME = r"(?<![A-Za-z0-9_])[0-9]{1,2}[:.][0-9]{2}(?![A-Za-z0-9_])"
OPENING = r"(?iu)([0-9]{1,2}[:.][0-9]{2}\s*[-–—]\s*[0-9]{1,2}[:.][0-9]{2})|((пн|вт|ср|чт|пт|сб|вс|mon|tue|wed|thu|fri|sat|sun)[-.,]?\s*[0-9]{1,2}[:.-][0-9]{2})|([0-9]{1,2}[-–—.][0-9]{2}\s*до\s*[0-9]{1,2}[-–—.][0-9]{2})"
CATALOGUE = r"(?iu)(каталог|проект[ыаеу]|дома|домов|(?<=[A-Za-z0-9_])м2(?![A-Za-z0-9_])|м²|кв\.?\s*м|от\s*[0-9]+\s*до\s*[0-9]+|до\s*[0-9]+\s*м|цена|стоимость|руб|заказать|купить|услуг|portfolio|catalog|price|order|sqm|sq\.?\s*m)"
STREET = r"(?iu)(ул\.|улица|улицу|проспект|пр[-.]т|пр\.|переулок|пер\.|площадь|пл\.|бульвар|бул\.|шоссе|набережная|наб\.|проезд|пр-д|просп\.|тракт|str\.|straße|strasse|street|road|avenue|ave\.|boulevard|blvd|lane|weg|platz|gasse|via|viale|rue|calles?)"
ADDRESS_LABEL = r"(?iu)(адрес|address|находимся|расположен|located|office|офис|штаб-квартира|наш\s+офис|юридический\s+адрес|юр\.?\s*адрес)"
ABBREVIATED = r"(?iu)^(.+?)(?<!(?:ул|д|г|им|пр|пер|стр|корп|оф|пом|эт|пл|наб|б-р|мкр) ?)\. "
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
ASSET = r"(?i)\.(png|jpe?g|gif|svg|webp|css|js|woff2?|ico)$"
PLACEHOLDER_DOMAIN = r"(?i)^(example|test|email|domain|your-?mail|sample|placeholder)\.[a-z]{2,}$"


def _cascade(*steps: tuple[Column, str], value: Column) -> Column:
    reason = None
    for test, name in steps:
        reason = F.when(yes(test), name) if reason is None else reason.when(yes(test), name)
    return bound(reason, lambda r: F.struct(r.isNull().alias("ok"), F.when(r.isNull(), value).alias("value"), r.alias("reason")))


def phone(raw: Column, context: Column) -> Column:
    return bound(one_space(F.coalesce(raw, F.lit(""))), lambda value: bound(F.length(F.regexp_replace(value, "[^0-9]", "")), lambda digits: _phone(value, digits, F.coalesce(context, F.lit("")))))


def _phone(value: Column, digits: Column, context: Column) -> Column:
    labelled = F.rlike(context, F.lit(REGISTRATION))
    return _cascade(
        (value == "", "EMPTY"),
        (F.rlike(value, F.lit("[a-zA-Zа-яА-Я@]")), "CONTAINS_NON_PHONE_CHARS"),
        (F.rlike(value, F.lit(YEAR_RANGE)), "YEAR_RANGE"),
        (F.rlike(context, F.lit(BANK)) | F.rlike(value, F.lit(BANK)), "BANK_ACCOUNT"),
        (F.regexp_count(value, F.lit(r"[0-9][0-9\s()\-]{5,}[0-9]")) > 1, "CONCATENATED"),
        (digits < 7, "TOO_FEW_DIGITS"),
        (digits > 15, "TOO_MANY_DIGITS"),
        ((digits == 9) & labelled, "REGISTRATION_ID"),
        ((digits == 9) & ~F.rlike(value, F.lit("[+()]")), "AMBIGUOUS_NINE_DIGIT"),
        value=value,
    )


def email(raw: Column) -> Column:
    return bound(F.regexp_extract(F.coalesce(raw, F.lit("")), EMAIL, 0), lambda found: bound(F.regexp_replace(F.substring_index(found, "@", 1), r"^[0-9][0-9.\-_]{3,}(?=[A-Za-z])", ""), lambda rest: _email(found, rest)))


def _email(found: Column, rest: Column) -> Column:
    local, domain = F.substring_index(found, "@", 1), F.substring_index(found, "@", -1)
    return _cascade(
        (found == "", "NOT_AN_EMAIL"),
        (F.rlike(found, F.lit(ASSET)), "IMAGE_FILENAME"),
        (F.rlike(local, F.lit(r"^[0-9.\-_]+$")), "NUMERIC_LOCAL"),
        ((rest != local) & (F.length(rest) < 2), "NOISY_PREFIX"),
        (F.rlike(domain, F.lit(PLACEHOLDER_DOMAIN)), "PLACEHOLDER"),
        value=F.lower(F.concat(rest, F.lit("@"), domain)),
    )


def employees(raw: Column) -> Column:
    return bound(one_space(F.coalesce(raw, F.lit(""))), lambda value: bound(F.regexp_replace(F.regexp_extract(value, r"[0-9][0-9\s]*", 0), r"\s", ""), lambda number: _employees(value, number)))


def _employees(value: Column, number: Column) -> Column:
    n = F.try_to_number(number, F.lit("999999999999999")).cast("double")
    return _cascade((~F.rlike(value, F.lit(EMPLOYEES)), "NO_EMPLOYEE_CONTEXT"), (number == "", "NO_NUMBER"), (n == 0, "COUNTER_ZERO"), (n.isNull() | (n > 10_000_000), "IMPLAUSIBLE"), value=value)


def founding_date(raw: Column, as_of: Column) -> Column:
    value = F.trim(F.coalesce(raw, F.lit("")))
    year = F.regexp_extract(value, r"(^|[^0-9])((?:18|19|20)[0-9]{2})([^0-9]|$)", 2)
    return _cascade((F.rlike(value, F.lit(YEAR_RANGE)), "YEAR_RANGE"), (year == "", "NO_YEAR"), (F.nullif(year, F.lit("")).cast("int") > F.year(as_of) + 1, "IMPLAUSIBLE_YEAR"), value=year)


def registration_id(raw: Column, context: Column) -> Column:
    digits = F.regexp_replace(F.coalesce(raw, F.lit("")), "[^0-9]", "")
    return _cascade((F.length(digits) != 9, "NOT_NINE_DIGITS"), (~yes(F.rlike(context, F.lit(REGISTRATION))), "REGISTRATION_WITHOUT_LABEL"), value=digits)


def address(raw: Column, context: Column, source: Column) -> Column:
    """An address, cut out of text around it: behind the last colon whose tail names a street and a number, up to the
    end of its sentence. Stops behind abbreviations end no sentence."""
    context, source = F.coalesce(context, F.lit("")), F.coalesce(source, F.lit(""))
    return bound(one_space(F.coalesce(raw, F.lit(""))), lambda value: bound(F.coalesce(_tail(value), value), lambda v: _address(v, context, source)))


def _tail(value: Column) -> Column:
    """The part behind the last such colon; null without one."""
    def behind(parts: Column) -> Column:
        tails = F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda i: F.when((i > 1) | (F.get(parts, 0) != ""), F.trim(F.array_join(F.slice(parts, i + 1, F.size(parts)), ":"))))
        fit = F.get(F.filter(tails, lambda t: yes(F.rlike(t, F.lit(STREET)) & F.rlike(t, F.lit("[0-9]")))), 0)
        return bound(fit, lambda t: F.coalesce(F.nullif(F.trim(F.regexp_extract(t, ABBREVIATED, 1)), F.lit("")), t))

    return F.when(F.contains(value, F.lit(":")), bound(F.split(value, ":"), behind))


def _address(value: Column, context: Column, source: Column) -> Column:
    has = lambda text, pattern: F.rlike(text, F.lit(pattern))
    street = has(value, STREET)
    signal = has(source, "(?i)jsonld|postaladdress|schema") | has(context, ADDRESS_LABEL) | has(value, ADDRESS_LABEL) | (street & has(value, "[0-9]"))
    return _cascade(
        (F.length(value) < 10, "TOO_SHORT"),
        (F.length(value) > 160, "TOO_LONG"),
        (F.contains(value, F.lit("@")), "CONTAINS_EMAIL"),
        (has(value, OPENING) | (has(value, TIME_LIKE) & has(value, DAYS)) | (has(value, TIME) & ~street), "OPENING_HOURS"),
        (has(value, BANK), "BANK_ACCOUNT"),
        (has(value, r"[0-9][0-9\s()\-]{6,}[0-9]"), "CONTAINS_PHONE"),
        (has(value, CATALOGUE), "CATALOG_OR_SERVICE_TEXT"),
        (~signal, "NO_ADDRESS_SIGNAL"),
        value=value,
    )


def candidates(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, ord, kind (PHONE or EMAIL), raw: what looks like a contact in a text, each spelling once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    phones = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\+?[0-9][0-9 ()\-]{6,}[0-9]"), 0))
    emails = F.array_distinct(F.regexp_extract_all(text, F.lit(EMAIL), 0))
    listed = lambda found, kind: F.transform(found, lambda raw, i: F.struct(F.lit(kind).alias("kind"), i.alias("ord"), raw.alias("raw")))
    return docs.select(key, F.inline(F.concat(listed(phones, "PHONE"), listed(emails, "EMAIL"))))  # one scan for both


def gate(found: DataFrame) -> DataFrame:
    """Adds ok, value, reason to candidates (kind, raw, optional context and source)."""
    context, source = (F.col(c) if c in found.columns else F.lit("") for c in ("context", "source"))
    verdict = F.when(F.col("kind") == "PHONE", phone(F.col("raw"), context)).when(F.col("kind") == "EMAIL", email(F.col("raw"))).when(F.col("kind") == "ADDRESS", address(F.col("raw"), context, source)).when(F.col("kind") == "EMPLOYEE_COUNT", employees(F.col("raw"))).when(F.col("kind") == "REGISTRATION_ID", registration_id(F.col("raw"), context)).when(F.col("kind") == "FOUNDING_DATE", founding_date(F.col("raw"), F.current_timestamp()))
    return found.select(*found.columns, once(verdict))
