"""The first lines of an entity: which paragraph of its page introduces it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadmill.functions.compat import bound, one_space, yes
from leadmill.functions.texts import technical_payload

# How calls to act begin and what they speak of.
IMPERATIVE = r"(?iu)^(закажите|заказать|оставьте|оставить|получите|получить|свяжитесь|обсудите|обсудим|позвоните|напишите|запишитесь|рассчитайте|отправьте|оформите|уточните)(?![а-яёa-z])"
OTHER_IMPERATIVE = r"^[а-яa-zё]+ите(?![а-яёa-z0-9])"
CALLS = r"(?iu)консультац|заявк|закажите|заказать|обсудим"
CONTACT_LINE = r"^\+?[0-9\s()\-]{6,}$|^[A-Za-z0-9_.]+@[A-Za-z0-9_.]+\.[A-Za-z0-9_]+$"
LEAST, BETTER, MOST = 40, 45, 280


def residue(line: Column, tokens: Column) -> Column:
    """What is left of a line, lower-cased, without the page's frame tokens, one after the other, and without phones."""
    left = F.aggregate(tokens, F.lower(line), lambda acc, t: F.when(t == "", acc).otherwise(F.replace(acc, t, F.lit(" "))))
    return one_space(F.regexp_replace(left, r"\+?[0-9\s()\-]{6,}", " "))


def content_lines(text: Column, tokens: Column, machine_text: bool = False) -> Column:
    """The lines of a text that are not of the frame: three characters or more are left of them, and they are neither a
    contact nor, unless that is wanted, machine text."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    own = lambda x: (F.length(residue(x, tokens)) >= 3) & ~F.rlike(F.lower(x), F.lit(CONTACT_LINE))
    return F.filter(lines, own if machine_text else lambda x: own(x) & ~technical_payload(x)["technical"])


def call_to_act(text: Column) -> Column:
    return F.rlike(text, F.lit(IMPERATIVE)) | ((F.length(text) < 120) & F.rlike(text, F.lit(CALLS)))


def clipped(text: Column, most: int = MOST) -> Column:
    """At most ``most`` characters, cut before the last word that does not fit, with "…" behind."""
    return F.when(F.length(text) > most, F.concat(F.regexp_replace(F.substring(text, 1, most), r"\s+\S*$", ""), F.lit("…"))).otherwise(text)


def lede(paragraphs: Column, title: Column, headings: Column) -> Column:
    """The first paragraph of LEAST characters that ends a sentence; else the first of BETTER, else any, else a heading as
    long as a sentence. Titles, headings and calls to act are none. Null where nothing fits."""
    plain = lambda t: F.lower(one_space(F.coalesce(t, F.lit(""))))
    own = F.array_union(F.array(plain(title)), F.transform(headings, plain))
    fit = F.filter(F.transform(paragraphs, lambda p: F.trim(p)), lambda t: yes((F.length(t) >= LEAST) & ~F.array_contains(own, F.lower(t)) & ~F.rlike(t, F.lit(IMPERATIVE)) & ~F.rlike(F.lower(t), F.lit(OTHER_IMPERATIVE))))
    subtitles = F.filter(F.transform(headings, one_space), lambda h: yes((F.length(h) >= LEAST) & (F.lower(h) != plain(title)) & ~call_to_act(h)))
    ended = lambda c: F.get(F.filter(c, lambda t: F.rlike(t, F.lit(r"[.!?…]$"))), 0)

    def chosen(c: Column) -> Column:
        other = clipped(F.coalesce(F.get(F.filter(c, lambda t: F.length(t) >= BETTER), 0), F.get(c, 0), F.get(subtitles, 0)))
        return F.coalesce(clipped(ended(c)), F.when(~call_to_act(other), other))

    return bound(fit, chosen)


def glued(description: Column, labels: Column) -> Column:
    """A description that holds two or more of the page's labels is its table of contents run together."""
    return F.coalesce(F.size(F.filter(F.transform(labels, lambda x: F.lower(one_space(x))), lambda x: (F.length(x) >= 6) & F.contains(F.lower(description), x))) >= 2, F.lit(False))
