"""Kinds of lists from small pages, one rule each."""

import time

import pytest

from leadmill.functions import facts, markup, summaries
from leadmill.operators import audit, dom, relations, semantics
from pyspark.sql import functions as F


def kinds(spark, *html):
    pages = spark.createDataFrame([(i, "https://own.by/x", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    rows = semantics.collection_types(semantics.page_collections(dom.trees(pages))).collect()
    return {r["page_id"]: (r["type"], r["subtype"], round(r["confidence"], 3)) for r in rows}


def listed(*cards, cls="box", heading=""):
    return f"{heading}<div class='{cls}'>" + "".join(f"<div class=item>{c}</div>" for c in cards) + "</div>"


def test_rules_in_their_order(spark):
    link = lambda text, href: f"<a href='{href}'>{text}</a>"
    long = "<p>A description of more than twenty characters.</p>"
    got = kinds(
        spark,
        listed(link("Home", "/"), link("Contacts", "/c"), cls="top-menu-list"),
        listed(link("EN", "/en"), link("de", "/de")),
        listed(link("Dark", "/d"), link("light", "/l")),
        listed(link("One", "https://b.com/x"), link("Two", "https://b.com/x")),
        listed(link("News", "/n"), link("Products", "/p")),
        listed(link("Us", "https://vk.com/a"), link("There", "/t")),
        listed(link("Search", "/s"), link("Thing", "/t"), cls="box").replace("class=item", "class=element"),
        listed("<h3>1999</h3>" + long, "<h3>2005</h3>" + long, heading="<h2>Our history timeline</h2>").replace("class=item", "class=element"),
        listed(link("Roof", "/services/roof") + long, link("Wall", "/services/wall") + long, heading="<h2>Our services</h2>"),
        listed("<img src=a.png>Alpha", "<img src=b.png>Beta").replace("class=item", "class=element"),
        listed(link("Firm", "https://a.com/x"), link("Other", "https://b.com/y")),
        listed(link("Alpha", "/a"), link("Beta", "/b")),
        listed("<b>Alone</b>"),
    )
    assert got == {
        0: ("NAVIGATION", None, 0.92), 1: ("LANGUAGE_SWITCHER", None, 0.92), 2: ("THEME_WIDGET", None, 0.9), 3: ("ADVERTISEMENT", None, 0.9), 4: ("NAVIGATION", None, 0.9), 5: ("SOCIAL_LINKS", None, 0.9),
        6: ("UTILITY", None, 0.85), 7: ("CONTENT_COLLECTION", "OTHER", 0.65), 8: ("CONTENT_COLLECTION", "SERVICES", 0.9), 9: ("CONTENT_COLLECTION", "OTHER", 0.6), 10: ("PARTNER_LINKS", None, 0.75), 11: ("UNKNOWN", None, 0.4),
    }


@pytest.mark.parametrize(("words", "text", "found"), [(semantics.CATALOGUE, "5 $", True), (semantics.CATALOGUE, "reorder", False), (semantics.OBJECTS, "дом, жилой комплекс!", True), (semantics.NEWS, "newsletter", False), (semantics.NEWS, "NEWS", True)])
def test_words_stand_alone(spark, words, text, found):
    assert spark.range(1).select(F.rlike(F.lit(text), F.lit(semantics.alone(words)))).first()[0] is found


def test_labels_of_images_ignore_case_and_hyphens(spark):
    role = lambda alt, order=None: spark.range(1).select(markup.image_role(F.lit("/x.png"), F.lit(alt), F.lit(""), F.lit(300), F.lit(300), F.lit(False), F.lit(False), F.lit(order).cast("int"))["role"]).first()[0]
    assert [role("Logo"), role("LATEST-NEWS", 1), role("Our_Project", 2), role(None)] == ["LOGO", "ARTICLE_IMAGE", "PROJECT_IMAGE", "UNKNOWN"]


def test_a_brick_house_has_no_price(spark):
    kind = lambda *prices: spark.range(1).select(summaries.section_kind(F.lit("Houses"), F.array(F.lit("One"), F.lit("Two")), F.array(*map(F.lit, prices)), F.lit(False))).first()[0]
    assert [kind("a brick house", "bronze door"), kind("20 Br", "от 5 руб"), kind("7br", "8 BR.")] == ["OTHER", "PRICING", "PRICING"]


def test_invariants_states_and_permissions(spark):
    leads = spark.createDataFrame([(1, "BAD", "NOT_SELECTED"), (2, "GOOD", "CRAWL_READY"), (3, "UNSURE", "CRAWL_READY"), (4, "UNREVIEWED", None), (5, "BAD", None)], "id long, manual_review_status string, redesign_stage string").withColumns({c: F.lit(None).cast("string") for c in ("website_status", "audit_status", "lighthouse_status", "visual_status", "score_status")})
    active = spark.createDataFrame([(1,), (1,), (3,)], "lead_id long")
    assert {tuple(r) for r in audit.broken_invariants(leads, active).collect()} == {("bad-still-working", 1, False), ("pipeline-without-good", 1, True), ("early-reviewed", 4, True)}
    rows = spark.createDataFrame([('{"a": 1}',), ('{"a": null}',), ('{"a": []}',), ("{}",), (None,)], "j string")
    assert [tuple(r) for r in relations.key_states(rows, "j", "a").select("state", "any_present").collect()] == [("present", True), ("null", True), ("empty", True), ("missing", True), ("missing", True)]
    assert {r[0] for r in relations.key_states(rows.where("j <> '{\"a\": 1}'"), "j", "a").select("any_present").collect()} == {False}
    users = spark.createDataFrame([(1, "SUPER_ADMIN"), (2, "USER"), (3, None)], "user_id long, global_role string")
    held = relations.allowed(users, spark.createDataFrame([(2, "ed", 7), (2, "ed", None), (3, "all", None), (3, "none", 7)], "user_id long, role string, site long"), spark.createDataFrame([("ed", "publish", "SITE"), ("all", "publish", "GLOBAL"), ("none", "read", "GLOBAL")], "role string, permission string, scope string"), "publish")
    asked = spark.createDataFrame([(1, 7), (2, 7), (2, 8), (3, 9), (4, 7), (None, 7)], "user_id long, site long")
    assert {(r["user_id"], r["site"]): r["allowed"] for r in relations.may(asked, held).collect()} == {(1, 7): True, (2, 7): True, (2, 8): False, (3, 9): True, (4, 7): False, (None, 7): False}


def test_facts_are_bound_once_and_say_the_same(spark):
    rows = spark.createDataFrame([("PHONE", "+375 (29) 123-45-67"), ("PHONE", "1999-2004"), ("PHONE", "123456789"), ("PHONE", None), ("EMAIL", "0101.sales@firm.by"), ("EMAIL", "a@example.com"), ("EMAIL", "logo@2x.png"), ("FOUNDING_DATE", "с 1998 года"), ("EMPLOYEE_COUNT", "0 сотрудников"), ("REGISTRATION_ID", "12 345 678 9"), ("OTHER", "x")], "kind string, raw string")
    got = [(r["ok"], r["value"], r["reason"]) for r in facts.gate(rows).collect()]
    assert got == [(True, "+375 (29) 123-45-67", None), (False, None, "YEAR_RANGE"), (False, None, "AMBIGUOUS_NINE_DIGIT"), (False, None, "EMPTY"), (True, "sales@firm.by", None), (False, None, "PLACEHOLDER"), (False, None, "IMAGE_FILENAME"), (True, "1998", None), (False, None, "COUNTER_ZERO"), (False, None, "REGISTRATION_WITHOUT_LABEL"), (None, None, None)]


def test_summaries_stop_at_the_second_clean_sentence(spark):
    clean, junk = "A first clean sentence. A second clean sentence. ", "Call us about sentence number n, and order now. " * 30_000

    def took(text):
        rows = spark.createDataFrame([(text,)], "raw string").select(summaries.card_summary(F.col("raw"), F.lit("Some title")).alias("s"))
        began = time.perf_counter()
        assert rows.first().s == clean.strip()
        return time.perf_counter() - began

    took(clean + junk)
    assert 1.5 * min(took(clean + junk), took(clean + junk)) < took(junk + clean)
