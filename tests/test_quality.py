"""The nineteen checks of content, each on a small case."""

import datetime
import re

from pyspark.sql import functions as F

from leadmill.operators import quality

NOW = datetime.datetime(2024, 5, 1, 12)
ENTITY = "entity_id string, ord long, kind string, slug string, title string, summary string, source_url string, dates array<timestamp>"
BLOCK = "entity_id string, ord long, type string, heading string, body string, items array<string>"


def run(spark, entities=(), blocks=(), **more):
    now = F.lit(NOW.isoformat()).cast("timestamp")
    rows = quality.content_findings(spark.createDataFrame(list(entities), ENTITY), spark.createDataFrame(list(blocks), BLOCK), now, now, **more).collect()
    assert all(r["severity"] == quality.SEVERITY[r["kind"]] for r in rows)
    return sorted((r["entity_id"], r["field"], r["kind"]) for r in rows)


def test_entities(spark):
    minute = datetime.timedelta(minutes=1)
    entities = [
        ("a", 1, "news", "x", " ", None, "u", [NOW - 5 * minute]), ("b", 2, "news", "x", "B", "Закажите дом", None, [NOW + minute, None]), ("c", 3, "service", "x", "C", None, "u", [NOW - minute]),
        ("d", 4, "news", None, "D", "Two  spaces", "u", None), ("e", 5, "news", "", "E", "", "", []), ("f", 6, "service", "y", "F", "Пишите нам: mail@example.com, консультация", None, None),
    ]
    assert run(spark, entities) == sorted([
        ("a", "news", "empty-title"), ("a", "news", "fabricated-date"), ("b", "news", "cta-as-lede"), ("b", "news", "suspicious-date"), ("b", "news.slug", "duplicate-entity"), ("d", "news", "missing-date"), ("d", "news.source_url", "duplicate-entity"),
        ("d", "news.summary", "whitespace"), ("e", "news", "missing-date"), ("f", "service", "cta-as-lede"), ("f", "service.summary", "placeholder-contact"), ("f", "service.summary", "technical-payload"),
    ])


def test_blocks(spark):
    text, long = "richText", "z" * 3001
    blocks = [
        ("a", 1, text, "Same  thing", "same thing", None), ("a", 2, text, "Alone", None, []), ("a", 3, "list", None, None, ["one", "", None, "two"]), ("a", 4, "gallery", "", "", ["pic"]),
        ("b", 1, text, "H", "Body", None), ("b", 2, text, "", "  ", None), ("b", 3, text, "h", "body", ["   "]), ("b", 4, "quote", "h", "body", None),
        ("c", 1, text, None, "1", None), ("c", 2, text, None, "2", None), ("c", 3, text, "cut", "3", None), *(("c", 4 + i, text, None, f"{i} of", None) for i in range(9)),
        ("d", 1, "text", "", long, None), ("d", 2, "text", "", "y" * 12001, None), ("d", 3, "text", "", "word Проблемы наши Решения ваши Мы и ещё много слов до шестидесяти знаков", None), ("d", 4, "text", "", "para one\n\nPARA  one\npara one", None),
    ]
    assert run(spark, blocks=blocks) == sorted([
        ("a", "block.richText", "duplicate-heading-body"), ("a", "block.richText.heading", "whitespace"), ("a", "block.richText", "empty-heading"), ("a", "block.list", "orphan-list"),
        ("b", "block.richText", "duplicate-responsive-section"), ("b", "block.quote", "duplicate-adjacent-paragraph"), ("c", "block.richText", "excessive-fragmentation"),
        ("d", "block.text.content", "oversized-content"), ("d", "block.text.content", "oversized-content"), ("d", "block.text", "oversized-content"), ("d", "block.text.content", "glued-description"),
        ("d", "block.text.content", "duplicate-adjacent-paragraph"), ("d", "block.text.content", "duplicate-adjacent-paragraph"), ("d", "block.text.content", "whitespace"),
    ])


def test_pictures_and_dropped_sources(spark):
    hero = spark.createDataFrame([("home", "/a"), ("other", "/b"), ("none", None)], "entity_id string, src string")
    media = spark.createDataFrame([("/a", False), ("/a", False), ("/b", True), (None, False)], "src string, suitable boolean")
    dropped = spark.createDataFrame([("Gone",), (None,)], "title string")
    assert run(spark, hero=hero, media=media, dropped=dropped) == [("Gone", "source", "dropped-entity"), ("home", "hero", "invalid-hero-media"), ("unknown", "source", "dropped-entity")]
    assert set(quality.SEVERITY) >= {"technical-payload", "invalid-hero-media"} and len(quality.SEVERITY) == 19


def test_no_text_of_a_block_is_shuffled(spark):
    plan = quality.block_findings(spark.createDataFrame([], BLOCK))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    dealt = re.findall(r"\) Exchange\s*\nInput \[\d+\]: \[(.*)\]", plan)
    assert dealt and not any(re.search("heading|body|items", columns) for columns in dealt)
