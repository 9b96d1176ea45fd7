"""Checks of a site's content before it is shown: one table of findings, whatever check each comes from.

Texts are judged where they lie, blocks beside their neighbours, entities by their own fields and by who
else claims their address. Only findings leave a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadmill.functions.compat import bound, one_space, yes
from leadmill.functions.ledes import call_to_act
from leadmill.functions.texts import technical_payload

# What no contact is, white space that shows, a word that lost its sentence break, and lengths.
PLACEHOLDER = r"(?i)mail@example\.|example\.(com|org|ru|by|net)|\+375\s*\(99\)\s*999-99-99|999-99-99|xxx+"
WHITE_SPACE = r"(?m)  |\t| $|^ "
TRANSITION = r"[а-яёa-z][ ]+[А-ЯЁA-Z][а-яёa-z]"
MOST_PARAGRAPH, MOST_BLOCK, LEAST_GLUED, GLUED_AT, ANONYMOUS_RUN, FABRICATED_MINUTES = 3000, 12000, 60, 3, 4, 10
SEVERITY = {
    "technical-payload": "error", "placeholder-contact": "error", "glued-description": "warning", "whitespace": "info", "oversized-content": "warning", "duplicate-adjacent-paragraph": "warning", "duplicate-heading-body": "warning", "empty-heading": "warning", "orphan-list": "info",
    "duplicate-responsive-section": "error", "excessive-fragmentation": "warning", "empty-title": "error", "cta-as-lede": "error", "suspicious-date": "error", "fabricated-date": "error", "missing-date": "info", "duplicate-entity": "error", "invalid-hero-media": "error", "dropped-entity": "warning",
}


def _plain(text: Column) -> Column:
    return F.lower(one_space(F.coalesce(text, F.lit(""))))


def _listed(*tests: tuple[str, Column]) -> Column:
    """The names of the tests that hold, as an array."""
    return F.array_compact(F.array(*(F.when(yes(test), F.lit(name)) for name, test in tests)))


def text_findings(text: Column) -> Column:
    """Names of the checks that a text fails; one for each paragraph that repeats the one before it. Blank texts fail none."""
    t = F.coalesce(text, F.lit(""))
    transitions = F.array_max(F.transform(F.split(t, "\n"), lambda p: F.regexp_count(p, F.lit(TRANSITION))))
    paragraphs = F.filter(F.transform(F.split(t, "\n"), _plain), lambda p: p != "")
    again = bound(paragraphs, lambda p: F.filter(F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.when(yes(a == b), F.lit("duplicate-adjacent-paragraph"))), lambda x: x.isNotNull()))
    own = _listed(("technical-payload", technical_payload(t)["technical"]), ("placeholder-contact", F.rlike(t, F.lit(PLACEHOLDER))), ("glued-description", (F.length(t) >= LEAST_GLUED) & (transitions >= GLUED_AT)), ("whitespace", F.rlike(t, F.lit(WHITE_SPACE))), ("oversized-content", F.length(t) > MOST_PARAGRAPH))
    return F.when(F.trim(t) != "", F.concat(own, again)).otherwise(F.array().cast("array<string>"))


def block_findings(blocks: DataFrame) -> DataFrame:
    """entity_id, field, kind of blocks (entity_id, ord, type, heading, body, items)."""
    rows = blocks.withColumns({"heading": F.trim(F.coalesce("heading", F.lit(""))), "body": F.trim(F.coalesce("body", F.lit(""))), "items": F.filter(F.coalesce("items", F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))})
    texts = F.concat(F.array(F.struct(F.lit("heading").alias("part"), F.col("heading").alias("t")), F.struct(F.lit("content").alias("part"), F.col("body").alias("t"))), F.transform("items", lambda x: F.struct(F.lit("items").alias("part"), x.alias("t"))))
    field = lambda part: F.concat(F.lit("block."), F.col("type"), F.lit("."), part)
    said = rows.select("entity_id", "type", F.inline(F.transform(texts, lambda x: F.struct(x["part"].alias("part"), text_findings(x["t"]).alias("kinds"))))).select("entity_id", field(F.col("part")).alias("field"), F.explode("kinds").alias("kind"))

    order = Window.partitionBy("entity_id").orderBy("ord")
    # The whole block in one form, as a digest, since blocks only meet their neighbour; what a block's own texts tell is told
    # before blocks are shuffled, so that no text is.
    whole = F.nullif(_plain(F.concat_ws(" ", "heading", "body", F.array_join("items", " "))), F.lit(""))
    empty = (F.col("body") == "") & (F.size("items") == 0)
    own = _listed(
        ("duplicate-heading-body", (F.col("heading") != "") & (F.col("body") != "") & (_plain(F.col("heading")) == _plain(F.col("body")))),
        ("empty-heading", (F.col("heading") != "") & empty & (F.col("type") == "richText")),
        ("orphan-list", (F.size("items") > 0) & (F.col("heading") == "") & (F.col("type") != "gallery")),
        ("oversized-content", F.length("body") > MOST_BLOCK),
    )
    near = rows.select("entity_id", "ord", "type", own.alias("own"), F.unhex(F.sha2(whole, 256)).alias("whole"), ((F.col("type") == "richText") & (F.col("heading") == "")).alias("anonymous"))
    near = near.withColumns({"before": F.last("whole", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), "type_before": F.lag("type").over(order)})
    island = F.row_number().over(order) - F.row_number().over(Window.partitionBy("entity_id", "anonymous").orderBy("ord"))
    near = near.withColumn("island", island).withColumn("run", F.row_number().over(Window.partitionBy("entity_id", "anonymous", "island").orderBy("ord")))
    same = yes(F.col("whole") == F.col("before"))
    kinds = F.concat("own", _listed(
        ("duplicate-responsive-section", same & yes(F.col("type") == F.col("type_before"))),
        ("duplicate-adjacent-paragraph", same & ~yes(F.col("type") == F.col("type_before"))),
        ("excessive-fragmentation", F.col("anonymous") & (F.col("run") == ANONYMOUS_RUN)),
    ))
    return said.unionByName(near.select("entity_id", F.concat(F.lit("block."), "type").alias("field"), F.explode(kinds).alias("kind")))


def entity_findings(entities: DataFrame, generated_at: Column, as_of: Column) -> DataFrame:
    """entity_id, field, kind of entities (entity_id, ord, kind, slug, title, summary, source_url, dates array<timestamp>).

    An address or source that several entities of a kind claim is a finding for each but the first."""
    dates = F.filter(F.coalesce("dates", F.array().cast("array<timestamp>")), lambda d: d.isNotNull())
    news = F.col("kind") == "news"
    late = F.transform(F.filter(dates, lambda d: d > as_of), lambda d: F.lit("suspicious-date"))
    minutes = lambda d: F.abs(F.unix_micros(d) - F.unix_micros(generated_at)) < FABRICATED_MINUTES * 60_000_000
    made = F.transform(F.filter(dates, lambda d: (d <= as_of) & news & minutes(d)), lambda d: F.lit("fabricated-date"))
    own = _listed(("empty-title", F.trim(F.coalesce("title", F.lit(""))) == ""), ("cta-as-lede", call_to_act(F.col("summary"))), ("missing-date", news & (F.size(dates) == 0)))
    tagged = lambda kinds, field: F.transform(kinds, lambda k: F.struct(F.concat(F.col("kind"), F.lit(field)).alias("field"), k.alias("found")))
    found = entities.select("entity_id", F.inline(F.concat(tagged(F.concat(own, late, made), ""), tagged(text_findings(F.col("summary")), ".summary")))).withColumnRenamed("found", "kind")
    for claim in ("slug", "source_url"):
        claimed = entities.where(F.col(claim) != "")
        first = claimed.groupBy("kind", claim).agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        again = claimed.join(first, ["kind", claim]).where("ord > first").select("entity_id", F.concat("kind", F.lit(f".{claim}")).alias("field"), F.lit("duplicate-entity").alias("kind"))
        found = found.unionByName(again)
    return found


def content_findings(entities: DataFrame, blocks: DataFrame, generated_at: Column, as_of: Column, hero: DataFrame | None = None, media: DataFrame | None = None, dropped: DataFrame | None = None) -> DataFrame:
    """entity_id, field, kind, severity of all nineteen checks.

    ``hero``: entity_id, src. ``media``: src, suitable. ``dropped``: title. A hero picture that was refused as a cover, and
    a source that became no entity, are findings too.
    """
    found = entity_findings(entities, generated_at, as_of).unionByName(block_findings(blocks))
    if hero is not None and media is not None:
        refused = media.where(~F.col("suitable")).select("src").distinct()
        found = found.unionByName(hero.join(refused, "src", "left_semi").select("entity_id", F.lit("hero").alias("field"), F.lit("invalid-hero-media").alias("kind")))
    if dropped is not None:
        found = found.unionByName(dropped.select(F.coalesce("title", F.lit("unknown")).alias("entity_id"), F.lit("source").alias("field"), F.lit("dropped-entity").alias("kind")))
    severity = None
    for kind, value in SEVERITY.items():
        severity = F.when(F.col("kind") == kind, value) if severity is None else severity.when(F.col("kind") == kind, value)
    return found.withColumn("severity", severity)
