"""The lead list and its counters: one plan per request, all predicates in it.

``LeadFilter`` holds the optional parameters of the list; a filter applies only where it narrows
the default. Every sort order ends in the id, so pages never overlap.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.functions.compat import ascending, descending, holds, yes

SEARCHED = ("company_name", "website", "website_domain", "phone", "address", "manual_review_note")
MOST_TOKENS = 8
# The stages of each generation status, and what each sort goes by before the id.
GENERATION_STAGES = {
    "NOT_SELECTED": ["NOT_SELECTED"],
    "SELECTED": ["SELECTED_FOR_REDESIGN"],
    "GENERATING": ["CRAWL_READY", "CONTENT_EXTRACTED", "CONTENT_VALIDATED", "GRAPH_BUILT", "CMS_IMPORT_READY", "CONTENT_TRANSFORMED", "CMS_IMPORTED", "SITE_RENDERED", "RENDER_VALIDATED", "VISUAL_VALIDATED", "AUDIT_DONE"],
    "GENERATED": ["DEMO_GENERATED", "HUMAN_REVIEW_READY", "DEMO_APPROVED", "READY_TO_CONTACT"],
    "FAILED": ["CRAWL_FAILED"],
}
SORT_COLUMNS = {"createdAt": "created_at", "company": "company_name", "v2": "lead_score_v2", "lead": "lead_score", "biz": "business_score", "visual": "visual_quality_score", "tech": "technical_quality_score", "web": "website_quality_score"}


@dataclass(frozen=True)
class LeadFilter:
    text: str = ""
    min_lead: float = 0
    min_business: float = 0
    max_website: float = 100
    min_v2: float = 0
    max_v2: float = 100
    visual_status: str = ""
    manual: str = ""
    website_status: str = ""
    enrichment_status: str = ""
    audit_status: str = ""
    include_excluded: bool = False
    qualification: str = "READY"
    generation: str = "ALL"
    sort: str = "lead_desc"
    limit: int = 50
    offset: int = 0
    #: The web service lets a one-word search replace the FAILED filter, and READY replace status filters.
    compat: bool = False


def actionable() -> Column:
    """Neither merged away nor archived."""
    return (F.col("merge_status") == "NONE") & ~F.col("archived")


def ready_for_review() -> Column:
    return yes((F.col("website_status") == "FOUND") & (F.col("audit_status") == "SUCCESS") & (F.col("lighthouse_status") == "SUCCESS") & (F.col("visual_status") == "SUCCESS") & (F.col("score_status") == "SUCCESS"))


def pending() -> Column:
    """Found, but not ready: an absent report counts as not ready."""
    return (F.col("website_status") == "FOUND") & ~ready_for_review()


def failed_checks() -> Column:
    """Stopped by a failed stage; a stage that runs or waits does not count."""
    stages = ("website_status", "audit_status", "score_status", "visual_status", "lighthouse_status")
    return reduce(lambda a, b: a | b, (yes(F.col(c) == "FAILED") for c in stages))


def search(columns: list[str], text: str) -> list[Column]:
    """One condition per word: some column holds it. At most MOST_TOKENS words count."""
    words = [w for w in re.split(r"[\s,;]+", text) if w][:MOST_TOKENS]
    held = [c for c in SEARCHED if c in columns]
    return [reduce(lambda a, b: a | b, (yes(holds(F.col(c), w)) for c in held)) for w in words]


def conditions(columns: list[str], p: LeadFilter) -> list[Column]:
    out = [actionable()]
    out += [F.col("lead_score") >= p.min_lead] if p.min_lead > 0 else []
    out += [F.col("business_score") >= p.min_business] if p.min_business > 0 else []
    out += [F.col("website_quality_score") <= p.max_website] if p.max_website < 100 else []
    out += [F.col("lead_score_v2").between(p.min_v2, p.max_v2)] if p.min_v2 > 0 or p.max_v2 < 100 else []
    out += [F.col("manual_review_status") == p.manual] if p.manual else []
    out += [F.col("enrichment_status") == p.enrichment_status] if p.enrichment_status else []
    replaced = p.compat and p.qualification == "READY"
    if not replaced:
        out += [F.col("visual_status") == p.visual_status] if p.visual_status else []
        out += [F.col("audit_status") == p.audit_status] if p.audit_status else []
        if p.website_status:
            out.append(F.col("website_status") == p.website_status)
        elif not p.include_excluded and p.qualification != "FAILED":
            out.append(F.col("website_status") == "FOUND")
    words = search(columns, p.text)
    if p.qualification == "READY":
        out.append(ready_for_review())
    elif p.qualification == "PENDING":
        out.append(pending())
    elif p.qualification == "FAILED" and not (p.compat and len(words) == 1):
        out.append(failed_checks())
    if p.generation == "READY_FOR_GENERATION":
        out += [F.col("manual_review_status") == "GOOD", F.col("redesign_stage") != "NOT_SELECTED"]
    elif p.generation in GENERATION_STAGES:
        out.append(F.col("redesign_stage").isin(GENERATION_STAGES[p.generation]))
    return out + words


def sort_order(columns: list[str], name: str) -> list[Column]:
    """The named order; an unknown name sorts by creation, newest first."""
    key, _, way = name.rpartition("_")
    column = SORT_COLUMNS.get(key, "created_at")
    if column not in columns:
        column, way = "created_at", "desc"
    out = [ascending(column) if way == "asc" and key in SORT_COLUMNS else descending(column)]
    if column not in ("created_at", "company_name"):
        out.append(descending("lead_score" if column == "lead_score_v2" else "lead_score_v2"))
    return [*out, ascending("id")]


def lead_page(leads: DataFrame, p: LeadFilter, run_leads: DataFrame | None = None) -> DataFrame:
    """A page of leads with ``ready_for_review``; ``run_leads`` (id) keeps a discovery run's leads only.

    The limit is held inside 1..200. A filtered top-k: no full sort of the table.
    """
    out = leads if run_leads is None else leads.join(run_leads.select("id").distinct(), "id", "left_semi")
    out = reduce(lambda d, c: d.where(c), conditions(leads.columns, p), out)
    out = out.withColumn("ready_for_review", ready_for_review())
    return out.orderBy(*sort_order(leads.columns, p.sort)).offset(max(0, p.offset)).limit(min(200, max(1, p.limit)))


def with_operations(page: DataFrame, operations: DataFrame) -> DataFrame:
    """The leads of a page with their active operations (id, operation, status), ordered by name."""
    active = operations.where(F.col("status").isin("QUEUED", "RUNNING")).groupBy("id").agg(F.array_sort(F.collect_list("operation")).alias("operations"))
    return page.join(active, "id", "left").withColumn("operations", F.coalesce("operations", F.array().cast("array<string>")))


def lead_changes(leads: DataFrame, since: Column, limit: int = 200) -> DataFrame:
    """Rows changed after ``since``, oldest change first."""
    return leads.where(F.col("updated_at") > since).orderBy(ascending("updated_at"), ascending("id")).limit(limit)


def funnel(leads: DataFrame) -> DataFrame:
    """All sixteen counters of the lead list in one pass."""
    found, good, failed = F.col("website_status") == "FOUND", F.col("manual_review_status") == "GOOD", failed_checks()
    counts = {
        "total": F.lit(True),
        "with_website": found,
        "without_website": F.col("website_status").isin("UNKNOWN", "NOT_FOUND"),
        "enriched": F.col("enrichment_status") == "SUCCESS",
        "audited": F.col("audit_status") == "SUCCESS",
        "lighthoused": F.col("lighthouse_status") == "SUCCESS",
        "ai_analyzed": F.col("visual_status") == "SUCCESS",
        "scored": F.col("score_status") == "SUCCESS",
        "ready_for_review": ready_for_review(),
        "qualification_pending": pending(),
        "qualification_failed": failed,
        "good": ready_for_review() & good,
        "selected": F.col("redesign_stage") == "SELECTED_FOR_REDESIGN",
        "generated": F.col("has_site"),
        "ready_for_generation": good & (F.col("redesign_stage") != "NOT_SELECTED"),
        "failed": failed,
    }
    return leads.where(actionable()).agg(*(F.count_if(c).alias(k) for k, c in counts.items()))


def run_funnel(leads: DataFrame, run_leads: DataFrame) -> DataFrame:
    """A discovery run's twenty counters in one pass; an empty run gives zeros. ``run_leads``: id."""
    reason = F.col("ineligibility_reason")
    counts = {
        "total": F.lit(True),
        "with_website": F.col("website_status") == "FOUND",
        "without_website": F.col("website_status") != "FOUND",
        **{name: reason == value for name, value in (("no_website", "NO_WEBSITE"), ("aggregator", "AGGREGATOR"), ("directory", "DIRECTORY"), ("government", "GOVERNMENT"), ("social", "SOCIAL_NETWORK"), ("marketplace", "MARKETPLACE"), ("map_provider", "MAP_PROVIDER"))},
        "other_ineligible": reason.isin("BLACKLISTED_DOMAIN", "OTHER_NON_COMPANY_SITE", "INVALID_URL", "SEARCH_ENGINE"),
        "enriched": F.col("enrichment_status") == "SUCCESS",
        "audited": F.col("audit_status") == "SUCCESS",
        "lighthoused": F.col("lighthouse_status").isNotNull(),
        "ai_analyzed": F.col("visual_status") == "SUCCESS",
        "scored": F.col("lead_score_v2").isNotNull(),
        "good": F.col("manual_review_status") == "GOOD",
        "selected": F.col("redesign_stage") == "SELECTED_FOR_REDESIGN",
        "generated": F.col("has_site"),
        "failed": F.col("audit_status") == "FAILED",
    }
    return leads.join(run_leads.select("id").distinct(), "id", "left_semi").agg(*(F.count_if(c).alias(k) for k, c in counts.items()))
