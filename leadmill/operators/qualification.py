"""Qualification: the next stage of each lead, bulk eligibility, stage gates, restart repairs, provider chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.functions.compat import yes

# Operations of the stages, stages in order, statuses that end a stage, error patterns in order.
OPERATIONS = {"enrich": "ENRICH_LEAD", "audit": "AUDIT_WEBSITE", "lighthouse": "RUN_LIGHTHOUSE", "ai": "RUN_VISUAL_ANALYSIS", "scoring": "RECALCULATE_SCORE"}
STAGES = ("website", "audit", "screenshots", "lighthouse", "ai", "scoring")
PIPELINE = ("CRAWLED", "EXTRACTED", "CONTENT_VALIDATED", "GRAPH_BUILT", "CMS_IMPORT_READY", "CMS_IMPORTED", "RENDERED", "RENDER_VALIDATED", "VISUAL_VALIDATED", "PREVIEW_PUBLISHED", "HUMAN_REVIEW_READY")
STOPPING = ("FAILED", "SKIPPED", "CANCELLED")
ERRORS = (
    ("PLAYWRIGHT_BROWSER_MISSING", r"(?i)Executable doesn't exist at|chromium.*not.*install|playwright.*chromium|browserType\.launch"),
    ("LIGHTHOUSE_BROWSER_MISSING", r"(?i)chrome.*not.*found|chromium.*lighthouse|no.*chrome.*binary"),
    ("SOURCE_TIMEOUT", r"(?i)page\.goto.*timeout|navigation.*timeout|net::ERR_CONNECTION_TIMED_OUT|ETIMEDOUT"),
    ("SOURCE_DNS_FAILED", r"(?i)net::ERR_NAME_NOT_RESOLVED|getaddrinfo.*ENOTFOUND|DNS.*lookup"),
    ("AI_RATE_LIMIT", r"(?i)rate limit|too many requests|429|insufficient_quota"),
    ("AI_PROVIDER_ERROR", r"(?i)ai.*provider|gemini.*error|openai.*error|vision.*provider"),
    ("MEDIA_DOWNLOAD_FAILED", r"(?i)download.*fail|media.*download|fetch.*image"),
    ("CMS_IMPORT_FAILED", r"(?i)cms.*import|importToCms|import.*fail"),
    ("RENDER_FAILED", r"(?i)render.*fail|showcase.*render|site.*render"),
    ("DATABASE_UNAVAILABLE", r"(?i)database.*connect|prisma.*connect|ECONNREFUSED.*5432|connection.*postgres"),
)


def _act(action: str | None, reason: Column | str | None) -> Column:
    reason = F.lit(reason) if reason is None or isinstance(reason, str) else reason
    return F.struct(F.lit(action).cast("string").alias("stage"), reason.cast("string").alias("reason"))


def next_action(active: Column | None = None) -> Column:
    """struct(stage, reason) of a lead: the stage to start, or why nothing starts.

    Columns: website, website_status, audit_status, lighthouse_status, visual_status, score_status,
    enrichment_status, manual_review_status. ``active``: operations that run already are not started again.
    """
    active = F.array().cast("array<string>") if active is None else F.coalesce(active, F.array().cast("array<string>"))

    def start(stage: str) -> Column:
        return F.when(F.array_contains(active, OPERATIONS[stage]), _act(None, "already_active")).otherwise(_act(stage, None))

    def stopped(column: str, name: str) -> Column:
        return _act(None, F.concat(F.lit(f"{name}_"), F.lower(column)))

    no_site = ~yes(F.col("website_status") == "FOUND") | (F.coalesce(F.col("website"), F.lit("")) == "")
    enriching = F.array_contains(active, OPERATIONS["enrich"])
    return (
        F.when(yes(F.col("manual_review_status") == "BAD"), _act(None, "manually_rejected"))
        .when(yes(F.col("website_status") == "FAILED"), _act(None, "website_unreachable"))
        .when(no_site & F.col("enrichment_status").isin(*STOPPING), stopped("enrichment_status", "enrichment"))
        .when(no_site & ~yes(F.col("enrichment_status") == "SUCCESS") & ~enriching, _act("enrich", None))
        .when(no_site, _act(None, "no_website"))
        .when(F.col("audit_status").isin(*STOPPING), stopped("audit_status", "audit"))
        .when(~yes(F.col("audit_status") == "SUCCESS"), start("audit"))
        .when(F.col("lighthouse_status").isNull(), start("lighthouse"))
        .when(F.col("visual_status").isin(*STOPPING), stopped("visual_status", "visual"))
        .when(~yes(F.col("visual_status") == "SUCCESS"), start("ai"))
        .when(F.col("score_status").isin(*STOPPING), stopped("score_status", "score"))
        .when(~yes(F.col("score_status") == "SUCCESS"), start("scoring"))
        .otherwise(_act(None, "ready_for_review"))
    )


def bulk_eligibility(active: Column | None = None) -> Column:
    """struct(result, reason) of a request to analyse a lead again."""
    out = lambda result, reason: F.struct(F.lit(result).alias("result"), F.lit(reason).alias("reason"))
    running = F.lit(False) if active is None else yes(F.array_contains(active, OPERATIONS["ai"]))
    return (
        F.when(yes(F.col("manual_review_status") == "BAD"), out("SKIPPED", "rejected"))
        .when(yes(F.col("website_status") == "FAILED") | (F.coalesce(F.col("website"), F.lit("")) == ""), out("SKIPPED", "no_viable_website"))
        .when(~yes(F.col("audit_status") == "SUCCESS"), out("SKIPPED", "audit_not_success"))
        .when(running, out("SKIPPED", "ai_running"))
        .when(yes(F.col("visual_status") == "SUCCESS"), out("STARTED", "rerun"))
        .when(yes(F.col("visual_status") == "FAILED"), out("STARTED", "retry"))
        .otherwise(out("STARTED", "first_run"))
    )


def stage_rows(leads: DataFrame) -> DataFrame:
    """id, ord, stage, status, waiting_for: a pending stage behind an incomplete one is WAITING for it."""
    status = {
        "website": F.coalesce("website_status", F.when(F.col("website").isNotNull(), "FOUND").otherwise("NOT_FOUND")),
        "audit": F.coalesce("audit_status", F.lit("PENDING")),
        "screenshots": F.when(F.col("audit_status").isin("SUCCESS", "FAILED"), F.col("audit_status")).otherwise("PENDING"),
        "lighthouse": F.coalesce("lighthouse_status", F.lit("PENDING")),
        "ai": F.coalesce("visual_status", F.lit("PENDING")),
        "scoring": F.coalesce("score_status", F.lit("PENDING")),
    }
    stages = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(s).alias("stage"), status[s].alias("status")) for i, s in enumerate(STAGES)))
    # All stages of a lead are in its row, so what is open before one is found there too.
    before = lambda s: F.transform(F.filter("stages", lambda x: (x["ord"] < s["ord"]) & ~x["status"].isin("SUCCESS", "SKIPPED", "FOUND")), lambda x: x["stage"])
    rows = leads.select("id", stages.alias("stages")).select("id", F.explode(F.transform("stages", lambda s: F.struct(s["ord"].alias("ord"), s["stage"].alias("stage"), s["status"].alias("status"), before(s).alias("open")))).alias("s")).select("id", "s.*")
    waits = (F.col("status") == "PENDING") & (F.size("open") > 0)
    return rows.select("id", "ord", "stage", F.when(waits, "WAITING").otherwise(F.col("status")).alias("status"), F.when(waits, F.col("open")).otherwise(F.array().cast("array<string>")).alias("waiting_for"))


def stage_gate(results: DataFrame) -> DataFrame:
    """Adds status and retry_from to (stage, errors, warnings): a failed stage restarts itself, else the next one is due."""
    order = F.array(*map(F.lit, PIPELINE))
    place = F.array_position(order, F.col("stage"))
    after = F.get(order, F.least(place, F.lit(len(PIPELINE) - 1)).cast("int"))
    failed = F.size("errors") > 0
    return results.withColumns({"status": F.when(failed, "FAIL").when(F.size("warnings") > 0, "PASS_WITH_WARNINGS").otherwise("PASS"), "retry_from": F.when(failed, F.col("stage")).otherwise(after)})


def latest_gates(results: DataFrame) -> DataFrame:
    """Of each run's results for a stage the last one counts."""
    others = [c for c in results.columns if c not in ("run_id", "stage")]
    return results.groupBy("run_id", "stage").agg(F.max_by(F.struct(*others), "finished_at").alias("r")).select("run_id", "stage", "r.*")


def repair_statuses(leads: DataFrame) -> DataFrame:
    """After a restart: a pending audit with an error has failed, pending scores that exist have succeeded, and so on."""
    return leads.withColumns({
        "audit_status": F.when((F.col("audit_status") == "PENDING") & F.col("audit_error").isNotNull(), "FAILED").otherwise(F.col("audit_status")),
        "score_status": F.when((F.col("score_status") == "PENDING") & F.col("lead_score_v2").isNotNull(), "SUCCESS").otherwise(F.col("score_status")),
        "visual_status": F.when((F.col("visual_status") == "PENDING") & F.col("visual_error").isNotNull(), "FAILED").when((F.col("visual_status") == "PENDING") & (F.coalesce("visual_summary", F.lit("")) != ""), "SUCCESS").otherwise(F.col("visual_status")),
    })


def first_eligible(attempts: DataFrame) -> DataFrame:
    """Of each candidate's attempts (id, ord, provider, value, eligible): the first eligible one, and how many were made."""
    return attempts.groupBy("id").agg(F.min_by(F.struct("provider", "value"), F.when(F.col("eligible"), F.col("ord"))).alias("hit"), F.count(F.lit(1)).alias("attempts")).select("id", F.col("hit.provider").alias("provider"), F.col("hit.value").alias("value"), "attempts")


def error_code(message: Column) -> Column:
    """Code of the first pattern that an error message fits."""
    out = None
    for code, pattern in ERRORS:
        test = yes(F.rlike(message, F.lit(pattern)))
        out = F.when(test, code) if out is None else out.when(test, code)
    return out.otherwise("UNKNOWN_ERROR")
