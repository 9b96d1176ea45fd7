"""Security findings: counts, the gate's verdict, upsert and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.functions.compat import yes

OPEN = ("OPEN", "FIXING")
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")


def counts_by(findings: DataFrame, *keys: str) -> DataFrame:
    return findings.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def distinct_findings(findings: DataFrame) -> DataFrame:
    """One row per canonical id, or per id where there is none: the lowest id stands for it."""
    others = [c for c in findings.columns if c != "id"]
    key = F.coalesce(F.col("canonical_id").cast("string"), F.concat(F.lit("#"), F.col("id").cast("string")))
    return findings.groupBy(key.alias("canonical_key")).agg(F.min("id").alias("id"), F.min_by(F.struct(*others), "id").alias("row")).select("canonical_key", "id", "row.*")


def gate_counts(findings: DataFrame) -> DataFrame:
    """Open distinct findings by severity, in one row with a column for each."""
    rows = distinct_findings(findings).where(F.col("status").isin(*OPEN))
    return rows.agg(*(F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES))


def gate_status(counts: DataFrame) -> DataFrame:
    """Adds ``gate``: any critical one fails it, any high one warns."""
    return counts.withColumn("gate", F.when(F.col("critical") > 0, "FAIL").when(F.col("high") > 0, "WARN").otherwise("PASS"))


def reconcile(findings: DataFrame, reported: DataFrame, scanner: str, ok: bool, present: DataFrame | None = None) -> DataFrame:
    """The findings after a scanner's run.

    ``reported``: fingerprint, severity and the like. Known ones are seen again, and reopen if they had been
    resolved or taken for false; accepted risks stay so. New ones open. The scanner's own open findings
    that it did not report are resolved, and with ``present`` (dependency) those of other scanners
    whose dependency is gone. A failed run resolves nothing.
    """
    seen = reported.select("fingerprint").distinct().withColumn("seen", F.lit(True))
    out = findings.join(seen, "fingerprint", "left")
    reopened = yes(F.col("seen")) & F.col("status").isin("RESOLVED", "FALSEPOSITIVE")
    unseen = F.col("seen").isNull() & (F.col("scanner") == scanner) & F.col("status").isin(*OPEN) & F.lit(ok)
    status = F.when(reopened, "OPEN").when(unseen, "RESOLVED")
    if present is not None and ok:
        out = out.join(present.select("dependency").distinct().withColumn("here", F.lit(True)), "dependency", "left")
        gone = (F.col("scanner") != scanner) & F.col("dependency").isNotNull() & F.col("here").isNull() & F.col("status").isin(*OPEN) & F.col("seen").isNull()
        status = status.when(gone, "RESOLVED")
    out = out.withColumn("status", status.otherwise(F.col("status"))).select(*findings.columns)
    new = reported.join(findings.select("fingerprint"), "fingerprint", "left_anti").withColumns({"status": F.lit("OPEN"), "scanner": F.lit(scanner)})
    return out.unionByName(new.dropDuplicates(["fingerprint"]), allowMissingColumns=True)


def severity_of(cvss: Column) -> Column:
    """Severity of a CVSS score; null for none."""
    score = cvss.try_cast("double")
    return F.when(score >= 9, "CRITICAL").when(score >= 7, "HIGH").when(score >= 4, "MEDIUM").when(score > 0, "LOW")


def reachable_environment(is_dev: Column, is_optional: Column, direct: Column) -> Column:
    """struct(environment, reachability) of a locked dependency."""
    return F.struct(F.when(is_dev, "DEVELOPMENT").when(is_optional, "OPTIONAL").otherwise("PRODUCTION").alias("environment"), F.when(direct, "DIRECT").otherwise("TRANSITIVE").alias("reachability"))


def private_address(ip: Column) -> Column:
    """True for loopback, private, link-local and reserved IPv4 addresses; null for what is no address."""
    parts = F.transform(F.split(ip, r"\."), lambda p: p.try_cast("int"))
    a, b = parts[0], parts[1]
    good = (F.size(parts) == 4) & F.forall(parts, lambda p: p.between(0, 255))
    return F.when(good, a.isin(0, 10, 127) | (a >= 224) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127)))
