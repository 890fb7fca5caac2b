"""Evidence rows and the confidence of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vitals

HIGH, MEDIUM, LOW, ESTIMATE = "High", "Medium", "Low", "Estimate"
COLUMNS = ("component", "finding", "url", "measured", "threshold", "operator", "unit", "severity", "confidence", "source_type", "ai_generated")


def threshold_evidence(rows: DataFrame, component: str, finding: str, measured: Column, operator: str, threshold: float, unit: str, severity: Column) -> DataFrame:
    """An evidence row for every row of ``rows`` (url) whose measurement is beyond the threshold."""
    beyond = measured > threshold if operator == ">" else measured < threshold if operator == "<" else measured >= threshold if operator == ">=" else measured <= threshold
    return rows.filter(beyond).select(
        F.lit(component).alias("component"), F.lit(finding).alias("finding"), "url", measured.cast("double").alias("measured"), F.lit(float(threshold)).alias("threshold"), F.lit(operator).alias("operator"),
        F.lit(unit).alias("unit"), severity.alias("severity"), F.lit(HIGH).alias("confidence"), F.lit("calculation").alias("source_type"), F.lit(False).alias("ai_generated"),
    )


def model_evidence(rows: DataFrame, component: str, validated: Column, cap: str = MEDIUM) -> DataFrame:
    """Evidence of model output (finding, url): no more than ``cap`` unless validated against data."""
    cap = cap if cap in (HIGH, MEDIUM, LOW) else MEDIUM
    null = F.lit(None)
    return rows.select(
        F.lit(component).alias("component"), "finding", "url", null.cast("double").alias("measured"), null.cast("double").alias("threshold"), null.cast("string").alias("operator"),
        null.cast("string").alias("unit"), F.lit("info").alias("severity"), F.when(validated, HIGH).otherwise(cap).alias("confidence"), F.lit("llm_inference").alias("source_type"), F.lit(True).alias("ai_generated"),
    )


def vitals_estimates(pages: DataFrame) -> DataFrame:
    """(url, finding, measured, status, good, poor, confidence, source_type, methodology, factors) of the vitals that are
    estimated from a page's markup and response time: an estimate a metric, never more than that.

    ``pages`` have url, load_time, lcp_candidates, blocking_scripts and cls_risks; ``factors`` are what went into it.
    Without a response time the paint is judged by its candidates and has no value.
    """
    c = F.col
    factor = lambda **values: F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("double").alias("value")) for k, v in values.items()]), lambda e: e["value"].isNotNull()))

    def estimate(name, value, status, good, poor, how, factors):
        return F.struct(F.lit(f"{name}_estimate").alias("finding"), value.cast("double").alias("measured"), status.alias("status"), F.lit(float(good)).alias("good"), F.lit(float(poor)).alias("poor"), F.lit(how).alias("methodology"), factors.alias("factors"))

    rows = F.array(
        estimate("lcp", vitals.lcp_estimate(c("load_time")), vitals.lcp_status(c("load_time"), c("lcp_candidates")), 2.5, 4.0, "response time and rendering", factor(response_seconds=c("load_time"), candidates=c("lcp_candidates"))),
        estimate("inp", c("blocking_scripts"), vitals.inp_status(c("blocking_scripts")), 0, vitals.BLOCKING_MIDDLE, "blocking scripts", factor(blocking_scripts=c("blocking_scripts"))),
        estimate("cls", c("cls_risks"), vitals.cls_status(c("cls_risks")), 0, vitals.SHIFT_MIDDLE, "elements without a size", factor(risk_elements=c("cls_risks"))),
    )
    found = pages.select("url", F.explode(rows).alias("e"))
    return found.select("url", "e.finding", "e.measured", F.coalesce("e.status", F.lit(vitals.UNKNOWN)).alias("status"), "e.good", "e.poor", F.lit(ESTIMATE).alias("confidence"), F.lit("heuristic").alias("source_type"), "e.methodology", "e.factors")


def from_issues(issues: DataFrame, component: str = "technical") -> DataFrame:
    """Evidence of technical issue rows (url, issue_type, measured, severity)."""
    null = F.lit(None)
    return issues.select(
        F.lit(component).alias("component"), F.col("issue_type").alias("finding"), "url", "measured", null.cast("double").alias("threshold"), null.cast("string").alias("operator"),
        null.cast("string").alias("unit"), "severity", F.lit(HIGH).alias("confidence"), F.lit("measurement").alias("source_type"), F.lit(False).alias("ai_generated"),
    )


def combined_confidence(evidence: DataFrame, by: tuple[str, ...] = ("component", "finding")) -> DataFrame:
    """Medium as soon as any row is a model's, else High with any High row, else Medium."""
    level = F.when(F.bool_or("ai_generated"), MEDIUM).when(F.bool_or(F.col("confidence") == HIGH), HIGH).otherwise(MEDIUM)
    return evidence.groupBy(*by).agg(F.count(F.lit(1)).alias("records"), level.alias("confidence"))


def challenge_evidence(rows: DataFrame) -> DataFrame:
    """(url, finding, severity, advice) of challenge detections (url, version, impact, blocking)."""
    severity = F.when(F.col("impact") == "high", "critical").when(F.col("impact") == "medium", "warning").otherwise("info")
    advice = F.when(F.col("blocking"), "resolve_manually").when(F.col("version") == "v3", "lower_request_rate").when(F.col("version").isNotNull(), "keep_session")
    return rows.select("url", F.concat(F.lit("challenge_"), F.coalesce("version", F.lit("unknown"))).alias("finding"), severity.alias("severity"), advice.alias("advice"))
