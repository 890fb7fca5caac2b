"""Core Web Vitals and laboratory metric bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..thresholds import DEFAULTS, Thresholds

GOOD, MIDDLE, POOR, UNKNOWN = "good", "needs-improvement", "poor", "unknown"
#: Seconds a page needs to render after its response, largest counts that are still middling.
RENDER_SECONDS, BLOCKING_MIDDLE, SHIFT_MIDDLE, CANDIDATES_MIDDLE = 0.5, 3, 5, 2
#: Good and poor bounds of laboratory metrics (milliseconds, layout shift without unit).
LAB_BANDS = {"lcp": (2500, 4000), "fcp": (1800, 3000), "tbt": (200, 600), "cls": (0.1, 0.25), "si": (3400, 5800), "tti": (3800, 7300)}


def band(value: Column, good: float, poor: float) -> Column:
    """good, needs-improvement or poor; null for null."""
    return F.when(value <= good, GOOD).when(value <= poor, MIDDLE).when(value.isNotNull(), POOR)


def lab_status(metric: str, value: Column) -> Column:
    return F.coalesce(band(value, *LAB_BANDS[metric]), F.lit(UNKNOWN))


def lcp_estimate(response_seconds: Column) -> Column:
    return F.when(response_seconds != 0, response_seconds + RENDER_SECONDS)


def lcp_status(response_seconds: Column, candidates: Column) -> Column:
    """From the response time; without one (or with 0) from the number of candidate elements."""
    return F.coalesce(band(lcp_estimate(response_seconds), 2.5, 4.0), band(candidates, 0, CANDIDATES_MIDDLE))


def inp_status(blocking_scripts: Column) -> Column:
    return band(blocking_scripts, 0, BLOCKING_MIDDLE)


def cls_status(risk_elements: Column) -> Column:
    return band(risk_elements, 0, SHIFT_MIDDLE)


def overall(*statuses: Column) -> Column:
    """The worst of the statuses; good only if all are."""
    has = lambda s: F.coalesce(F.array_contains(F.array_compact(F.array(*statuses)), s), F.lit(False))
    every = F.forall(F.array(*statuses), lambda s: s.eqNullSafe(F.lit(GOOD)))
    return F.when(has(POOR), POOR).when(has(MIDDLE), MIDDLE).when(every, GOOD).otherwise(UNKNOWN)


def measured_status(lcp: Column, fid: Column, cls: Column, t: Thresholds = DEFAULTS) -> Column:
    """struct(lcp, fid, cls) of browser measurements; a null layout shift is good, other nulls unknown."""
    unknown = F.lit(UNKNOWN)
    return F.struct(
        F.coalesce(band(lcp, t.lcp_good, t.lcp_poor), unknown).alias("lcp"),
        F.coalesce(band(fid, t.fid_good, t.fid_poor), unknown).alias("fid"),
        band(F.coalesce(cls, F.lit(0.0)), t.cls_good, t.cls_poor).alias("cls"),
    )


def ttfb_status(ms: Column, t: Thresholds = DEFAULTS) -> Column:
    return F.coalesce(band(ms, t.ttfb_good, t.ttfb_poor), F.lit(UNKNOWN))


def total_blocking_time(durations: Column) -> Column:
    """Sum of what every long task takes over 50 ms."""
    return F.aggregate(durations, F.lit(0.0), lambda n, d: n + F.greatest(F.lit(0.0), d.cast("double") - 50))


def field_category(category: Column) -> Column:
    """FAST, AVERAGE, SLOW of field data as a status; null for anything else."""
    c = F.upper(category)
    return F.when(c == "FAST", GOOD).when(c == "AVERAGE", MIDDLE).when(c == "SLOW", POOR)


def site_status(good: Column, poor: Column, total: Column) -> Column:
    """good above 75 % good pages, else poor above 25 % poor pages."""
    return F.when(good > total * 0.75, GOOD).when(poor > total * 0.25, POOR).otherwise(MIDDLE)


def score_category(score: Column) -> Column:
    return F.when(score >= 90, GOOD).when(score >= 50, MIDDLE).otherwise(POOR)
