"""Statistics of measured values, vitals and laboratory scores over a site."""

from __future__ import annotations

from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vitals
from ..thresholds import DEFAULTS, Thresholds


#: Approximate ranks are asked for at this accuracy, and ranges reach two of its steps to both sides of a wanted rank.
ACCURACY = 10_000
WANTED = (0.5, 0.9)


def seven_numbers(value: Column) -> list[Column]:
    """count, avg, sample stddev (0 for one value), min, max as aggregate columns.

    The median and p90, the value at index floor(0.9 n) of the sorted values, are ranks; :func:`statistics` adds them.
    """
    n = F.count(value)
    return [n.alias("count"), F.avg(value).alias("avg"), F.when(n > 1, F.stddev_samp(value)).when(n == 1, F.lit(0.0)).alias("stddev"), F.min(value).alias("min"), F.max(value).alias("max")]


def statistics(rows: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The seven numbers of ``value`` for each group; nulls are left out.

    Ranks are exact and no group is gathered or sorted whole: see :func:`near_ranks`.
    """
    groups = list(by) or ["_all"]
    agg, near = near_ranks(rows, value, by)
    inside = F.sum("_n").over(Window.partitionBy(*groups, "_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("_last", F.col("_before") + inside)
    at = lambda r: F.max(F.when((F.col("_last") - F.col("_n") <= r) & (r < F.col("_last")), F.col("_v")))
    ranks = near.groupBy(*groups).agg(*[at(r).alias(k) for k, r in _wanted().items()])
    median = (F.col("lower").cast("double") + F.col("upper").cast("double")) / 2
    found = _meet(agg, ranks.select(*groups, median.alias("median"), F.col("ninth").alias("p90")), groups)
    return found.select(*by, "count", "avg", "median", "stddev", "p90", "min", "max")


def near_ranks(rows: DataFrame, value: str, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """What :func:`seven_numbers` and approximate quantiles say of each group, and the counted values near its wanted ranks.

    Quantiles close to the wanted ranks cut a group's values into five ranges, distinct values are counted, the counts
    are summed by range, and only the ranges that hold a wanted rank remain, with what lies before them.  However
    values are spread, those are about 0.06 % of a group; should a quantile be off by more than it promises, a larger
    range remains and the ranks are right all the same.
    """
    groups = list(by) or ["_all"]
    kept = rows.filter(F.col(value).isNotNull()).withColumn("_all", F.lit(1)).select(*groups, F.col(value).alias("_v"))
    reach = 2 / ACCURACY
    cuts = F.percentile_approx("_v", [p for w in WANTED for p in (w - reach, w + reach)], ACCURACY)
    agg = kept.groupBy(*groups).agg(*seven_numbers(F.col("_v")), cuts.alias("_cuts"))
    counts = _meet(kept.groupBy(*groups, "_v").agg(F.count(F.lit(1)).alias("_n")), agg.select(*groups, F.col("count").alias("_c"), "_cuts"), groups)
    # the range from a lower cut to the upper one holds both
    past = [F.col("_v") >= F.col("_cuts")[i] if i % 2 == 0 else F.col("_v") > F.col("_cuts")[i] for i in range(2 * len(WANTED))]
    placed = counts.withColumn("_r", reduce(add, (p.cast("int") for p in past))).drop("_cuts")
    before = F.coalesce(F.sum("_m").over(Window.partitionBy(*groups).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = placed.groupBy(*groups, "_r").agg(F.sum("_n").alias("_m")).withColumn("_before", before)
    holds = reduce(or_, ((F.col("_before") <= r) & (r < F.col("_before") + F.col("_m")) for r in _wanted().values()))
    return agg, _meet(placed, ranges, [*groups, "_r"]).filter(holds)


def _wanted() -> dict[str, Column]:
    """Indexes of the wanted values in a group's sorted values, by its count."""
    return {"lower": F.floor((F.col("_c") - 1) / 2), "upper": F.floor(F.col("_c") / 2), "ninth": F.floor(F.col("_c") * 0.9)}


def _meet(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the columns of ``right`` for its keys, which may be null."""
    own = [f"_j{i}" for i in range(len(keys))]
    named = right.select(*[F.col(k).alias(j) for k, j in zip(keys, own)], *[c for c in right.columns if c not in keys])
    return left.join(named, reduce(and_, (F.col(k).eqNullSafe(F.col(j)) for k, j in zip(keys, own)))).drop(*own)


def vitals_rows(pages: DataFrame) -> DataFrame:
    """(url, lcp, inp, cls, overall): estimated statuses from load time and element counts."""
    lcp = vitals.lcp_status(F.col("load_time"), F.col("lcp_candidates"))
    rows = pages.select("url", lcp.alias("lcp"), vitals.inp_status(F.col("blocking_scripts")).alias("inp"), vitals.cls_status(F.col("cls_risks")).alias("cls"), vitals.lcp_estimate(F.col("load_time")).alias("lcp_estimate"))
    return rows.withColumn("overall", vitals.overall(F.col("lcp"), F.col("inp"), F.col("cls")))


def vitals_summary(rows: DataFrame) -> DataFrame:
    """(metric, good, middle, poor, status) of lcp, inp, cls and overall."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("s")) for m in ("lcp", "inp", "cls", "overall")])).alias("x")).select("x.*")
    counted = long.groupBy("metric").agg(F.count_if(F.col("s") == vitals.GOOD).alias("good"), F.count_if(F.col("s") == vitals.MIDDLE).alias("middle"), F.count_if(F.col("s") == vitals.POOR).alias("poor"), F.count(F.lit(1)).alias("n"))
    return counted.select("metric", "good", "middle", "poor", vitals.site_status(F.col("good"), F.col("poor"), F.col("n")).alias("status"))


def lighthouse_summary(pages: DataFrame) -> DataFrame:
    """Means over audited pages: missing scores count 0, missing and zero metrics are left out."""
    audited = pages.filter(F.col("lighthouse_performance").isNotNull())
    scores = [F.avg(F.coalesce(F.col(f"lighthouse_{s}"), F.lit(0.0))).alias(s) for s in ("performance", "accessibility", "best_practices", "seo", "pwa")]
    metrics = [F.avg(F.nullif(F.col(f"lighthouse_{m}"), F.lit(0.0))).alias(m) for m in ("fcp", "lcp", "si", "tti", "tbt", "cls")]
    found = audited.agg(F.count(F.lit(1)).alias("audited"), *scores, *metrics)
    for s in ("performance", "accessibility", "seo"):
        found = found.withColumn(f"{s}_status", vitals.score_category(F.col(s)))
    return found


def poor_pages(pages: DataFrame, below: float = 50) -> DataFrame:
    return pages.filter(F.col("lighthouse_performance") < below).select("url", "lighthouse_performance").orderBy("lighthouse_performance", "url")


def opportunity_rollup(opportunities: DataFrame, top: int = 10) -> DataFrame:
    """(id, pages, savings_ms, savings_bytes, items) by most time saved; ``opportunities`` has a row a page and id."""
    rolled = opportunities.groupBy("id").agg(F.count(F.lit(1)).alias("pages"), *[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("savings_ms", "savings_bytes", "items")])
    return rolled.orderBy(F.desc("savings_ms"), "id").limit(top)


def lab_field(pages: DataFrame, t: Thresholds = DEFAULTS, key: str = "url") -> DataFrame:
    """(key, lab, field, lab_status, field_status, gap, verdict) of pages with both measurements of lcp."""
    both = pages.filter(F.col("lighthouse_lcp").isNotNull() & F.col("crux_lcp_percentile").isNotNull())
    lab, field = F.col("lighthouse_lcp"), F.col("crux_lcp_percentile")
    gap = F.when(field > 0, (lab - field) / field * 100)
    status = lambda v: vitals.band(v, t.lcp_good, t.lcp_poor)
    return both.select(
        key, lab.alias("lab"), field.alias("field"), status(lab).alias("lab_status"), F.coalesce(vitals.field_category(F.col("crux_lcp_category")), status(field)).alias("field_status"), gap.alias("gap"),
        F.when(gap < -t.lab_field_gap, "lab_better").when(gap > t.lab_field_gap, "field_better").when(gap.isNotNull(), "match").alias("verdict"),
    )


def lab_field_summary(compared: DataFrame) -> DataFrame:
    """Totals of :func:`lab_field` and the tendency of laboratory values (a factor of 1.5 decides)."""
    count = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    found = compared.agg(F.count(F.lit(1)).alias("pages"), F.avg("lab").alias("lab"), F.avg("field").alias("field"), count("lab_better"), count("field_better"), count("match"), F.count_if(F.col("lab_status") != F.col("field_status")).alias("mismatches"))
    return found.withColumn("tendency", F.when(F.col("lab_better") > F.col("field_better") * 1.5, "optimistic").when(F.col("field_better") > F.col("lab_better") * 1.5, "pessimistic").otherwise("neutral"))
