"""Selector knowledge: confidence, lifecycle, promotion, fallbacks, stability, candidates, capability tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify
from ..sources.shared import written

#: Priors, lifecycle days, promotion rules.
PRIOR_SUCCESS, PRIOR_FAILURE, RECENT_FAILURE = 2, 1, 0.95
STALE_DAYS, EXPIRY_DAYS, PROMOTION_RATE, PROMOTION_TRIES = 30, 90, 0.8, 5
#: Attributes by stability, in order of preference.
STABLE_ATTRIBUTES = (
    ("data-testid", "very_high", 0.99), ("data-test-id", "very_high", 0.99), ("data-cy", "very_high", 0.99), ("data-test", "very_high", 0.98), ("data-qa", "very_high", 0.98),
    ("id", "high", 0.90), ("name", "high", 0.92), ("aria-label", "medium", 0.85), ("aria-labelledby", "medium", 0.85), ("role", "medium", 0.80), ("type", "medium", 0.85),
    ("href", "medium", 0.75), ("placeholder", "medium", 0.70), ("data-action", "high", 0.88), ("data-controller", "high", 0.88),
)
SPECIFICITY = {"very_high": 100, "high": 80, "medium": 50, "low": 30, "very_low": 10}
FALLBACK_FACTOR, GLOBAL_CONFIDENCE = 0.8, 0.3


def confidence(success: Column, failure: Column, last_success: Column, last_failure: Column) -> Column:
    """(s + 2) / (n + 3), times 0.95 where the last failure is newer than the last success."""
    base = (success + PRIOR_SUCCESS) / (success + failure + PRIOR_SUCCESS + PRIOR_FAILURE)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), base * F.when(last_failure > last_success, RECENT_FAILURE).otherwise(1.0)))


def reliability(success: Column, failure: Column, conf: Column) -> Column:
    weight = F.least(F.lit(1.0), (success + failure) / 20.0)
    return 0.5 * (1 - weight) + conf * weight


def success_rate(success: Column, failure: Column) -> Column:
    return F.coalesce(F.try_divide(success, success + failure), F.lit(0.5))


def lifecycle(last_used: Column, created: Column, as_of) -> Column:
    """fresh, stale (30 whole days unused) or expired (90)."""
    days = F.timestamp_diff("DAY", F.coalesce(last_used, created), F.lit(as_of).cast("timestamp"))
    return F.when(days >= EXPIRY_DAYS, "expired").when(days >= STALE_DAYS, "stale").otherwise("fresh")


def from_events(events: DataFrame) -> DataFrame:
    """Selectors with counters, confidence and reliability from events (site, purpose, selector, ts, success)."""
    good, at = F.count_if("success"), lambda ok: F.max(F.when(F.col("success") == ok, F.col("ts")))
    counted = events.groupBy("site", "purpose", "selector").agg(good.alias("success"), F.count_if(~F.col("success")).alias("failure"), at(True).alias("last_success"), at(False).alias("last_failure"), F.max("ts").alias("last_used"), F.min("ts").alias("created_at"))
    scored = counted.withColumn("confidence", confidence(F.col("success"), F.col("failure"), F.col("last_success"), F.col("last_failure")))
    return scored.withColumn("reliability", reliability(F.col("success"), F.col("failure"), F.col("confidence")))


def lifecycle_report(selectors: DataFrame, as_of) -> DataFrame:
    state = lifecycle(F.col("last_used"), F.col("created_at"), as_of)
    found = selectors.withColumn("_s", state).agg(F.count(F.lit(1)).alias("selectors"), F.count_if(F.col("_s") == "stale").alias("stale"), F.count_if(F.col("_s") == "expired").alias("expired"), F.count_if(F.col("confidence") < 0.5).alias("low"), F.avg("confidence").alias("avg_confidence"), F.countDistinct("site").alias("sites"))
    rules = F.array_compact(F.array(F.when(F.col("expired") > 0, "remove_expired"), F.when((F.col("stale") > 0) & (F.col("stale") > F.col("selectors") * 0.2), "revalidate_stale"), F.when((F.col("low") > 0) & (F.col("low") > F.col("selectors") * 0.1), "review_low")))
    return found.withColumn("rules", F.when(F.size(rules) == 0, F.array(F.lit("healthy"))).otherwise(rules))


def promotions(primary: DataFrame, alternatives: DataFrame) -> DataFrame:
    """(site, purpose, selector, promoted): the best alternative of five tries or more, above 0.8 and the primary.

    ``alternatives`` has (site, purpose, alternative, success, failure, pos); equal rates go by position.
    """
    rated = alternatives.filter(F.col("success") + F.col("failure") >= PROMOTION_TRIES).withColumn("_r", F.col("success") / (F.col("success") + F.col("failure"))).filter(F.col("_r") > PROMOTION_RATE)
    own = primary.select("site", "purpose", "selector", success_rate(F.col("success"), F.col("failure")).alias("_p"))
    better = rated.drop("success", "failure").join(own, ["site", "purpose"]).filter(F.col("_r") > F.col("_p"))
    first = Window.partitionBy("site", "purpose").orderBy(F.desc("_r"), "pos")
    return better.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("site", "purpose", "selector", F.col("alternative").alias("promoted"))


def promote(primary: DataFrame, alternatives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after every due promotion: the alternative becomes primary with its counters, the old one first
    alternative."""
    due = promotions(primary, alternatives)
    key = ["site", "purpose"]
    new = due.join(alternatives, (due.site == alternatives.site) & (due.purpose == alternatives.purpose) & (due.promoted == alternatives.alternative)).select(due.site, due.purpose, F.col("promoted").alias("selector"), "success", "failure")
    swapped = primary.select(*key, "selector", "success", "failure").join(due.select(*key), key, "left_anti").unionByName(new)
    back = primary.join(due.select(*key), key, "left_semi").select(*key, F.col("selector").alias("alternative"), "success", "failure", F.lit(-1).cast("long").alias("pos"))
    rest = alternatives.select(*key, "alternative", "success", "failure", F.col("pos").cast("long").alias("pos")).join(due.select(*key, F.col("promoted").alias("alternative")), [*key, "alternative"], "left_anti")
    return swapped, rest.unionByName(back)


def fallbacks(primary: DataFrame, alternatives: DataFrame, patterns: DataFrame) -> DataFrame:
    """(site, purpose, selector, confidence), best first: primary, its alternatives at 0.8, global ones at 0.3."""
    own = primary.select("site", "purpose", "selector", "confidence", F.lit(0).alias("_o"))
    alt = primary.select("site", "purpose", (F.col("confidence") * FALLBACK_FACTOR).alias("confidence")).join(alternatives.select("site", "purpose", F.col("alternative").alias("selector")), ["site", "purpose"]).select("site", "purpose", "selector", "confidence", F.lit(1).alias("_o"))
    sites = primary.select("site", "purpose").distinct()
    common = sites.join(patterns, "purpose").select("site", "purpose", "selector", F.lit(GLOBAL_CONFIDENCE).alias("confidence"), F.lit(2).alias("_o"))
    every = own.unionByName(alt).unionByName(common.join(own.unionByName(alt).select("site", "purpose", "selector"), ["site", "purpose", "selector"], "left_anti"))
    return every.orderBy("site", "purpose", F.desc("confidence"), "_o", "selector").drop("_o")


def cleanup(selectors: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """(kept, archived) by expiry."""
    state = lifecycle(F.col("last_used"), F.col("created_at"), as_of)
    return selectors.filter(state != "expired"), selectors.filter(state == "expired")


def stability(selector: Column) -> Column:
    """struct(stability, confidence) of a selector from its shape."""
    pick = lambda s, c: F.struct(F.lit(s).alias("stability"), F.lit(float(c)).alias("confidence"))
    value = F.regexp_extract(selector, r"^[#.]([^\[.]*)", 1)
    attr, named = F.regexp_extract(selector, r"\[([^=]+)=", 1), None
    for name, level, conf in STABLE_ATTRIBUTES:
        named = F.when(attr == name, pick(level, conf)) if named is None else named.when(attr == name, pick(level, conf))
    dynamic = classify.is_dynamic_value(value)
    return (
        F.when(selector.rlike("data-testid|data-cy|data-test"), pick("very_high", 0.98))
        .when(F.startswith(selector, F.lit("#")), F.when(dynamic, pick("low", 0.4)).otherwise(pick("high", 0.9)))
        .when(F.startswith(selector, F.lit(".")), F.when(dynamic, pick("very_low", 0.3)).otherwise(pick("medium", 0.6)))
        .when(F.contains(selector, F.lit("[")), named.otherwise(pick("medium", 0.5)))
        .otherwise(pick("medium", 0.5))
    )


def stable_candidates(elements: DataFrame) -> DataFrame:
    """(element, selector, attribute, stability, confidence, rank) of elements (element, tag, attributes map, text).

    Generated values lose very high and high attributes and halve the others; up to three classes and short texts
    follow.
    """
    rules = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(s).alias("s"), F.lit(c).alias("c"), F.lit(i).alias("i")) for i, (a, s, c) in enumerate(STABLE_ATTRIBUTES)])
    by_attr = elements.select("element", "attributes", F.explode(rules).alias("r")).select("element", "r.*", F.try_element_at("attributes", F.col("r.a")).alias("v")).filter("v is not null")
    dynamic = classify.is_dynamic_value(F.col("v"))
    kept = by_attr.withColumn("d", dynamic).filter(~(F.col("d") & F.col("s").isin("very_high", "high")))
    selector = F.when((F.col("a") == "id") & ~F.col("d"), F.concat(F.lit("#"), "v")).otherwise(F.concat(F.lit("["), "a", F.lit('="'), "v", F.lit('"]')))
    first = kept.select("element", selector.alias("selector"), F.col("a").alias("attribute"), F.col("s").alias("stability"), F.when(F.col("d"), F.col("c") * 0.5).otherwise(F.col("c")).alias("confidence"), "i")
    names = F.slice(F.filter(F.array_remove(F.split(F.coalesce(F.try_element_at("attributes", F.lit("class")), F.lit("")), r"\s+"), ""), lambda c: ~classify.is_dynamic_value(c)), 1, 3)
    by_class = elements.select("element", F.posexplode(names).alias("p", "c"))
    semantic = F.col("c").rlike("(?i)^((btn|button|input|form|nav|header|footer|main|article|section)|(container|wrapper|content|sidebar|menu|modal|dialog)|(primary|secondary|success|danger|warning|info)|(active|disabled|hidden|visible|selected|checked))")
    second = by_class.select("element", F.concat(F.lit("."), "c").alias("selector"), F.lit("class").alias("attribute"), F.when(semantic, "medium").otherwise("low").alias("stability"), F.when(semantic, 0.7).otherwise(0.5).alias("confidence"), (F.col("p") + 100).alias("i"))
    text = F.trim(F.coalesce("text", F.lit("")))
    worded = elements.filter((text != "") & (F.length(text) < 50) & F.col("tag").isin("button", "a", "label", "span"))
    third = worded.select("element", F.concat("tag", F.lit(':has-text("'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('")')).alias("selector"), F.lit("text").alias("attribute"), F.lit("medium").alias("stability"), F.lit(0.75).alias("confidence"), F.lit(200).alias("i"))
    order = Window.partitionBy("element").orderBy(F.desc("confidence"), "i")
    return first.unionByName(second).unionByName(third).withColumn("rank", F.row_number().over(order)).drop("i")


def best_selector(stored: DataFrame, generated: DataFrame) -> DataFrame:
    """(element, selector): the stored one above 0.5 confidence, else the first generated."""
    first = generated.filter("rank = 1").select("element", F.col("selector").alias("_g"))
    joined = first.join(stored.select("element", F.col("selector").alias("_s"), F.col("confidence").alias("_c")), "element", "full_outer")
    return joined.select("element", F.coalesce(F.when(F.col("_c") > 0.5, F.col("_s")), "_g").alias("selector"))


def missing_capabilities(capabilities: DataFrame) -> DataFrame:
    """(engine, missing): what others of the chosen engines can do and it cannot; engines without gaps are left out."""
    known = capabilities.agg(F.collect_set("capability").alias("_all")).withColumn("_k", F.lit(1))
    own = capabilities.groupBy("engine").agg(F.collect_set("capability").alias("_own")).withColumn("_k", F.lit(1))
    return own.join(F.broadcast(known), "_k").select("engine", F.array_sort(F.array_except("_all", "_own")).alias("missing")).filter(F.size("missing") > 0)


def engine_discrepancies(results: DataFrame) -> DataFrame:
    """(url, engine, kind) where an engine differs from the first (by pos): success, or data where both succeed."""
    first = Window.partitionBy("url").orderBy("pos")
    rows = results.withColumn("_n", F.row_number().over(first)).withColumn("_s", F.first("success").over(first)).withColumn("_d", F.first("data").over(first)).filter("_n > 1")
    kind = F.when(F.col("success") != F.col("_s"), "success").when(F.col("success") & F.col("_s") & (F.col("data") != F.col("_d")), "data")
    return rows.select("url", "engine", kind.alias("kind")).filter("kind is not null")


def engine_verdicts(results: DataFrame) -> DataFrame:
    return results.groupBy("url").agg(F.bool_and("success").alias("all_passed"), F.count(F.lit(1)).alias("engines"))


#: Patterns that a URL meets at once.
PATTERN_BLOCK = 256


def page_profiles(pages: DataFrame, patterns: DataFrame) -> DataFrame:
    """(url, profile): the first pattern (pattern, profile, pos) that matches at the start of each URL.

    The patterns go to the URLs in blocks of ``PATTERN_BLOCK`` places, so URLs are multiplied by blocks, not patterns;
    a single block, the usual case, is one row that every task gets.
    """
    block = F.floor(F.col("pos") / PATTERN_BLOCK)
    keyed = lambda rows: rows.withColumn("_k", F.lit(1))
    blocks = written(patterns.groupBy(block.alias("_b")).agg(F.array_sort(F.collect_list(F.struct("pos", "pattern", "profile"))).alias("_p")), "patterns")
    hit = F.get(F.filter("_p", lambda p: F.regexp_like(F.col("url"), F.concat(F.lit("^(?:"), p["pattern"], F.lit(")")))), F.lit(0))
    if blocks.count() <= 1:
        return keyed(pages.select("url")).join(F.broadcast(keyed(blocks)), "_k", "left").select("url", hit["profile"].alias("profile"))
    listed = blocks.agg(F.collect_list("_b").alias("_all"))  # numbers only
    spread = keyed(pages.select("url").distinct()).join(F.broadcast(keyed(listed)), "_k").select("url", F.explode("_all").alias("_b"))
    found = spread.join(blocks, "_b").select("url", hit.alias("_h")).filter("_h is not null").groupBy("url").agg(F.min("_h").alias("_h"))
    return pages.select("url").join(found, "url", "left").select("url", F.col("_h.profile").alias("profile"))


def profile_visits(visits: DataFrame) -> DataFrame:
    """(site, page, visits, last_seen) of a visit log."""
    return visits.groupBy("site", "page").agg(F.count(F.lit(1)).alias("visits"), F.max("ts").alias("last_seen"))


def profile_hash(profile: Column) -> Column:
    """Sixteen hex digits of a struct's canonical JSON."""
    return F.substring(F.sha2(F.to_json(profile), 256), 1, 16)


def framework_of(sites: DataFrame, overrides: DataFrame) -> DataFrame:
    """(site, framework): the override where there is one, else what was detected in ``sites`` (site, html)."""
    found = sites.select("site", classify.framework(F.col("html"))["framework"].alias("_f"))
    return found.join(overrides.select("site", F.col("framework").alias("_o")), "site", "left").select("site", F.coalesce("_o", "_f").alias("framework"))


def specificity(level: Column) -> Column:
    out = None
    for name, value in SPECIFICITY.items():
        out = F.when(level == name, value) if out is None else out.when(level == name, value)
    return out


def reanalyse(current: DataFrame, candidates: DataFrame) -> DataFrame:
    """(element, selector, action) of stored selectors (element, selector): keep, replace by the best candidate with
    more confidence, or review where an unstable one has no better."""
    judged = current.withColumn("_s", stability(F.col("selector")))
    best = candidates.groupBy("element").agg(F.max_by(F.struct("selector", "confidence"), "confidence").alias("_b"))
    joined = judged.join(best, "element", "left")
    weak = F.col("_s.stability").isin("low", "very_low")
    better = F.coalesce(F.col("_b.confidence") > F.col("_s.confidence"), F.lit(False))
    action = F.when(~weak, "keep").when(better, "replace").otherwise("review")
    return joined.select("element", F.when(weak & better, F.col("_b.selector")).otherwise(F.col("selector")).alias("selector"), action.alias("action"))


#: Selectors that a framework's components commonly answer to, by purpose.
FRAMEWORK_SELECTORS = {
    "react": {
        "submit_button": ("[data-testid='submit']", "button[type='submit']", "[role='button'][type='submit']"),
        "input_field": ("[data-testid='input']", "input[name]", "[role='textbox']"),
        "form": ("form[data-testid]", "form[name]", "[role='form']"),
    },
    "vue": {
        "submit_button": ("[data-cy='submit']", "button[type='submit']", ".v-btn[type='submit']"),
        "input_field": ("[data-cy='input']", ".v-text-field input", "input[name]"),
    },
}


def framework_patterns(sites: DataFrame) -> DataFrame:
    """(site, purpose, selector, pos): the common selectors of each site's framework (site, framework)."""
    rows = [(f, p, s, i) for f, purposes in FRAMEWORK_SELECTORS.items() for p, listed in purposes.items() for i, s in enumerate(listed)]
    known = sites.sparkSession.createDataFrame(rows, "framework string, purpose string, selector string, pos int")
    return sites.join(F.broadcast(known), "framework").select("site", "purpose", "selector", "pos")


def stored_selectors(candidates: DataFrame) -> DataFrame:
    """(element, selector, confidence, alternatives) to keep of ranked candidates (element, selector, confidence,
    rank, dynamic): the first that is not generated, and what else is not among ranks two to four."""
    kept = candidates.filter(~F.col("dynamic"))
    listed = kept.groupBy("element").agg(F.min_by(F.struct("selector", "confidence"), "rank").alias("s"), F.array_sort(F.collect_list(F.when(F.col("rank").between(2, 4), F.struct("rank", "selector")))).alias("a"))
    others = F.filter(F.transform("a", lambda x: x["selector"]), lambda x: x != F.col("s.selector"))
    return listed.select("element", "s.selector", "s.confidence", others.alias("alternatives"))


def library_statistics(library: DataFrame, frameworks: DataFrame) -> DataFrame:
    """One row: sites, selectors, their mean confidence, and the sites of each framework as a map."""
    counted = library.agg(F.countDistinct("site").alias("sites"), F.count(F.lit(1)).alias("selectors"), F.avg("confidence").alias("confidence"))
    by = frameworks.groupBy("framework").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("framework", "n")))).alias("frameworks"))
    return counted.withColumn("_k", F.lit(1)).join(by.withColumn("_k", F.lit(1)), "_k").drop("_k")
