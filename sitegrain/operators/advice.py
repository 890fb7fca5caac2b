"""Recommendation text: scored lines, claims against metrics, rule tables, cached prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify
from ..thresholds import DEFAULTS, Thresholds

_NUMBER = r"(\d+(?:\.\d+)?)"
_SCORED = rf"\[I:{_NUMBER}\s*C:{_NUMBER}\s*E:{_NUMBER}\s*=\s*ICE:{_NUMBER}\]\s*([^\n]+)"
_UNSCORED = rf"\[I:{_NUMBER}\s*C:{_NUMBER}\s*E:{_NUMBER}\]\s*([^\n]+)"
#: Words of a claim and the metric they mean; the first that is contained wins.
CLAIMS = (
    ("missing meta description", "missing_meta_descriptions"), ("missing description", "missing_meta_descriptions"), ("missing title", "missing_titles"), ("duplicate title", "duplicate_titles"),
    ("missing h1", "missing_h1"), ("multiple h1", "multiple_h1"), ("without alt", "images_without_alt"), ("slow", "slow_pages"), ("thin content", "thin_content"), ("canonical", "missing_canonical"),
    ("broken link", "broken_links"), ("orphan", "orphan_pages"),
)


def scored_lines(responses: DataFrame, key: str = "id", text: str = "response") -> DataFrame:
    """(key, pos, action, impact, confidence, ease, ice, tier, quick_win) of every ``[I:x C:y E:z = ICE:v] text``.

    Where a response has none, lines without the ICE part count and it is x * y * z / 100.
    """

    def parts(pattern, n):
        found = [F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(i + 1)) for i in range(n)]
        return F.arrays_zip(*[f.alias(f"g{i}") for i, f in enumerate(found)])

    scored = F.transform(parts(_SCORED, 5), lambda x: F.struct(x["g0"].cast("double").alias("impact"), x["g1"].cast("double").alias("confidence"), x["g2"].cast("double").alias("ease"), x["g3"].cast("double").alias("ice"), F.trim(x["g4"]).alias("action")))
    plain = F.transform(parts(_UNSCORED, 4), lambda x: F.struct(x["g0"].cast("double").alias("impact"), x["g1"].cast("double").alias("confidence"), x["g2"].cast("double").alias("ease"), (x["g0"].cast("double") * x["g1"].cast("double") * x["g2"].cast("double") / 100).alias("ice"), F.trim(x["g3"]).alias("action")))
    rows = responses.select(key, F.posexplode(F.when(F.size(scored) > 0, scored).otherwise(plain)).alias("pos", "s")).select(key, "pos", "s.*")
    return rows.withColumn("tier", classify.ice_tier(F.col("ice"))).withColumn("quick_win", (F.col("ease") >= 7) & (F.col("impact") >= 7))


def check_claims(responses: DataFrame, metrics: DataFrame, total_pages: int, key: str = "id", text: str = "response") -> DataFrame:
    """(key, kind, claimed, actual, metric, holds): counts must be equal, percentages within one point.

    ``metrics`` (metric, pages) lacks what is 0.
    """
    count = r"(?i)(\d+)\s*(?:pages?|urls?)\s+(?:with|have|having|missing|without)\s+([a-z\s]+)"
    percent = r"(?i)(\d+(?:\.\d+)?)\s*%\s+(?:of\s+)?(?:pages?|urls?)\s+(?:with|have|having)\s+([a-z\s]+)"

    def found(kind, pattern):
        pairs = F.arrays_zip(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(2)))
        return responses.select(key, F.lit(kind).alias("kind"), F.explode(pairs).alias("p")).select(key, "kind", F.col("p.0").cast("double").alias("claimed"), F.lower("p.1").alias("words"))

    metric = None
    for words, name in CLAIMS:
        test = F.contains(F.col("words"), F.lit(words))
        metric = F.when(test, name) if metric is None else metric.when(test, name)
    claims = found("count", count).unionByName(found("percentage", percent)).withColumn("metric", metric).filter("metric is not null")
    known = metrics.filter(F.col("metric").isin(*{name for _, name in CLAIMS}))  # a dozen rows at most
    joined = claims.join(F.broadcast(known), "metric", "left").withColumn("pages", F.coalesce("pages", F.lit(0)))
    share = F.col("pages") * 100.0 / total_pages if total_pages else F.lit(0.0)
    actual = F.when(F.col("kind") == "count", F.col("pages").cast("double")).otherwise(share)
    holds = F.when(F.col("kind") == "count", F.col("claimed") == F.col("pages")).otherwise(F.abs(F.col("claimed") - share) <= 1.0)
    return joined.select(key, "kind", "claimed", actual.alias("actual"), "metric", holds.alias("holds"))


def _rules(*pairs) -> Column:
    return F.array_compact(F.array(*[F.when(test, name) for name, test in pairs]))


def resource_rules() -> Column:
    """Rule names that hold for a row of ``site.resource_summary``."""
    c = F.col
    return _rules(("image_share", c("image_share") > 50), ("heavy_images", c("heavy_images") > 0), ("js_share", c("js_share") > 30), ("heavy_js", c("heavy_js") > 0), ("heavy_css", c("heavy_css") > 0), ("bloated", c("bloated") > 0), ("avg_weight", c("avg_bytes") / 1024 > 1500))


def image_rules() -> Column:
    c = F.col
    return _rules(("modern_formats", c("modern_share") < 50), ("dimensions", c("without_dimensions") > 0), ("lazy_loading", c("should_be_lazy") > 0), ("alt_text", c("alt_share") < 90), ("savings", c("saving") > 500 * 1024))


def redirect_rules(pages: Column) -> Column:
    c = F.col
    return _rules(("three_plus", c("three_plus") > 0), ("time", c("ms") > 1000), ("many_pages", (pages > 0) & (c("chains") > pages * 0.1)), ("long", c("longest") > 4))


def third_party_rules(analytics: Column, advertising: Column, t: Thresholds = DEFAULTS) -> Column:
    return _rules(("share", F.col("share") > t.third_party_share), ("requests", F.col("avg_requests") > t.third_party_requests), ("analytics", analytics > 2), ("advertising", advertising > 5))


def lab_field_rules() -> Column:
    c = F.col
    return F.when(c("pages") == 0, F.array(F.lit("no_common_pages"))).otherwise(_rules(("optimistic", c("tendency") == "optimistic"), ("pessimistic", c("tendency") == "pessimistic"), ("mismatches", c("mismatches") > 0)))


def vitals_rules() -> Column:
    c = F.col
    return _rules(("lcp", c("lcp").isin("needs-improvement", "poor")), ("inp", c("inp").isin("needs-improvement", "poor")), ("cls", c("cls").isin("needs-improvement", "poor")))


def crawlability_rules() -> Column:
    c = F.col
    return _rules(("create_robots", ~c("has_robots")), ("fix_robots", c("has_robots") & (c("robots_errors") > 0)), ("create_sitemap", ~c("has_sitemap")), ("verify_sitemaps", c("has_sitemap")), ("name_sitemap", ~c("has_sitemap")), ("link_orphans", c("orphans") > 0), ("fix_links", c("broken") > 0), ("efficiency", c("efficiency") < 70))


def _say(*pairs) -> Column:
    """The texts whose rule holds, filled with the measured values; a pair is (rule, text, values)."""
    return F.array_compact(F.array(*[F.when(test, F.format_string(text, *values)) for test, text, values in pairs]))


def resource_advice(t: Thresholds = DEFAULTS) -> Column:
    """What to do about the weight of a site, for a row of ``site.resource_summary``."""
    c, kb, mb = F.col, 1024, 1024 * 1024
    return _say(
        (c("image_share") > 50, "Images make up %.1f%% of all bytes: serve WebP or AVIF and load images lazily.", [c("image_share")]),
        (c("heavy_images") > 0, f"%d pages load more than {t.image_bytes / mb:.1f} MB of images: resize and compress them.", [c("heavy_images")]),
        (c("js_share") > 30, "Scripts make up %.1f%% of all bytes: split bundles and defer what is not needed at first.", [c("js_share")]),
        (c("heavy_js") > 0, f"%d pages load more than {t.js_bytes // kb} KB of scripts: look for code that is never used.", [c("heavy_js")]),
        (c("heavy_css") > 0, f"%d pages load more than {t.css_bytes // kb} KB of styles: drop unused rules, inline the critical ones.", [c("heavy_css")]),
        (c("bloated") > 0, f"%d pages weigh more than {t.page_bytes / mb:.1f} MB and will be slow on mobile networks.", [c("bloated")]),
        (c("avg_bytes") / kb > 1500, "A page weighs %.0f KB on average, above 1500 KB: begin with the largest kind.", [c("avg_bytes") / kb]),
    )


def image_advice(t: Thresholds = DEFAULTS) -> Column:
    """What to do about images, for a row of ``site.image_summary``."""
    c = F.col
    return _say(
        (c("modern_share") < 50, f"%.1f%% of images are in a modern format: converting the others saves about {t.modern_saving * 100:.0f}%%.", [c("modern_share")]),
        (c("without_dimensions") > 0, "%d images have no width or height: give them both, so that the layout does not shift.", [c("without_dimensions")]),
        (c("should_be_lazy") > 0, f"About %d images come after the first {t.lazy_position} of their page and are not lazy: add loading=lazy.", [c("should_be_lazy")]),
        (c("alt_share") < 90, "%.1f%% of images have an alternative text: write one for the rest.", [c("alt_share")]),
        (c("saving") > 500 * 1024, "Modern formats would save about %.0f KB, %.1f%% of all image bytes.", [c("saving") / 1024, c("saving_share")]),
    )


def redirect_advice(pages: Column, t: Thresholds = DEFAULTS) -> Column:
    """What to do about redirects, for a row of ``site.redirect_summary``; ``pages`` are all pages of the crawl."""
    c = F.col
    return _say(
        (c("three_plus") > 0, f"%d chains have {t.long_chain} hops or more: redirect once, to the last address.", [c("three_plus")]),
        (c("ms") > 1000, f"Redirects cost about %.1f seconds in all, at {t.redirect_ms} ms a hop: link to the last address.", [c("ms") / 1000]),
        ((pages > 0) & (c("chains") > pages * 0.1), "%.0f%% of pages are redirected: look at how addresses are made.", [c("chains") * 100.0 / pages]),
        (c("longest") > 4, "The longest chain has %d hops: mend it first.", [c("longest")]),
    )


def third_party_advice(analytics: Column, advertising: Column, t: Thresholds = DEFAULTS) -> Column:
    """What to do about third parties, for a row of ``site.third_party_summary`` and numbers of domains."""
    c = F.col
    return _say(
        (c("share") > t.third_party_share, f"Third parties make up %.1f%% of all bytes, above {t.third_party_share:.0f}%%: host the important ones yourself.", [c("share")]),
        (c("avg_requests") > t.third_party_requests, f"A page makes %.1f requests to third parties, above {t.third_party_requests}: join or defer them.", [c("avg_requests")]),
        (analytics > 2, "%d analytics services are in use: keep fewer.", [analytics]),
        (advertising > 5, "%d advertising services are in use: load them late.", [advertising]),
    )


def lab_field_advice() -> Column:
    """What a comparison of laboratory and field says, for a row with pages (that have both), tendency, mismatches, and
    value and status of lab_lcp, field_lcp, lab_tbt and field_fid."""
    c, known = F.col, lambda a, b: F.col(f"{a}_status").isNotNull() & F.col(f"{b}_status").isNotNull()
    differ = lambda a, b: known(a, b) & (c(f"{a}_status") != c(f"{b}_status"))
    both = lambda a, b: [c(f"{a}_status"), c(a), c(f"{b}_status"), c(b)]
    said = _say(
        (c("tendency") == "optimistic", "On %d pages the laboratory is faster than visitors find it: slow networks and weak devices are missing there.", [c("pages")]),
        (c("tendency") == "pessimistic", "On %d pages visitors find it faster than the laboratory: caches or a delivery network serve them.", [c("pages")]),
        (c("mismatches") > 0, "%d of %d pages differ in status between laboratory and field: begin with them.", [c("mismatches"), c("pages")]),
        (differ("lab_lcp", "field_lcp"), "Largest contentful paint is %s in the laboratory (%.0f ms) and %s in the field (%.0f ms).", both("lab_lcp", "field_lcp")),
        (differ("lab_tbt", "field_fid"), "Blocking time is %s in the laboratory (%.0f ms) and input delay %s in the field (%.0f ms): scripts run there that the laboratory does not see.", both("lab_tbt", "field_fid")),
    )
    return F.when(c("pages") == 0, F.array(F.lit("No page has both laboratory and field data: measure more pages, or wait for visitors."))).otherwise(said)


def vitals_advice() -> Column:
    """What to do about a page's vitals, for a row with lcp, inp and cls (statuses), lcp_seconds, lcp_candidates,
    blocking_scripts, cls_risks, render_blocking and lazy_opportunities."""
    c, bad = F.col, lambda m: F.col(m).isin("needs-improvement", "poor")
    return _say(
        (bad("lcp") & c("lcp_seconds").isNotNull(), "Largest contentful paint is %s at about %.1f seconds: give the main image its size and preload it, in several widths.", [c("lcp"), c("lcp_seconds")]),
        (bad("lcp") & c("lcp_seconds").isNull(), "Largest contentful paint is %s by its %d candidates: give the main image its size and preload it, in several widths.", [c("lcp"), c("lcp_candidates")]),
        (bad("inp"), "Interaction is %s with %d scripts in its way: load them with async or defer, and cut long tasks.", [c("inp"), c("blocking_scripts")]),
        (bad("cls"), "Layout shift is %s with %d elements that may move: give images and frames their size, and keep room for what comes late.", [c("cls"), c("cls_risks")]),
        (c("render_blocking") > 0, "%d resources hold up rendering: inline the critical ones and load the rest later.", [c("render_blocking")]),
        (c("lazy_opportunities") > 0, "%d images could be loaded lazily.", [c("lazy_opportunities")]),
    )


def crawlability_advice() -> Column:
    """What to do about crawling, for a row of ``site_files.crawlability`` with a column ``sitemaps``."""
    c = F.col
    return _say(
        (~c("has_robots"), "Put a robots.txt at the root of the host.", []),
        (c("has_robots") & (c("robots_errors") > 0), "Mend %d errors of robots.txt.", [c("robots_errors")]),
        (~c("has_sitemap"), "Write a sitemap and submit it to search engines.", []),
        (c("has_sitemap"), "Make sure that all %d sitemaps can be fetched and are valid.", [c("sitemaps")]),
        (~c("has_sitemap"), "Name the sitemap in robots.txt.", []),
        (c("orphans") > 0, "Link to %d pages that nothing links to, or list them in the sitemap.", [c("orphans")]),
        (c("broken") > 0, "Mend %d broken links.", [c("broken")]),
        (c("efficiency") < 70, "Crawls waste requests: mend broken links and redirects first.", []),
    )


def by_ice(scored: DataFrame) -> DataFrame:
    """:func:`scored_lines` by falling ICE; of equal ones the earlier line first."""
    return scored.orderBy(F.desc("ice"), "pos")


def prompt_key(prompt: Column, context: Column) -> Column:
    """SHA-256 of a prompt and its canonical context."""
    return F.sha2(F.concat(prompt, F.coalesce(context, F.lit(""))), 256)


def prompt_hash(prompt: Column) -> Column:
    return F.substring(F.sha2(prompt, 256), 1, 16)


def cache_statistics(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("hit_count"), F.lit(0)).alias("hits"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def similar_prompts(cache: DataFrame, prompt: str, n: int = 5) -> DataFrame:
    """Entries whose prompt hash shares the first eight digits, most used first."""
    return cache.filter(F.substring("prompt_hash", 1, 8) == F.substring(F.sha2(F.lit(prompt), 256), 1, 8)).orderBy(F.desc("hit_count"), "key").limit(n)


def put_cache(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """``cache`` with ``entries`` in place of rows of the same key; of several the newest stays."""
    both = cache.withColumn("_o", F.lit(0)).unionByName(entries.withColumn("_o", F.lit(1)))
    order = Window.partitionBy("key").orderBy(F.desc("_o"), F.desc("created_at"))
    return both.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_o")


def parse_fields(response: Column, fields: tuple[str, ...]) -> Column:
    """map of the listed fields from ``key: value`` lines; the first line of a key counts."""
    lines = F.filter(F.split(response, r"\r?\n"), lambda x: x.rlike(r"^\s*[A-Za-z_]+\s*:"))
    pair = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    known = F.filter(pair, lambda p: p["k"].isin(*fields))
    keys = F.array_distinct(F.transform(known, lambda p: p["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.filter(known, lambda p: p["k"] == k)[0]["v"].alias("value"))))


def input_summary(content: Column, title: Column, description: Column, h1: Column, keywords: Column) -> Column:
    return F.struct(F.length(content).alias("content_length"), F.substring(content, 1, 1000).alias("preview"), F.length(title).alias("title_length"), F.length(description).alias("description_length"), F.slice(h1, 1, 5).alias("h1"), F.slice(keywords, 1, 10).alias("keywords"))
