"""Page scores: security, mobile, international, social, structured data, crawlability, resources, images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls

#: Points of https and of each response header.
HTTPS_POINTS = 40
HEADER_POINTS = {"strict-transport-security": 20, "content-security-policy": 20, "x-content-type-options": 10, "x-frame-options": 10, "x-xss-protection": 0}
#: Headers whose coverage a site reports.
REPORTED_HEADERS = ("strict-transport-security", "x-content-type-options", "x-frame-options", "content-security-policy")
#: Language codes that count as valid.
LANGUAGES = "en es fr de it pt nl ru ja zh ko ar hi th vi id ms pl uk cs ro hu el sv da fi no tr he fa bn ta te".split()
#: Social properties and their points.
OG_REQUIRED, OG_RECOMMENDED = ("og:title", "og:description", "og:image", "og:url", "og:type"), ("og:site_name", "og:locale")
TWITTER_REQUIRED, TWITTER_RECOMMENDED = ("twitter:card", "twitter:title", "twitter:description"), ("twitter:image", "twitter:site")
TWITTER_CARDS = ("summary", "summary_large_image", "app", "player")
OG_POINTS, TWITTER_POINTS = (15, 5, 5), (25, 10, -10)
#: Image formats.
IMAGE_FORMATS = ("webp", "avif", "png", "jpg", "jpeg", "gif", "svg", "ico", "jxl")
MODERN_FORMATS, CONVERTIBLE_FORMATS = ("webp", "avif"), ("png", "jpg", "jpeg", "gif")
#: Schema types that make a page eligible for a rich result.
RICH_RESULTS = {
    "product": ("Product", "Offer", "AggregateRating"),
    "recipe": ("Recipe",),
    "faq": ("FAQPage",),
    "how_to": ("HowTo",),
    "review": ("Review",),
    "article": ("Article", "NewsArticle", "BlogPosting"),
    "event": ("Event",),
    "video": ("VideoObject",),
    "job_posting": ("JobPosting",),
    "local_business": ("LocalBusiness",),
}


def _literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def lower_headers(headers: Column) -> Column:
    """Headers under lower-cased names; of names that differ in case only, the first stays."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_entries(F.transform(names, lambda n: F.filter(entries, lambda e: e["key"] == n)[0]))


def security_score(url: Column, headers: Column) -> Column:
    present = F.coalesce(F.transform(F.map_keys(headers), F.lower), F.array().cast("array<string>"))
    points = F.when(urls.is_https(url), HTTPS_POINTS).otherwise(0)
    for name, worth in HEADER_POINTS.items():
        points = points + F.when(F.array_contains(present, name), worth).otherwise(0)
    return points


def mobile_issues(viewport: Column, n_images: Column, images: Column) -> Column:
    """missing_viewport, fixed_width, not_device_width, no_srcset - as far as they hold."""
    missing = F.coalesce(viewport, F.lit("")) == ""
    device = F.contains(viewport, F.lit("width=device-width"))
    literal = F.exists(images, lambda i: F.coalesce(F.contains(i["srcset"], F.lit("srcset")), F.lit(False)) | F.coalesce(F.contains(i["src"], F.lit("srcset")), F.lit(False)))
    return F.array_compact(
        F.array(
            F.when(missing, "missing_viewport").when(device, None).when(viewport.rlike(r"width=[0-9]+"), "fixed_width").otherwise("not_device_width"),
            F.when((n_images > 10) & ~F.coalesce(literal, F.lit(False)), "no_srcset"),
        )
    )


def mobile_score(issues: Column) -> Column:
    cost = F.aggregate(issues, F.lit(0), lambda n, i: n + F.when(i == "missing_viewport", 40).otherwise(20))
    return F.greatest(F.lit(0), 100 - cost)


def international_issues(lang: Column, hreflang: Column, charset: Column, url: Column) -> Column:
    """``hreflang``: array of struct(hreflang, href).  ``x-default`` counts as invalid, since its part before the
    dash is no language."""
    has_tags = F.coalesce(F.size(hreflang) > 0, F.lit(False))
    bare = lambda u: F.rtrim(F.coalesce(u, F.lit("")), F.lit("/"))
    own = F.exists(hreflang, lambda t: bare(t["href"]) == bare(url))
    bad = F.transform(F.filter(hreflang, lambda t: ~F.lower(F.substring_index(t["hreflang"], "-", 1)).isin(*LANGUAGES)), lambda t: F.concat(F.lit("invalid_hreflang:"), t["hreflang"]))
    first = F.array_compact(F.array(F.when(F.coalesce(lang, F.lit("")) == "", "missing_lang"), F.when(has_tags & ~own, "no_self_reference")))
    last = F.array_compact(F.array(F.when(F.coalesce(charset, F.lit("")) == "", "missing_charset").when(F.lower(charset) != "utf-8", "not_utf8")))
    return F.concat(first, F.when(has_tags, bad).otherwise(F.array().cast("array<string>")), last)


def _property_score(found: Column, prefix: str, required, recommended, points) -> tuple[Column, Column]:
    has = lambda p: F.coalesce(F.map_contains_key(found, p) | F.map_contains_key(found, p.removeprefix(prefix)), F.lit(False))
    total = F.lit(0)
    for p in required:
        total = total + F.when(has(p), points[0]).otherwise(0)
    for p in recommended:
        total = total + F.when(has(p), points[1]).otherwise(0)
    return total, F.array_compact(F.array(*[F.when(~has(p), p) for p in required]))


def _either(found: Column, name: str, prefix: str) -> Column:
    full = F.try_element_at(found, F.lit(name))
    return F.coalesce(F.when(full != "", full), F.try_element_at(found, F.lit(name.removeprefix(prefix))))


def open_graph_score(og: Column) -> tuple[Column, Column]:
    """(score, missing required properties)."""
    score, missing = _property_score(og, "og:", OG_REQUIRED, OG_RECOMMENDED, OG_POINTS)
    image = _either(og, "og:image", "og:")
    return F.least(F.lit(100), score + F.when(F.coalesce(image, F.lit("")) != "", OG_POINTS[2]).otherwise(0)), missing


def twitter_score(card: Column) -> tuple[Column, Column]:
    score, missing = _property_score(card, "twitter:", TWITTER_REQUIRED, TWITTER_RECOMMENDED, TWITTER_POINTS)
    kind = _either(card, "twitter:card", "twitter:")
    bad = (F.coalesce(kind, F.lit("")) != "") & ~kind.isin(*TWITTER_CARDS)
    return F.greatest(F.lit(0), F.least(F.lit(100), score + F.when(bad, TWITTER_POINTS[2]).otherwise(0))), missing


def image_format(src: Column) -> Column:
    path = F.lower(F.substring_index(F.coalesce(src, F.lit("")), "?", 1))
    ending = F.regexp_extract(path, r"\.(" + "|".join(IMAGE_FORMATS) + ")$", 1)
    return F.when(ending != "", ending).when(F.contains(path, F.lit("webp")), "webp").when(F.contains(path, F.lit("avif")), "avif").otherwise("unknown")


def rich_results(types: Column) -> Column:
    """map of rich result to eligibility."""
    return F.create_map(*[x for name, needed in RICH_RESULTS.items() for x in (F.lit(name), F.coalesce(F.arrays_overlap(types, _literals(needed)), F.lit(False)))])


def structured_data_score(n_jsonld: Column, n_microdata: Column, types: Column, errors: Column, missing: Column) -> Column:
    eligible = F.size(F.filter(F.map_values(rich_results(types)), lambda x: x))
    step = lambda v, *bands: _bands(v, bands)
    points = F.when((n_jsonld > 0) | (n_microdata > 0), 30).otherwise(0) + F.when(n_jsonld > 0, 10).otherwise(0)
    points = points + F.when(F.size(types) >= 2, 10).when(F.size(types) >= 1, 5).otherwise(0)
    points = points + step(F.size(errors), (0, 20), (2, 10))
    points = points + F.when(eligible >= 2, 15).when(eligible == 1, 10).otherwise(0)
    points = points + step(F.size(missing), (0, 15), (2, 10), (4, 5))
    return F.least(F.lit(100), points)


def _bands(value: Column, bands) -> Column:
    out = F.when(value <= bands[0][0], bands[0][1])
    for most, worth in bands[1:]:
        out = out.when(value <= most, worth)
    return out.otherwise(0)


def structured_data_status(average: Column) -> Column:
    return F.when(average >= 80, "excellent").when(average >= 60, "good").when(average >= 40, "needs-improvement").otherwise("poor")


def crawl_efficiency(broken: Column, orphans: Column, has_sitemap: Column, robots_errors: Column) -> Column:
    value = 100 - F.least(broken * 0.5, F.lit(30.0)) - F.least(orphans * 2, F.lit(20)) - F.when(has_sitemap, 0).otherwise(30) - robots_errors * 5
    return F.greatest(F.lit(0), F.signum(value).cast("int") * F.floor(F.abs(value)).cast("int"))


def crawlability_score(has_robots: Column, robots_errors: Column, has_sitemap: Column, sitemap_errors: Column, orphans: Column, efficiency: Column) -> Column:
    points = F.when(has_robots, 20).otherwise(0) + _bands(robots_errors, ((0, 15), (1, 10))) + F.when(has_sitemap, 25).otherwise(0)
    points = points + _bands(sitemap_errors, ((0, 15), (1, 10))) + _bands(orphans, ((0, 10), (5, 5)))
    return F.least(F.lit(100), points + F.when(efficiency >= 90, 15).when(efficiency >= 70, 10).when(efficiency >= 50, 5).otherwise(0))
