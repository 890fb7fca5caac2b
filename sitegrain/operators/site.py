"""Site-level rollups: resources, third parties, images, redirects, console, social, technologies, headers, tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, scores, urls
from ..sources import slices
from ..thresholds import DEFAULTS, Thresholds

KINDS = ("html", "css", "js", "image", "font")


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


# -- resources ---------------------------------------------------------------------------------------------------------


def resource_rows(pages: DataFrame) -> DataFrame:
    """Bytes by kind of every page; other is what the page weight has beyond them, total their sum where it is 0."""
    known = sum((F.coalesce(F.col(f"{k}_bytes"), F.lit(0)) for k in KINDS), F.lit(0))
    weight = F.coalesce(F.col("page_bytes"), F.lit(0))
    rows = pages.select("url", "crawl_seq", *[F.coalesce(F.col(f"{k}_bytes"), F.lit(0)).alias(f"{k}_bytes") for k in KINDS], known.alias("_known"), weight.alias("_weight"))
    return rows.select("url", "crawl_seq", *[f"{k}_bytes" for k in KINDS], F.greatest(F.lit(0), F.col("_weight") - F.col("_known")).alias("other_bytes"), F.when(F.col("_weight") == 0, F.col("_known")).otherwise(F.col("_weight")).alias("total_bytes"))


def resource_summary(rows: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Totals, floor averages, shares and counts of heavy pages, in one row."""
    names = [*KINDS, "other"]
    found = rows.agg(
        F.count(F.lit(1)).alias("pages"),
        *[F.coalesce(F.sum(f"{k}_bytes"), F.lit(0)).alias(f"{k}_bytes") for k in names],
        F.coalesce(F.sum("total_bytes"), F.lit(0)).alias("total_bytes"),
        F.count_if(F.col("total_bytes") > t.page_bytes).alias("bloated"),
        F.count_if(F.col("js_bytes") > t.js_bytes).alias("heavy_js"),
        F.count_if(F.col("css_bytes") > t.css_bytes).alias("heavy_css"),
        F.count_if(F.col("image_bytes") > t.image_bytes).alias("heavy_images"),
    )
    found = found.withColumn("avg_bytes", F.coalesce(F.floor(F.try_divide("total_bytes", "pages")), F.lit(0)))
    for k in KINDS:
        found = found.withColumn(f"{k}_share", _share(F.col(f"{k}_bytes"), F.col("total_bytes")))
    return found


def heaviest(rows: DataFrame, n: int = 10) -> DataFrame:
    return rows.orderBy(F.desc("total_bytes"), "crawl_seq", "url").limit(n)


def resources_from_requests(requests: DataFrame, base: Column) -> DataFrame:
    """(url, kind, n, bytes, third_party) of a request log (url, request_url, kind, bytes); missing sizes are 0."""
    third = urls.netloc(F.col("request_url")) != base
    return requests.groupBy("url", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"), F.count_if(third).alias("third_party"))


# -- third parties -----------------------------------------------------------------------------------------------------


def third_party_domains(pages: DataFrame, slices: int | None = None) -> DataFrame:
    """(domain, requests, pages, category): pages that list a domain count a request each.

    A task holds every domain of its addresses once; ``slices`` deals the addresses into so many tasks, so that a number
    that follows the input bounds what one of them holds.
    """
    pages = pages.select("url", "third_party_domains")
    rows = (pages.repartition(slices, "url") if slices else pages).select("url", F.explode("third_party_domains").alias("domain"))
    counted = rows.groupBy("domain").agg(F.count(F.lit(1)).alias("requests"), F.countDistinct("url").alias("pages"))
    return counted.withColumn("category", classify.domain_category(F.col("domain")))


def third_party_summary(pages: DataFrame) -> DataFrame:
    """Totals over pages that have third parties, and their share of all bytes."""
    has = F.coalesce(F.size("third_party_domains") > 0, F.lit(False))
    n = lambda c: F.coalesce(F.sum(F.when(has, F.col(c))), F.lit(0))
    found = pages.agg(F.count(F.lit(1)).alias("pages"), F.count_if(has).alias("with_third_party"), n("third_party_requests").alias("requests"), n("third_party_bytes").alias("bytes"), F.coalesce(F.sum("page_bytes"), F.lit(0)).alias("_all"))
    return found.select("pages", "with_third_party", "requests", "bytes", F.coalesce(F.try_divide("requests", "with_third_party"), F.lit(0.0)).alias("avg_requests"), _share(F.col("bytes"), F.col("_all")).alias("share"))


def third_party_pages(pages: DataFrame, n: int = 10) -> DataFrame:
    """(url, requests, domains) of the pages with most third-party requests; ties in crawl order."""
    rows = pages.filter(F.size("third_party_domains") > 0).select("url", "crawl_seq", F.col("third_party_requests").alias("requests"), F.size("third_party_domains").alias("domains"))
    return rows.orderBy(F.desc("requests"), "crawl_seq", "url").limit(n).drop("crawl_seq")


# -- images ------------------------------------------------------------------------------------------------------------


def image_rows(pages: DataFrame) -> DataFrame:
    """(url, pos, src, format, has_alt, has_dimensions): a key that is there counts, also when its value is empty."""
    rows = pages.select("url", F.posexplode("images").alias("pos", "i"))
    has = lambda k: F.map_contains_key("i", k)
    src = F.coalesce(F.try_element_at("i", F.lit("src")), F.lit(""))
    alt = F.coalesce(F.try_element_at("i", F.lit("alt")), F.lit(""))
    return rows.select("url", "pos", src.alias("src"), scores.image_format(src).alias("format"), (alt != "").alias("has_alt"), (has("width") | has("height")).alias("has_dimensions"))


def image_formats(pages: DataFrame) -> DataFrame:
    return image_rows(pages).groupBy("format").agg(F.count(F.lit(1)).alias("images"))


def image_summary(pages: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """One row: coverage, formats, lazy loading, and the bytes a modern format would save.

    Image rows and page sums are aggregated apart, so that pages do not count once an image.
    """
    per_image = image_rows(pages).agg(
        F.count(F.lit(1)).alias("images"),
        F.count_if("has_alt").alias("with_alt"),
        F.count_if(~F.col("has_dimensions")).alias("without_dimensions"),
        F.count_if(F.col("format").isin(*scores.MODERN_FORMATS)).alias("modern"),
        F.count_if(F.col("format").isin(*scores.CONVERTIBLE_FORMATS)).alias("convertible"),
    )
    per_page = pages.agg(F.coalesce(F.sum("lazy_images"), F.lit(0)).alias("lazy"), F.coalesce(F.sum("eager_images"), F.lit(0)).alias("eager"), F.coalesce(F.sum("image_bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.greatest(F.lit(0), F.col("eager_images") - t.lazy_position)), F.lit(0)).alias("should_be_lazy"))
    both = per_image.withColumn("_k", F.lit(1)).join(F.broadcast(per_page.withColumn("_k", F.lit(1))), "_k").drop("_k")
    saving = F.floor(F.floor(F.col("bytes") * F.coalesce(F.try_divide("convertible", "images"), F.lit(0.0))) * t.modern_saving)
    return both.select("*", _share(F.col("with_alt"), F.col("images")).alias("alt_share"), _share(F.col("modern"), F.col("images")).alias("modern_share"), _share(F.col("lazy"), F.col("lazy") + F.col("eager")).alias("lazy_share"), saving.alias("saving"), _share(saving, F.col("bytes")).alias("saving_share"))


# -- redirects and console ---------------------------------------------------------------------------------------------


def redirect_rows(pages: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """(url, crawl_seq, final, hops, ms, first): a hop for every entry of the chain, the source included."""
    chained = pages.filter(F.col("was_redirected") & (F.size("redirect_chain") > 0))
    hops = F.size("redirect_chain")
    return chained.select("url", "crawl_seq", F.coalesce(F.nullif("final_url", F.lit("")), "url").alias("final"), hops.alias("hops"), (hops * t.redirect_ms).alias("ms"), F.slice("redirect_chain", 1, 5).alias("first"))


def redirect_summary(rows: DataFrame) -> DataFrame:
    n = lambda test: F.count_if(test)
    return rows.agg(F.count(F.lit(1)).alias("chains"), n(F.col("hops") == 1).alias("one"), n(F.col("hops") == 2).alias("two"), n(F.col("hops") >= 3).alias("three_plus"), F.coalesce(F.sum("hops"), F.lit(0)).alias("hops"), F.avg("hops").alias("avg_hops"), F.coalesce(F.max("hops"), F.lit(0)).alias("longest"), F.coalesce(F.sum("ms"), F.lit(0)).alias("ms"))


def longest_chains(rows: DataFrame, n: int = 50) -> DataFrame:
    return rows.orderBy(F.desc("hops"), "crawl_seq", "url").limit(n)


def console_rows(pages: DataFrame, patterns=classify.CONSOLE_PATTERNS) -> DataFrame:
    """(url, crawl_seq, pos, message, type), messages cut at 100 characters."""
    rows = pages.select("url", "crawl_seq", F.posexplode("console_errors").alias("pos", "m"))
    return rows.select("url", "crawl_seq", "pos", F.substring("m", 1, 100).alias("message"), classify.console_error(F.col("m"), patterns).alias("type"))


def console_summary(pages: DataFrame) -> DataFrame:
    errors, warnings = F.greatest(F.size("console_errors"), F.lit(0)), F.greatest(F.size("console_warnings"), F.lit(0))
    found = pages.agg(F.count(F.lit(1)).alias("pages"), F.sum(errors).alias("errors"), F.sum(warnings).alias("warnings"), F.count_if(errors > 0).alias("pages_with_errors"), F.count_if(warnings > 0).alias("pages_with_warnings"))
    return found.select("*", (100.0 - _share(F.col("pages_with_errors"), F.col("pages"))).alias("error_free"), classify.console_severity(F.col("errors"), F.col("pages")).alias("severity"))


def common_messages(rows: DataFrame, n: int = 10) -> DataFrame:
    """The most frequent messages; equally frequent ones by first occurrence."""
    counted = rows.groupBy("message").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("crawl_seq", "pos")).alias("_first"))
    return counted.orderBy(F.desc("n"), "_first").limit(n).drop("_first")


# -- social, headers, mobile, international, technologies ----------------------------------------------------------------


def social_rows(pages: DataFrame) -> DataFrame:
    og, og_missing = scores.open_graph_score(F.col("open_graph"))
    card, card_missing = scores.twitter_score(F.col("twitter_card"))
    return pages.select("url", "crawl_seq", (F.size(F.map_keys("open_graph")) > 0).alias("has_og"), og.alias("og_score"), og_missing.alias("og_missing"), (F.size(F.map_keys("twitter_card")) > 0).alias("has_twitter"), card.alias("twitter_score"), card_missing.alias("twitter_missing"))


def social_summary(rows: DataFrame) -> DataFrame:
    """Coverage, and mean scores over the pages that have any property."""
    return rows.agg(F.count(F.lit(1)).alias("pages"), _share(F.count_if("has_og"), F.count(F.lit(1))).alias("og_coverage"), _share(F.count_if("has_twitter"), F.count(F.lit(1))).alias("twitter_coverage"), F.avg(F.when(F.col("has_og"), F.col("og_score"))).alias("og_score"), F.avg(F.when(F.col("has_twitter"), F.col("twitter_score"))).alias("twitter_score"))


def missing_properties(rows: DataFrame, n: int = 10) -> DataFrame:
    found = rows.select(F.explode(F.concat("og_missing", "twitter_missing")).alias("property"))
    return found.groupBy("property").agg(F.count(F.lit(1)).alias("pages")).orderBy(F.desc("pages"), "property").limit(n)


def security_rows(pages: DataFrame) -> DataFrame:
    return pages.select("url", urls.is_https(F.col("url")).alias("https"), scores.security_score(F.col("url"), F.col("headers")).alias("score"), F.coalesce(F.transform(F.map_keys("headers"), F.lower), F.array().cast("array<string>")).alias("names"))


def header_coverage(rows: DataFrame) -> DataFrame:
    """(header, pages, state) of the reported headers: none, partial or complete."""
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("header"), F.array_contains("names", h).alias("has")) for h in scores.REPORTED_HEADERS])).alias("x")
    counted = rows.select(each).select("x.*").groupBy("header").agg(F.count_if("has").alias("pages"), F.count(F.lit(1)).alias("_n"))
    return counted.select("header", "pages", F.when(F.col("pages") == 0, "none").when(F.col("pages") == F.col("_n"), "complete").otherwise("partial").alias("state"))


def mobile_rows(pages: DataFrame) -> DataFrame:
    issues = scores.mobile_issues(F.col("viewport"), F.col("total_images"), F.col("images"))
    return pages.select("url", (F.coalesce("viewport", F.lit("")) != "").alias("has_viewport"), issues.alias("issues")).withColumn("score", scores.mobile_score(F.col("issues")))


def international_rows(pages: DataFrame) -> DataFrame:
    return pages.select("url", "lang", F.greatest(F.size("hreflang"), F.lit(0)).alias("hreflang"), "charset", scores.international_issues(F.col("lang"), F.col("hreflang"), F.col("charset"), F.col("url")).alias("issues"))


def issue_frequency(rows: DataFrame, column: str = "issues", n: int | None = 5) -> DataFrame:
    found = rows.select(F.explode(column).alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("pages")).orderBy(F.desc("pages"), "issue")
    return found if n is None else found.limit(n)


def technology_coverage(pages: DataFrame, n: int = 20, examples: int = 10) -> DataFrame:
    """(technology, pages, share, examples): the most frequent technologies with their first pages."""
    rows = pages.select("url", "crawl_seq", F.explode("technologies").alias("technology"))
    total = pages.agg(F.count(F.lit(1)).alias("_n"))
    counted = rows.groupBy("technology").agg(F.count(F.lit(1)).alias("pages"), F.min("crawl_seq").alias("_first")).orderBy(F.desc("pages"), "_first", "technology").limit(n)
    ranked = rows.join(F.broadcast(counted.select("technology")), "technology").withColumn("_r", F.row_number().over(Window.partitionBy("technology").orderBy("crawl_seq", "url"))).filter(F.col("_r") <= examples)
    listed = ranked.groupBy("technology").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "url"))), lambda x: x["url"]).alias("examples"))
    return counted.withColumn("_k", F.lit(1)).join(F.broadcast(total.withColumn("_k", F.lit(1))), "_k").join(listed, "technology").select("technology", "pages", _share(F.col("pages"), F.col("_n")).alias("share"), "examples")


# -- structured data, challenges, site tree, crawl -----------------------------------------------------------------------


def structured_data_rows(pages: DataFrame) -> DataFrame:
    """(url, crawl_seq, types, errors, missing, score) with the schema types a page's content asks for but lacks."""
    wanted = {"product": ("Product",), "article": ("Article", "BlogPosting", "NewsArticle"), "faq": ("FAQPage",), "video": ("VideoObject",), "review": ("Review",), "breadcrumb": ("BreadcrumbList",), "homepage": ("Organization",)}
    gaps = F.array_compact(F.array(*[F.when(F.array_contains("page_types", k) & ~F.arrays_overlap("schema_types", F.array(*[F.lit(x) for x in v])), v[0]) for k, v in wanted.items()]))
    n_jsonld = F.greatest(F.size("json_ld"), F.lit(0))
    rows = pages.select("url", "crawl_seq", "schema_types", n_jsonld.alias("json_ld"), "microdata_count", "schema_errors", gaps.alias("missing"))
    return rows.withColumn("score", scores.structured_data_score(F.col("json_ld"), F.col("microdata_count"), F.col("schema_types"), F.col("schema_errors"), F.col("missing")))


def structured_data_summary(rows: DataFrame) -> DataFrame:
    has = (F.size("schema_types") > 0) | (F.col("json_ld") > 0) | (F.col("microdata_count") > 0)
    found = rows.agg(F.count(F.lit(1)).alias("pages"), F.count_if(has).alias("with_schema"), F.sum("json_ld").alias("json_ld"), F.sum("microdata_count").alias("microdata"), F.sum(F.size("schema_errors")).alias("errors"), F.avg("score").alias("score"))
    return found.withColumn("status", scores.structured_data_status(F.col("score")))


def with_running_schema(rows: DataFrame) -> DataFrame:
    """Adds ``counted``: whether a page counts as having schema when totals of all pages before it count as well.

    For parity with order-dependent reports.  The running sums go through slices of the crawl order.
    """
    sums = {"_json": (F.sum, F.col("json_ld")), "_micro": (F.sum, F.col("microdata_count"))}
    found = slices.running(slices.in_slices(rows, "crawl_seq", "url"), [], ["crawl_seq", "url"], **sums)
    return found.withColumn("counted", (F.size("schema_types") > 0) | (F.col("_json") > 0) | (F.col("_micro") > 0)).drop(slices.SLICE, *sums)


def challenge_summary(rows: DataFrame) -> DataFrame:
    """Of (url, challenge_version, blocking): challenged pages, their share and its level."""
    challenged = F.col("challenge_version").isNotNull()
    found = rows.agg(F.count(F.lit(1)).alias("pages"), F.count_if(challenged).alias("challenged"), F.count_if(challenged & F.col("blocking")).alias("blocking"))
    return found.withColumn("rate", _share(F.col("challenged"), F.col("pages"))).withColumn("level", classify.challenge_level(F.col("rate")))


def site_tree(pages: DataFrame) -> DataFrame:
    """(host, prefix, depth, type, pages): every path prefix; a directory is what has something below it."""
    parts = pages.select(urls.netloc(F.col("url")).alias("host"), urls.segments(F.col("url")).alias("s"))
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size("s"), F.lit(1))), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice("s", 1, i), "/").alias("prefix"), (i < F.size("s")).alias("inner")))
    rows = parts.select("host", F.explode(prefixes).alias("p")).select("host", "p.*")
    counted = rows.groupBy("host", "prefix", "depth").agg(F.bool_or("inner").alias("inner"), F.count(F.lit(1)).alias("pages"))
    return counted.select("host", F.when(F.col("prefix") == "", "(homepage)").otherwise(F.col("prefix")).alias("prefix"), "depth", F.when(F.col("inner"), "directory").otherwise("file").alias("type"), "pages")


def crawl_summary(pages: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return pages.agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum("word_count").alias("words"),
        F.coalesce(F.floor(F.try_divide(F.sum("word_count"), F.count(F.lit(1)))), F.lit(0)).alias("avg_words"),
        F.sum("total_images").alias("images"),
        F.count_if(blank("title")).alias("without_title"),
        F.count_if(blank("description")).alias("without_description"),
        F.count_if(F.coalesce(F.size("h1_tags"), F.lit(0)) <= 0).alias("without_h1"),
    )


def advanced_summary(pages: DataFrame, readability: DataFrame) -> DataFrame:
    """Mean readability, https share, security and mobile scores in one row."""
    secure = security_rows(pages).agg(F.count_if("https").alias("https"), F.avg("score").alias("security")).withColumn("_k", F.lit(1))
    mobile = mobile_rows(pages).agg(F.avg("score").alias("mobile")).withColumn("_k", F.lit(1))
    read = readability.agg(F.avg("score").alias("readability")).withColumn("_k", F.lit(1))
    return read.join(secure, "_k").join(mobile, "_k").drop("_k")
