"""robots.txt and sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores

#: Where sitemaps usually lie.
GUESSED = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap1.xml")


def robots_lines(robots: DataFrame) -> DataFrame:
    """(domain, no, name, value): the directives of (domain, content), names lower-cased."""
    lines = robots.select("domain", F.posexplode(F.split(F.coalesce("content", F.lit("")), "\n")).alias("no", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"[\r\t]", " ")))
    kept = lines.filter((F.col("line") != "") & ~F.startswith("line", F.lit("#")) & F.contains("line", F.lit(":")))
    return kept.select("domain", "no", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("name"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value"))


def rules_by_agent(robots: DataFrame) -> DataFrame:
    """(domain, agent, rules): Disallow lines below each User-agent line, lower-cased; ``*`` before the first.

    Agents without rules are listed.
    """
    lines = robots_lines(robots).filter(F.col("name").isin("user-agent", "disallow"))
    before = Window.partitionBy("domain").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    agent = F.coalesce(F.last(F.when(F.col("name") == "user-agent", F.lower("value")), ignorenulls=True).over(before), F.lit("*"))
    return lines.withColumn("agent", agent).groupBy("domain", "agent").agg(F.count_if(F.col("name") == "disallow").alias("rules"))


def robots_analysis(robots: DataFrame) -> DataFrame:
    """One row a domain: presence, sitemaps, disallowed paths, errors and warnings.

    ``Disallow: /`` is looked for as text, so ``Disallow: /admin`` counts as blocking everything as well.
    """
    lines = robots_lines(robots)
    found = lines.groupBy("domain").agg(F.array_sort(F.collect_list(F.when(F.col("name") == "sitemap", F.struct("no", "value")))).alias("_s"), F.array_sort(F.collect_list(F.when((F.col("name") == "disallow") & ~F.col("value").isin("", "/"), F.struct("no", "value")))).alias("_d"))
    joined = robots.join(found, "domain", "left")
    text = F.coalesce("content", F.lit(""))
    values = lambda c: F.coalesce(F.transform(c, lambda x: x["value"]), F.array().cast("array<string>"))
    has = text != ""
    blocked = F.exists(values("_d"), lambda r: r.rlike("/css|/js|/images"))
    errors = F.array_compact(F.array(F.when(has & ~F.contains(F.lower(text), F.lit("user-agent")), "no_user_agent"), F.when(F.contains(text, F.lit("Disallow: /")), "blocks_all")))
    warnings = F.array_compact(F.array(F.when(~has, "not_fetched"), F.when(has & blocked, "blocks_assets")))
    return joined.select("domain", has.alias("has_robots"), values("_s").alias("sitemaps"), values("_d").alias("disallowed"), errors.alias("errors"), warnings.alias("warnings"))


def sitemap_candidates(analysis: DataFrame) -> DataFrame:
    """``analysis`` with ``has_sitemap`` (robots.txt names one), the addresses to try, and sitemap errors."""
    has = F.size("sitemaps") > 0
    guessed = F.array(*[F.concat("domain", F.lit(p)) for p in GUESSED])
    return analysis.withColumns({"has_sitemap": has, "to_try": F.when(has, F.col("sitemaps")).otherwise(guessed), "sitemap_errors": F.when(has, F.array().cast("array<string>")).otherwise(F.array(F.lit("no_sitemap")))})


def crawlability(analysis: DataFrame, counts: DataFrame) -> DataFrame:
    """(domain, efficiency, score): ``counts`` has (domain, broken, orphans); orphans beyond ten count ten."""
    joined = sitemap_candidates(analysis).join(counts, "domain", "left").na.fill(0, ["broken", "orphans"])
    orphans, n_errors = F.least(F.col("orphans"), F.lit(10)), F.size("errors")
    rows = joined.withColumn("efficiency", scores.crawl_efficiency(F.col("broken"), orphans, F.col("has_sitemap"), n_errors))
    return rows.select("domain", "has_robots", "has_sitemap", n_errors.alias("robots_errors"), orphans.alias("orphans"), "broken", "efficiency", scores.crawlability_score(F.col("has_robots"), n_errors, F.col("has_sitemap"), F.size("sitemap_errors"), orphans, F.col("efficiency")).alias("score"))


#: Lines of robots.txt that belong to the user agents above them.
GROUP_LINES = ("allow", "disallow", "crawl-delay", "request-rate")


def _decoded(text: Column) -> Column:
    """Percent signs resolved, pluses kept; the text itself where it is not so encoded."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def robots_groups(robots: DataFrame) -> DataFrame:
    """(domain, place, for_all, agents, rules) of (domain, content), one file a domain.

    Consecutive User-agent lines open a group; an empty line ends it, and rules outside one count for nothing, as do
    groups without rules.  ``rules`` are (place, allow, prefix) in the order of the file; an empty Disallow allows
    all.  ``agents`` are lower-cased, ``for_all`` says that one of them is ``*``.
    """
    lines = robots.select("domain", F.posexplode(F.split(F.coalesce("content", F.lit("")), r"\r\n|\r|\n")).alias("no", "raw"))
    lines = lines.withColumn("line", F.regexp_replace(F.regexp_replace("raw", "#.*", ""), r"^\s+|\s+$", ""))
    name = F.lower(F.regexp_extract("line", r"^([^:]*?)\s*:", 1))
    kind = F.when(F.col("raw") == "", "end").when(name == "user-agent", "agent").when(name.isin(*GROUP_LINES), "rule")
    value = _decoded(F.regexp_extract("line", r"^[^:]*:\s*(.*)$", 1))
    marked = lines.select("domain", "no", name.alias("name"), value.alias("value"), kind.alias("kind")).filter("kind is not null")
    order = Window.partitionBy("domain").orderBy("no")
    opens = (F.col("kind") == "agent") & ~F.lag("kind").over(order).eqNullSafe(F.lit("agent"))
    opened = marked.withColumn("opens", (opens | (F.col("kind") == "end")).cast("int")).withColumn("place", F.sum("opens").over(order))
    rule = F.struct("no", ((F.col("name") == "allow") | (F.col("value") == "")).alias("allow"), F.col("value").alias("prefix"))
    grouped = opened.groupBy("domain", "place").agg(
        F.collect_list(F.when(F.col("kind") == "agent", F.lower("value"))).alias("agents"),
        F.array_sort(F.collect_list(F.when(F.col("name").isin("allow", "disallow"), rule))).alias("rules"),
        F.bool_or(F.col("kind") == "rule").alias("_ruled"),
    )
    kept = grouped.filter((F.size("agents") > 0) & F.col("_ruled"))
    return kept.select("domain", "place", F.array_contains("agents", "*").alias("for_all"), "agents", "rules")


def fetch_decisions(requests: DataFrame, robots: DataFrame) -> DataFrame:
    """``requests`` (domain, agent, url and more) with ``allowed``: whether the domain's robots.txt allows the fetch.

    The first group that names the agent decides, else the first for all; in it the first rule whose prefix the path
    begins with (an asterisk in a rule is text).  What no rule meets is allowed, as is everything on a domain without a file.  No agent is any agent,
    no address the root.  A domain has one row of groups, so the join adds no rows.
    """
    groups = robots_groups(robots).groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("for_all", "place", "agents", "rules"))).alias("_groups"))
    token = F.lower(F.substring_index(F.coalesce(F.nullif("agent", F.lit("")), F.lit("*")), "/", 1))
    asked = F.regexp_replace(_decoded(F.coalesce("url", F.lit(""))), r"^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?", "")
    known = requests.withColumns({"_token": token, "_path": F.when(asked == "", "/").otherwise(asked)}).join(groups, "domain", "left")
    fitting = F.filter("_groups", lambda g: g["for_all"] | F.exists(g["agents"], lambda a: F.contains(F.col("_token"), a)))
    met = F.filter(F.get(fitting, F.lit(0))["rules"], lambda r: F.startswith(F.col("_path"), r["prefix"]))
    return known.select(*[F.col(c) for c in requests.columns], F.coalesce(F.get(met, F.lit(0))["allow"], F.lit(True)).alias("allowed"))
