"""What a browser recorded beside the HTML - requests, console, final addresses - as columns of the page table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls

#: Console lines a page keeps and their length, third-party hosts it lists, length of a font's address.
CONSOLE_MOST, CONSOLE_LENGTH, HOSTS_MOST, FONT_LENGTH = 10, 500, 20, 100


def web_fonts(requests: DataFrame) -> DataFrame:
    """(url, web_fonts array<struct<url, size>>) of a request log (url, request_url, kind, bytes, seq), in order."""
    fonts = requests.filter("kind = 'font'")
    each = F.struct("seq", F.substring("request_url", 1, FONT_LENGTH).alias("url"), F.coalesce("bytes", F.lit(0)).alias("size"))
    listed = fonts.groupBy("url").agg(F.array_sort(F.collect_list(each)).alias("f"))
    return listed.select("url", F.transform("f", lambda x: F.struct(x["url"].alias("url"), x["size"].alias("size"))).alias("web_fonts"))


def third_parties(requests: DataFrame) -> DataFrame:
    """(url, third_party_domains, third_party_requests, third_party_bytes): hosts other than the page's, the first
    twenty by name."""
    host = urls.netloc(F.col("request_url"))
    others = requests.filter((host != urls.netloc(F.col("url"))) & (host != ""))
    return others.groupBy("url").agg(F.slice(F.array_sort(F.collect_set(host)), 1, HOSTS_MOST).alias("third_party_domains"), F.count(F.lit(1)).alias("third_party_requests"), F.sum(F.coalesce("bytes", F.lit(0))).alias("third_party_bytes"))


def weights(requests: DataFrame) -> DataFrame:
    """(url, css_bytes, js_bytes, image_bytes, font_bytes, page_bytes) of a request log."""
    size = F.coalesce("bytes", F.lit(0))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, size)), F.lit(0))
    return requests.groupBy("url").agg(of("stylesheet").alias("css_bytes"), of("script").alias("js_bytes"), of("image").alias("image_bytes"), of("font").alias("font_bytes"), F.sum(size).alias("page_bytes"))


def console_lists(console: DataFrame) -> DataFrame:
    """(url, console_errors, console_warnings) of a log (url, seq, level, message): the first ten of each, cut."""

    def first(level):
        kept = F.collect_list(F.when(F.col("level") == level, F.struct("seq", F.substring("message", 1, CONSOLE_LENGTH).alias("m"))))
        return F.transform(F.slice(F.array_sort(kept), 1, CONSOLE_MOST), lambda x: x["m"])

    return console.groupBy("url").agg(first("error").alias("console_errors"), first("warning").alias("console_warnings"))


def redirects(visits: DataFrame) -> DataFrame:
    """(url, final_url, was_redirected, redirect_chain, redirect_count) of (url, final_url): a chain of the two
    addresses where they differ."""
    moved = F.coalesce(F.col("final_url") != F.col("url"), F.lit(False))
    chain = F.when(moved, F.array("url", "final_url")).otherwise(F.array().cast("array<string>"))
    return visits.select("url", "final_url", moved.alias("was_redirected"), chain.alias("redirect_chain"), F.when(moved, 1).otherwise(0).alias("redirect_count"))


def with_captures(pages: DataFrame, requests: DataFrame, console: DataFrame, visits: DataFrame) -> DataFrame:
    """``pages`` with the captured columns in place of its own; pages without records have empty ones."""
    out = pages
    for found in (weights(requests), third_parties(requests), web_fonts(requests), console_lists(console), redirects(visits)):
        new = [c for c in found.columns if c != "url"]
        out = out.drop(*new).join(found, "url", "left")
    numbers = ["css_bytes", "js_bytes", "image_bytes", "font_bytes", "page_bytes", "third_party_requests", "third_party_bytes", "redirect_count"]
    lists = ["third_party_domains", "console_errors", "console_warnings", "redirect_chain"]
    out = out.na.fill(0, numbers).withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in lists})
    return out.withColumn("was_redirected", F.coalesce("was_redirected", F.lit(False)))
