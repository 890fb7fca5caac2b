"""URL columns, by regular expressions that never fail on malformed input."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Path words that say nothing.
PATH_STOP_WORDS = "and or but the a an of to for with on at from by about as into through is are was were been be have has had do does did will would should could may might".split()
#: Public suffixes of two labels.
LONG_SUFFIXES = "co.uk com.au co.nz co.jp com.br co.in org.uk net.au com.mx co.za com.sg".split()
#: File extensions that are not pages.
SKIPPED_EXTENSIONS = "pdf jpg jpeg png gif svg webp zip tar gz mp4 mp3 avi mov doc docx xls xlsx ppt pptx css js xml json ico woff woff2 ttf".split()
#: Parts of paths and of whole URLs that a crawl stays away from.
SKIPPED_PATHS = "/policies/ /checkout/ /cart/ /payment/ /pay/ /order/ /account/login /account/register /signin /signup /login /register".split()
SKIPPED_DOMAINS = "payments.klarna.com klarna.com paypal.com pay.google.com apple.com/pay affirm.com afterpay.com sezzle.com stripe.com checkout.shopify.com".split()
#: What is no API call by extension, and what is one by its path.
STATIC_EXTENSIONS = "js css png jpg jpeg gif svg ico woff woff2 ttf eot map webp mp4 webm".split()
API_PATHS = r"/api/ /v[0-9]+/ /graphql /rest/ /services/ /data/ /ajax/ /json \.json$ /rpc/".split()
#: Limits of a good URL.
MAX_LENGTH, MAX_PARAMETERS, MAX_DEPTH = 75, 3, 4


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def path(url: Column) -> Column:
    """The path, without ;parameters of its last segment."""
    whole = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(whole, r";[^/]*$", "")


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def without_fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^[^#]*", 0)


def is_https(url: Column) -> Column:
    return F.startswith(url, F.lit("https://"))


def segments(url: Column) -> Column:
    return F.array_remove(F.split(path(url), "/"), "")


def depth(url: Column) -> Column:
    return F.size(segments(url))


def normalize(url: Column) -> Column:
    """Without fragment and ;parameters, and without one trailing slash unless the path is the root.

    The slash goes even where it ends the query.
    """
    plain = F.regexp_replace(without_fragment(url), r";[^/?#]*(?=\?|$)", "")
    return F.when((F.length(path(url)) > 1) & F.endswith(plain, F.lit("/")), F.substring(plain, F.lit(1), F.length(plain) - 1)).otherwise(plain)


def parameters(url: Column) -> Column:
    """The distinct names of parameters that have a value."""
    pairs = F.filter(F.split(query(url), "&"), lambda p: p.rlike(r"^[^=]*=.+"))
    return F.array_distinct(F.transform(pairs, lambda p: F.substring_index(p, "=", 1)))


def has_keywords(url: Column) -> Column:
    """Whether a run of letters in the path is no stop word."""
    found = F.regexp_extract_all(F.lower(path(url)), F.lit("[a-z]+"), F.lit(0))
    return F.size(F.array_except(found, F.array(*[F.lit(w) for w in PATH_STOP_WORDS]))) > 0


def is_readable(url: Column) -> Column:
    p = path(url)
    plain = F.forall(segments(url), lambda s: F.lower(s).rlike(r"^[a-z0-9-]+$") | s.rlike(r"\.(html|htm|php)$"))
    return ~p.rlike(r"[0-9]{5,}") & ~p.rlike("[A-Z]{3,}") & (F.length(p) - F.length(F.replace(p, F.lit("_"), F.lit(""))) <= 2) & plain


def structure_issues(url: Column) -> Column:
    """Identifiers of what is wrong with a URL, in a fixed order."""
    n = F.size(parameters(url))
    return F.array_compact(
        F.array(
            F.when(F.length(url) > MAX_LENGTH, "too_long"),
            F.when(~is_https(url), "not_https"),
            F.when(n > MAX_PARAMETERS, "too_many_parameters"),
            F.when(depth(url) > MAX_DEPTH, "too_deep"),
            F.when(~has_keywords(url), "no_keywords"),
            F.when(~is_readable(url), "not_readable"),
            F.when(F.contains(path(url), F.lit("_")), "underscores"),
        )
    )


def base_domain(domain: Column) -> Column:
    """The last two labels, three where the last two are a public suffix."""
    labels = F.split(F.lower(domain), r"\.")
    last = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    return F.when(F.size(labels) < 2, domain).when((F.size(labels) >= 3) & last(2).isin(*LONG_SUFFIXES), F.when(F.size(labels) >= 3, last(3))).otherwise(F.when(F.size(labels) >= 2, last(2)))


def is_skipped(url: Column, strict: bool = True) -> Column:
    """Whether a crawl leaves the URL out: by extension; with ``strict`` also by path and domain."""
    p = F.lower(path(url))
    found = p.rlike(r"\.(" + "|".join(SKIPPED_EXTENSIONS) + ")$")
    if strict:
        found = found | F.exists(F.array(*[F.lit(x) for x in SKIPPED_PATHS]), lambda x: F.contains(p, x)) | F.exists(F.array(*[F.lit(x) for x in SKIPPED_DOMAINS]), lambda x: F.contains(F.lower(url), x))
    return found


def is_external(href: Column, base: Column) -> Column:
    """An http href of another host; every other href counts as internal."""
    return F.startswith(href, F.lit("http")) & (netloc(href) != netloc(base))


def file_name(url: Column, safe: bool = True) -> Column:
    """host_path for files: slashes, dots and colons of the path become underscores, ``index`` for the root.

    ``safe`` also cuts at 200 characters and replaces every other sign, the dots of the host included.
    """
    host = F.replace(netloc(url), F.lit(":"), F.lit("_"))
    inner = F.translate(F.btrim(path(url), F.lit("/")), "/.", "__")
    inner = F.when(inner == "", "index").otherwise(inner)
    if not safe:
        return F.concat(F.replace(host, F.lit("."), F.lit("_")), F.lit("_"), inner)
    return F.regexp_replace(F.substring(F.concat(host, F.lit("_"), inner), 1, 200), r"[^\p{L}\p{N}_-]", "_")


def template(url_path: Column) -> Column:
    """The path with identifiers replaced: {id_i} for UUIDs and numbers, {token_i} for 24 hex digits or more."""
    parts = F.split(F.btrim(url_path, F.lit("/")), "/")
    named = F.transform(
        parts,
        lambda s, i: F.when(s.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$") | s.rlike("^[0-9]+$"), F.concat(F.lit("{id_"), i.cast("string"), F.lit("}")))
        .when(s.rlike("(?i)^[a-f0-9]{24,}$"), F.concat(F.lit("{token_"), i.cast("string"), F.lit("}")))
        .otherwise(s),
    )
    return F.concat(F.lit("/"), F.array_join(named, "/"))


def is_api_request(url: Column, resource_type: Column) -> Column:
    """Not a static file, and fetched by a script or of an API's path."""
    p = F.lower(path(url))
    static = p.rlike(r"\.(" + "|".join(STATIC_EXTENSIONS) + ")$")
    return ~static & (F.coalesce(resource_type.isin("xhr", "fetch"), F.lit(False)) | p.rlike("|".join(API_PATHS)))


def tag(url_path: Column) -> Column:
    """The first path segment, or default."""
    first = F.try_element_at(F.array_remove(F.split(url_path, "/"), ""), F.lit(1))
    return F.coalesce(first, F.lit("default"))


@F.pandas_udf(T.StringType())
def join_url(base: pd.Series, href: pd.Series) -> pd.Series:
    """RFC 3986 resolution; null where either is null or cannot be parsed."""
    from urllib.parse import urljoin

    def one(b, h):
        try:
            return urljoin(b, h) if b is not None and h is not None else None
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href)], dtype=object)
