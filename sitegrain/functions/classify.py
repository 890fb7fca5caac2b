"""Ordered pattern sets and what they make of a text: console errors, domains, firewalls, form fields, frameworks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls

#: Console error types by pattern, first match wins, in any case.
CONSOLE_PATTERNS = {
    "TypeError": "TypeError:",
    "ReferenceError": "ReferenceError:",
    "SyntaxError": "SyntaxError:",
    "RangeError": "RangeError:",
    "URIError": "URIError:",
    "NetworkError": "(NetworkError|Failed to fetch|net::)",
    "SecurityError": "(SecurityError|CORS|blocked)",
    "ResourceError": "(404|Failed to load|ERR_)",
    "DeprecationWarning": "(deprecated|Deprecation)",
}
#: Third-party categories in the order of their precedence, and a word that alone decides.
DOMAIN_CATEGORIES = {
    "analytics": "google-analytics.com googletagmanager.com analytics.google.com hotjar.com mixpanel.com segment.com amplitude.com heap.io fullstory.com mouseflow.com clarity.ms plausible.io matomo.org piwik.pro".split(),
    "advertising": "doubleclick.net googlesyndication.com googleadservices.com facebook.com fbcdn.net adsrvr.org criteo.com taboola.com outbrain.com amazon-adsystem.com adnxs.com rubiconproject.com pubmatic.com".split(),
    "cdn": "cloudflare.com cdnjs.cloudflare.com jsdelivr.net unpkg.com bootstrapcdn.com googleapis.com gstatic.com akamaized.net fastly.net cloudfront.net azureedge.net stackpath.com imgix.net twimg.com".split(),
    "social": "twitter.com facebook.com linkedin.com pinterest.com instagram.com youtube.com tiktok.com reddit.com".split(),
}
DOMAIN_WORDS = {"analytics": "analytics", "advertising": "ads", "cdn": "cdn"}
#: How firewalls announce themselves.
FIREWALLS = {
    "cloudflare": ("attention required! | cloudflare", "checking your browser before accessing", "enable javascript and cookies to continue", "ray id:", "performance & security by cloudflare", "please turn javascript on and reload the page"),
    "akamai": ("access denied</title>", "you don't have permission to access", "reference #", "your request has been blocked", "akamai ghost"),
    "sucuri": ("sucuri website firewall", "access denied - sucuri", "blocked by sucuri"),
    "imperva": ("incapsula incident", "request blocked", "incident id:", "powered by incapsula"),
    "aws_waf": ("request blocked by aws waf", "this request was blocked by the security rules"),
    "datadome": ("blocked by datadome", "datadome captcha"),
    "perimeterx": ("human challenge", "press & hold", "perimeterx"),
}
BLOCK_STATUS = (403, 503, 429, 406, 451)
BLOCK_WORDS = (
    "access denied</title>", "403 forbidden</title>", "blocked</title>", "robot or bot", "automated access", "please verify you are human", "suspicious activity detected",
    "rate limit exceeded", "too many requests", "you have been blocked", "your ip has been blocked", "security challenge", "complete the captcha", "prove you are not a robot",
)
CHALLENGE_WORDS = (
    "please wait while we verify your browser", "checking if the site connection is secure", "please enable javascript and cookies", "just a moment...</title>", "ddos protection by",
    "please complete the security check to access", "one more step</title>", "browser verification</title>",
)
#: Form fields by pattern, first match wins.
FIELD_PATTERNS = {
    "first_name": "first.?name|fname|given.?name|forename",
    "last_name": "last.?name|lname|surname|family.?name",
    "full_name": "full.?name|^name$|your.?name|customer.?name",
    "email": "email|e-mail|mail",
    "phone": "phone|tel|mobile|cell|contact.?number",
    "address": "address|street|address.?line.?1|addr1",
    "address_line2": "address.?line.?2|addr2|apt|unit|suite",
    "city": "city|town|municipality",
    "state": "state|province|region",
    "zip": "zip|postal|postcode",
    "country": "country|nation",
    "cc_number": "card.?number|cc.?num|credit.?card|pan",
    "cc_exp": "expir|exp.?date|valid.?thru",
    "cc_exp_month": "exp.?month|card.?month",
    "cc_exp_year": "exp.?year|card.?year",
    "cc_cvv": "cvv|cvc|security.?code|card.?code",
    "cc_name": "name.?on.?card|cardholder|card.?name",
    "username": "user.?name|login|user.?id",
    "password": "password|pass|pwd",
    "company": "company|organization|business",
    "website": "website|url|web.?address",
    "message": "message|comment|note|description|inquiry",
    "search": "search|query|q$",
}
PAYMENT_FIELDS = ("cc_number", "cc_exp", "cc_exp_month", "cc_exp_year", "cc_cvv", "cc_name")
#: Types of forms after payment forms, in order: fields that it must all have, and of which it must have one.
FORM_RULES = (
    ("signup", ("username", "password"), ("email", "first_name")),
    ("login", ("username", "password"), ()),
    ("address", ("address", "city", "state", "zip"), ()),
    ("contact", ("email", "message"), ()),
    ("signup", ("email",), ("first_name", "last_name")),
    ("search", ("search",), ()),
)
#: Evidence of frameworks - weight, how it is looked for, what for - and the least sum that counts.
FRAMEWORK_EVIDENCE = (
    ("react", 0.4, "any", ("data-reactroot",)),
    ("react", 0.3, "any", ("__NEXT_DATA__",)),
    ("react", 0.2, "all, any case", ("react", "react-dom")),
    ("react", 0.3, "any", ("_reactRootContainer",)),
    ("vue", 0.4, "pattern", ("data-v-[a-f0-9]{8}",)),
    ("vue", 0.3, "any", ("__VUE__", "__vue__")),
    ("vue", 0.2, "any", ("v-cloak", "v-if", "v-for")),
    ("vue", 0.3, "any", ("__NUXT__",)),
    ("angular", 0.4, "any", ("ng-version",)),
    ("angular", 0.3, "any", ("_nghost", "_ngcontent")),
    ("angular", 0.2, "any", ("ng-app", "ng-controller")),
    ("svelte", 0.3, "all, any case", ("svelte",)),
    ("svelte", 0.4, "pattern", ('class="svelte-[a-z0-9]+"',)),
)
FRAMEWORK_LEAST = 0.3
#: Shapes of generated attribute values.
DYNAMIC_VALUES = (
    "^[a-zA-Z_-]+_[a-zA-Z0-9]{5,8}$",
    "^sc-[a-zA-Z0-9]+-[a-zA-Z0-9]+$",
    "^css-[a-zA-Z0-9]+$",
    "^css-[a-zA-Z0-9]+-[a-zA-Z0-9]+$",
    "^[a-zA-Z]+__[a-zA-Z]+--[a-zA-Z0-9]+$",
    "^_[a-zA-Z0-9]{8,}$",
    "^[a-f0-9]{8}-[a-f0-9]{4}-",
    "^[a-zA-Z]+[0-9]{6,}$",
    "^[0-9]+$",
)
#: Errors that another attempt does not mend.
FINAL_ERRORS = ("net::err_name_not_resolved", "net::err_connection_refused", "invalid url", "protocol error")


def first_match(text: Column, patterns: Mapping[str, str], default: str) -> Column:
    """The name of the first pattern found in ``text`` in any case."""
    out = None
    for name, pattern in patterns.items():
        test = text.rlike(f"(?i){pattern}")
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(default)


def _contains_any(text: Column, words: Sequence[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def console_error(message: Column, patterns: Mapping[str, str] = CONSOLE_PATTERNS) -> Column:
    return first_match(message, patterns, "Other")


def domain_category(domain: Column, categories: Mapping[str, Sequence[str]] = DOMAIN_CATEGORIES, words: Mapping[str, str] = DOMAIN_WORDS) -> Column:
    """The first category whose list has the base domain or an ending of the domain, or whose word is in it."""
    base, out = urls.base_domain(domain), None
    for name, listed in categories.items():
        test = base.isin(*listed) | F.exists(F.array(*[F.lit(d) for d in listed]), lambda d: F.endswith(domain, d))
        if name in words:
            test = test | F.contains(domain, F.lit(words[name]))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("other")


def firewall(status: Column, html: Column) -> Column:
    """The firewall that blocked a stored response, waf_block or challenge_page for unknown ones, else null."""
    low = F.lower(F.coalesce(html, F.lit("")))
    named = None
    for name, words in FIREWALLS.items():
        test = _contains_any(low, words)
        named = F.when(test, name) if named is None else named.when(test, name)
    short = (F.length(low) < 5000) & _contains_any(low, ("denied", "blocked", "forbidden"))
    blocked = F.coalesce(named, F.when(_contains_any(low, BLOCK_WORDS) | short, "waf_block"))
    challenged = F.when(_contains_any(low, CHALLENGE_WORDS), F.coalesce(named, F.lit("challenge_page")))
    return F.when(status.isin(*BLOCK_STATUS), blocked).when(status == 200, challenged)


def form_field(name: Column, id_: Column, placeholder: Column, label: Column, kind: Column) -> Column:
    text = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (name, id_, placeholder, label)]))
    by_kind = F.when(kind == "email", "email").when(kind == "tel", "phone").when(kind == "password", "password")
    return F.coalesce(by_kind, first_match(text, FIELD_PATTERNS, "unknown"))


def form_type(fields: Column) -> Column:
    """The type of a form from its field classes (an array): the first rule that holds."""
    names = lambda listed: F.array(*[F.lit(n) for n in listed])
    out = F.when(F.arrays_overlap(fields, names(PAYMENT_FIELDS)), "payment")
    for kind, every, one in FORM_RULES:
        test = F.size(F.array_intersect(fields, names(every))) == len(every)
        out = out.when(test & F.arrays_overlap(fields, names(one)) if one else test, kind)
    return out.otherwise("unknown")


def is_dynamic_value(value: Column) -> Column:
    """Whether an attribute value looks generated: a known shape, or long, unspaced and over 30 % digits."""
    shaped = F.exists(F.array(*[F.lit(p) for p in DYNAMIC_VALUES]), lambda p: F.regexp_like(value, p))
    digits = F.regexp_count(value, F.lit("[0-9]"))
    long = (F.length(value) > 20) & ~F.contains(value, F.lit(" ")) & (digits > F.length(value) * 0.3)
    return F.coalesce((value != "") & (shaped | long), F.lit(False))


def framework(html: Column) -> Column:
    """struct(framework, confidence): additive evidence, the best above the least, ties in the order of the table."""
    low, none = F.lower(html), struct_of("unknown", F.lit(0.0))
    tests = {"any": lambda w: _contains_any(html, w), "all, any case": lambda w: F.forall(F.array(*[F.lit(x) for x in w]), lambda x: F.contains(low, x)), "pattern": lambda w: html.rlike(w[0])}
    scores: dict[str, Column] = {}
    for name, weight, how, words in FRAMEWORK_EVIDENCE:
        scores[name] = scores.get(name, F.lit(0.0)) + F.when(tests[how](words), float(weight)).otherwise(0.0)
    best, named = F.greatest(*scores.values()), None
    for name, score in scores.items():
        named = F.when(score == best, name) if named is None else named.when(score == best, name)
    return F.when(best > FRAMEWORK_LEAST, struct_of(named, F.least(best, F.lit(1.0)))).otherwise(none)


def struct_of(name: Column | str, confidence: Column) -> Column:
    return F.struct((F.lit(name) if isinstance(name, str) else name).alias("framework"), confidence.alias("confidence"))


def is_retryable(error: Column, retries: Column, most: int = 3) -> Column:
    return (retries < most) & ~_contains_any(F.lower(error), FINAL_ERRORS)


def backs_off(success: Column, status: Column, error_type: Column) -> Column:
    """Whether a request outcome slows the crawl down: 429, 5xx, timeouts, network and name errors do."""
    kind = F.coalesce(error_type, F.lit(""))
    return ~success & (status.isin(429, 503) | status.between(500, 599) | kind.isin("timeout", "network", "dns"))


def console_severity(errors: Column, pages: Column) -> Column:
    rate = F.try_divide(errors, pages)
    return F.when(errors == 0, "good").when(rate > 0.5, "critical").when(rate > 0.2, "high").when(rate > 0.1, "medium").otherwise("low")


def challenge_level(percent: Column) -> Column:
    return F.when(percent == 0, "good").when(percent > 50, "critical").when(percent > 20, "high").when(percent > 5, "medium").otherwise("low")


def ice_tier(score: Column) -> Column:
    return F.when(score >= 6.0, "critical").when(score >= 4.0, "high").when(score >= 2.0, "medium").otherwise("low")
