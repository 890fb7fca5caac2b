"""Technology signatures over HTML and headers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Technology and the patterns that give it away in HTML, in any case.  Broad on purpose.
ANY_CASE = {
    "Cloudflare": r"cloudflare\.com|cdnjs\.cloudflare\.com|cf-ray",
    "Akamai": r"akamai\.net|akamaihd\.net|akamaized\.net",
    "Amazon CloudFront": r"cloudfront\.net",
    "Fastly": r"fastly\.net|fastlylb\.net",
    "jsDelivr": r"jsdelivr\.net",
    "unpkg": r"unpkg\.com",
    "StackPath": r"stackpath\.bootstrapcdn\.com",
    "KeyCDN": r"keycdn\.com",
    "BunnyCDN": r"bunnycdn\.com",
    "Google reCAPTCHA": "recaptcha",
    "Font Awesome": r"font-awesome|fontawesome\.com",
    "WooCommerce": "woocommerce",
    "Magento/Adobe Commerce": r"magento|mage\.js|mage/|varien/",
    "Salesforce Commerce Cloud": r"demandware|dwanalytics|dw\.ac|dw\.engine",
    "Salesforce B2C Commerce": "salesforce.*commerce|sfcc|demandware",
    "commercetools": r"commercetools|ctp\.com",
    "SAP Commerce Cloud": "hybris|/medias/_ui/|hac/platform",
    "Oracle ATG": r"atg\.commerce|oracle.*atg|dynamo",
    "Vtex": r"vtex\.com|vteximg\.com|vtexassets\.com",
    "Spryker": r"spryker|yves|zed\.",
    "Drupal": "drupal|sites/default|sites/all",
    "Joomla": "joomla",
    "Contentful": r"contentful\.com",
    "Strapi": "strapi",
    "Ghost": r"ghost\.org|ghost\.io",
    "Sitecore": "sitecore",
    "Adobe Experience Manager": r"aem\.|\baem\b|adobe.*experience",
    "React": r"react(?:\.js)?|react-dom|__react",
    "Vue.js": r"vue(?:\.js)?|vuejs|__vue",
    "Angular": r"angular(?:\.js)?|ng-app|ng-controller",
    "Svelte": "svelte",
    "Next.js": r"next(?:\.js)?|_next/static|__NEXT_DATA__",
    "Nuxt.js": r"nuxt(?:\.js)?|__NUXT__",
    "Gatsby": "gatsby|___gatsby",
    "Ember.js": r"ember(?:\.js)?",
    "jQuery": r"jquery(?:[.-]\d+)?\.(?:min\.)?js",
    "Lodash": "lodash|underscore",
    "Moment.js": r"moment(?:\.js)?",
    "D3.js": r"d3(?:\.js)?|d3\.v[0-9]",
    "Three.js": r"three(?:\.js)?|three\.min",
    "Chart.js": r"chart(?:\.js)?",
    "GSAP": "gsap|TweenMax|TimelineLite",
    "Swiper": "swiper",
    "Slick": "slick(?:-carousel)?",
    "Bootstrap": r"bootstrap(?:\.min)?\.css|bootstrap\.css",
    "Tailwind CSS": "tailwind",
    "Foundation": r"foundation\.css|zurb",
    "Bulma": "bulma",
    "Material-UI": "material-ui|mui",
    "Hotjar": "hotjar",
    "Mixpanel": "mixpanel",
    "Amplitude": "amplitude",
    "Heap": "heap",
    "Matomo": "matomo|piwik",
    "Adobe Analytics": r"adobe.*analytics|omniture|s_code\.js",
    "Coremetrics": "coremetrics|cmcreate|eluminate",
    "Crazy Egg": "crazyegg",
    "FullStory": "fullstory",
    "LogRocket": "logrocket",
    "Facebook Pixel": r"facebook.*pixel|fbevents\.js|fbq\(",
    "Taboola": "taboola",
    "Outbrain": "outbrain",
    "Criteo": "criteo",
    "AdRoll": "adroll",
    "HubSpot": "hubspot|hs-analytics|_hsp",
    "Marketo": "marketo|munchkin",
    "Pardot": "pardot",
    "Mailchimp": "mailchimp",
    "Klaviyo": "klaviyo",
    "Eloqua": "eloqua",
    "SendGrid": "sendgrid",
    "Salesforce Marketing Cloud": "salesforce.*marketing|exacttarget",
    "Algolia": "algolia|algoliasearch",
    "Elasticsearch": r"elasticsearch|elastic\.co",
    "Apache Solr": "solr|apache.*solr",
    "Swiftype": "swiftype",
    "Coveo": "coveo",
    "Searchspring": "searchspring",
    "Constructor.io": r"constructor\.io",
    "Bloomreach": "bloomreach|brxm",
    "Optimizely": "optimizely",
    "VWO": "vwo|visualwebsiteoptimizer",
    "Adobe Target": r"adobe.*target|mbox\.js",
    "Dynamic Yield": r"dynamic.*yield|dy\.js",
    "Monetate": "monetate",
    "Nosto": r"nosto\.com|nostojs",
    "RichRelevance": "richrelevance|r3_common",
    "Barilliance": "barilliance",
    "Certona": "certona",
    "Intercom": r"intercom|intercom\.io",
    "Drift": r"drift\.com|driftt\.com",
    "Zendesk Chat": "zendesk.*chat|zopim",
    "LiveChat": "livechat",
    "Olark": "olark",
    "Tawk.to": r"tawk\.to",
    "Stripe": r"stripe|stripe\.com|js\.stripe\.com",
    "PayPal": r"paypal|paypalobjects\.com",
    "Square": r"square|squareup\.com",
    "Braintree": "braintree|braintreegateway",
    "Adyen": "adyen",
    "Klarna": "klarna",
    "Afterpay": "afterpay",
    "Affirm": "affirm",
    "Wistia": r"wistia\.com|fast\.wistia",
    "Brightcove": "brightcove",
    "JW Player": "jwplayer|jwplatform",
    "GraphQL": "graphql|/graphql|apollo-client|@apollo/client",
    "Apollo": "apollo.*client|apollo.*server|apollographql",
    "Relay": r"relay\.js|react-relay",
}
#: The same, as written.
AS_WRITTEN = {
    "Google Font API": r"fonts\.googleapis\.com",
    "Google Analytics": r"google-analytics\.com|ga\.js|analytics\.js",
    "Google Tag Manager": r"googletagmanager\.com|gtm\.js",
    "Google AdSense": r"googlesyndication\.com|adsbygoogle",
    "Google DoubleClick": r"doubleclick\.net|googleadservices\.com",
    "Google Ads": r"googleadservices\.com|google\.com/ads",
    "Google Maps": r"maps\.googleapis\.com|maps\.google\.com",
    "Google Optimize": r"optimize\.google\.com",
    "Adobe Fonts": r"fonts\.adobe\.com|typekit",
    "Shopify": r"shopify\.com|cdn\.shopify\.com|myshopify\.com",
    "BigCommerce": r"bigcommerce\.com",
    "WordPress": "wp-content|wp-includes|/wp-json/",
    "Segment": r"segment\.com|analytics\.js",
    "LinkedIn Insight Tag": r"linkedin\.com/in/px/|_linkedin_partner_id",
    "Bing Ads": r"bing\.com/uet|bat\.bing\.com",
    "YouTube": r"youtube\.com|youtu\.be|youtube-nocookie\.com",
    "Vimeo": r"vimeo\.com|player\.vimeo",
}
#: Technology, header and what its value holds ("" for anything); a header ending in * is a prefix.
HEADERS = (
    ("Nginx", "server", "nginx"),
    ("Apache", "server", "apache"),
    ("Cloudflare", "server", "cloudflare"),
    ("Microsoft IIS", "server", "iis"),
    ("LiteSpeed", "server", "litespeed"),
    ("OpenResty", "server", "openresty"),
    ("Caddy", "server", "caddy"),
    ("Cloudflare", "cf-ray", ""),
    ("Amazon CloudFront", "x-amz-cf-id", ""),
    ("Fastly", "x-served-by", "fastly"),
    ("Akamai", "x-akamai-transformed", ""),
    ("Varnish", "x-varnish", ""),
    ("Nginx Cache", "x-proxy-cache", "nginx"),
    ("PHP", "x-powered-by", "php"),
    ("ASP.NET", "x-powered-by", "asp.net"),
    ("Express.js", "x-powered-by", "express"),
    ("Next.js", "x-powered-by", "next.js"),
    ("Sucuri", "x-sucuri-id", ""),
    ("Imperva", "x-imperva-cache", ""),
    ("PerimeterX", "x-perimeterx", ""),
    ("Distil Networks", "x-distil", ""),
    ("DataDome", "x-datadome", ""),
    ("Shopify", "x-shopify-stage", ""),
    ("Webflow", "x-wf-*", ""),
    ("Next.js", "x-nextjs", ""),
    ("Vercel", "x-vercel-*", ""),
    ("Netlify", "x-netlify*", ""),
    ("AWS", "x-aws-*", ""),
    ("Azure", "x-azure-*", ""),
    ("Google Cloud", "x-goog-*", ""),
)
#: Categories in the order of their precedence; what is in none is Other.
CATEGORIES = {
    "CMS": "WordPress, Drupal, Joomla, Wix, Squarespace, Webflow, Contentful, Strapi, Ghost, Sitecore, Adobe Experience Manager",
    "Ecommerce": "Shopify, WooCommerce, Magento/Adobe Commerce, BigCommerce, Salesforce Commerce Cloud, SAP Commerce Cloud, Oracle ATG, commercetools, Salesforce B2C Commerce, Vtex, Spryker",
    "JavaScript Frameworks": "React, Vue.js, Angular, Svelte, Next.js, Nuxt.js, Gatsby, Ember.js",
    "JavaScript Libraries": "jQuery, Lodash, Moment.js, D3.js, Three.js, Chart.js, GSAP, Swiper, Slick",
    "CSS Frameworks": "Bootstrap, Tailwind CSS, Foundation, Bulma, Material-UI",
    "Font Services": "Google Font API, Adobe Fonts, Font Awesome",
    "CDN": "Cloudflare, Amazon CloudFront, Fastly, Akamai, jsDelivr, unpkg, StackPath, KeyCDN, BunnyCDN",
    "Analytics": "Google Analytics, Google Tag Manager, Adobe Analytics, Hotjar, Mixpanel, Segment, Heap, Matomo, Amplitude, Crazy Egg, FullStory, LogRocket, Coremetrics",
    "Advertising": "Google Ads, Google AdSense, Google DoubleClick, Facebook Pixel, LinkedIn Insight Tag, Bing Ads, Taboola, Outbrain, Criteo, AdRoll",
    "Marketing Automation": "HubSpot, Marketo, Pardot, Mailchimp, Klaviyo, Drift, Intercom, Eloqua, Salesforce Marketing Cloud, SendGrid",
    "Personalization": "Optimizely, VWO, Adobe Target, Dynamic Yield, Monetate, RichRelevance, Nosto, Barilliance",
    "Search": "Algolia, Elasticsearch, Apache Solr, Swiftype, Coveo, Searchspring, Constructor.io, Bloomreach",
    "Recommendation Engines": "Certona",
    "Web Servers": "Apache, Nginx, Microsoft IIS, LiteSpeed, OpenResty, Caddy",
    "Programming Languages": "PHP, ASP.NET",
    "Backend Frameworks": "Express.js",
    "Caching": "Varnish, Nginx Cache",
    "Payment": "Stripe, PayPal, Square, Braintree, Adyen, Klarna, Afterpay, Affirm",
    "Video": "YouTube, Vimeo, Wistia, Brightcove, JW Player",
    "Live Chat": "Zendesk Chat, LiveChat, Olark, Tawk.to",
    "A/B Testing": "Google Optimize",
    "Security": "Sucuri, Imperva, PerimeterX, Distil Networks, DataDome",
    "API Technologies": "GraphQL, Apollo, Relay",
    "Hosting Platforms": "Vercel, Netlify, AWS, Azure, Google Cloud",
}


def _alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern outside its groups."""
    parts, depth = [""], 0
    for sign in re.findall(r"\\.|.", pattern):
        depth += (sign == "(") - (sign == ")")
        if sign == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += sign
    return parts


def _required(part: str) -> str:
    """The longest run of lower-case characters that whatever ``part`` finds must hold; empty if there is none."""
    runs, depth = [""], 0
    for sign, quantifier in re.findall(r"(\\.|\[[^\]]*\]|.)([*?+]?)", part):
        depth += (sign == "(") - (sign == ")")
        plain = sign[1:] if re.fullmatch(r"\\[.()]", sign) else sign
        if depth or len(plain) > 1 or sign in "().^$|" or quantifier in ("*", "?"):
            runs.append("")
            continue
        runs[-1] += plain.lower()
        if quantifier:
            runs.append("")
    return max(runs, key=len)


def _probe(html: Column, low: Column, pattern: str, any_case: bool) -> Column:
    """Substring tests for plain alternatives; a regular expression runs where the text that it needs is found."""
    out = None
    for part in _alternatives(pattern):
        bare, needed = part.replace("\\.", ".").replace("\\(", "("), _required(part)
        if not re.search(r"[\\*?\[\]{}^$+|]|\(\?", bare):
            test = F.contains(low if any_case else html, F.lit(bare.lower() if any_case else bare))
        elif re.fullmatch(re.escape(needed).replace(r"\ ", " ") + r"\(\?:[^()]*\)\?", part):  # what follows may be missing
            test = F.contains(low if any_case else html, F.lit(needed))
        else:
            test = html.rlike(("(?i)" if any_case else "") + part)
            test = F.contains(low, F.lit(needed)) & test if len(needed) > 1 else test
        out = test if out is None else out | test
    return out


def _header_test(header: str, value: str):
    def holds(e):
        named = F.startswith(e["k"], F.lit(header[:-1])) if header.endswith("*") else e["k"] == header
        return named & F.contains(e["v"], F.lit(value)) if value else named & (e["v"] != "")

    return holds


def detect(html: Column, headers: Column) -> Column:
    """The sorted distinct technologies of a page: one array expression a row, no join of pages and signatures.

    The page is lower-cased once, and nearly all signatures are looked for as plain text first.
    """
    return let(F.struct(html.alias("html"), F.lower(html).alias("low"), headers.alias("headers")), lambda page: _detect(page["html"], page["low"], page["headers"]))


def _detect(html: Column, low: Column, headers: Column) -> Column:
    found = [F.when(_probe(html, low, p, True), name) for name, p in ANY_CASE.items()]
    found += [F.when(_probe(html, low, p, False), name) for name, p in AS_WRITTEN.items()]
    found.append(F.when(F.contains(low, F.lit("<div")) & html.rlike(r'(?i)<(?:div)[^>]*\sid="(?:root|app)"'), "React"))
    found.append(F.when(F.contains(low, F.lit("fa-")) & html.rlike(r'(?i)<i[^>]*class="[^"]*fa-'), "Font Awesome"))
    found.append(F.when(F.contains(low, F.lit("wordpress")) & html.rlike(r'(?i)<meta[^>]*name="generator"[^>]*content="[^"]*wordpress'), "WordPress"))
    names = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("k"), F.lower(e["value"]).alias("v")))
    for name, header, value in HEADERS:
        found.append(F.when(F.coalesce(F.exists(names, _header_test(header, value)), F.lit(False)), name))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


def category(technology: Column) -> Column:
    """The first category that lists a technology."""
    out = None
    for name, listed in CATEGORIES.items():
        test = technology.isin(*listed.split(", "))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("Other")


def summary(found: Column) -> Column:
    """struct of the number of technologies and the first shop, CMS and server by name."""
    first = lambda c: F.try_element_at(F.filter(found, lambda t: category(t) == c), F.lit(1))
    return F.struct(F.size(found).alias("technologies"), first("Ecommerce").alias("ecommerce"), first("CMS").alias("cms"), first("Web Servers").alias("server"))


def version(script: Column) -> Column:
    """The first x.y.z of a script's address, or null."""
    return F.nullif(F.regexp_extract(script, r"([0-9]+\.[0-9]+\.[0-9]+)", 1), F.lit(""))
