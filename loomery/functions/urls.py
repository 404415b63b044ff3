"""URL parts, normal forms, categories and predicates as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Path marks of each site category, in order of precedence.
CATEGORY_MARKS = {
    "ecommerce": ("/product/", "/item/", "/shop/", "/store/", "/cart", "/checkout", "/catalog/"),
    "social": ("/profile/", "/user/", "/people/", "/connect/", "/follow", "/friend", "/group/"),
    "news": ("/article/", "/news/", "/story/", "/post/", "/blog/", "/press/"),
    "directory": ("/listing/", "/business/", "/directory/", "/search", "/browse", "/category/"),
}
#: Links that are no pages.
NOT_A_PAGE = r"mailto:|tel:|javascript:|#|\.css$|\.js$|\.jpg$|\.png$|\.gif$|\.pdf$|\.doc$|\.zip$"
URL_IN_TEXT = r"https?://(?:[a-zA-Z0-9$-_@.&+!*(),]|%[0-9a-fA-F]{2})+"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def host(url: Column) -> Column:
    """Lower-case authority, port included."""
    return F.lower(netloc(url))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def segments(url: Column) -> Column:
    """Non-empty path segments."""
    return F.array_remove(F.split(path(url), "/"), "")


def query_names(url: Column) -> Column:
    """Distinct lower-case names of parameters that have a value."""
    given = F.filter(F.split(query(url), "[&;]"), lambda p: p.rlike("^[^=]*=."))
    return F.array_distinct(F.transform(given, lambda p: F.lower(F.substring_index(p, "=", 1))))


def normalize(url: Column) -> Column:
    """Trimmed, with a scheme, lower-case host without default port, no trailing slash, no fragment."""
    trimmed = F.trim(url)
    whole = F.when(scheme(trimmed) == "", F.concat(F.lit("https://"), trimmed)).otherwise(trimmed)
    kind, name, way, ask = scheme(whole), host(whole), path(whole), query(whole)
    name = F.when(kind == "http", F.replace(name, F.lit(":80"), F.lit(""))).when(kind == "https", F.replace(name, F.lit(":443"), F.lit(""))).otherwise(name)
    way = F.when(way.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(way, "/+$", ""))
    return F.concat(kind, F.lit("://"), name, way, F.when(ask != "", F.concat(F.lit("?"), ask)).otherwise(""))


def normalize_link(url: Column) -> Column:
    """An absolute link without fragment and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/+$", "")


def resolve_link(base: Column, link: Column) -> Column:
    """Absolute form of ``link`` found on page ``base``: absolute, scheme-relative, root-relative, query or sibling."""
    origin = F.concat(scheme(base), F.lit("://"), netloc(base))
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme(base), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link == "", base)
        .when(link.startswith("?"), F.concat(origin, path(base), link))
        .when(link.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), link))
        .otherwise(F.concat(origin, folder, link))
    )


def is_false_positive(url: Column) -> Column:
    return F.lower(url).rlike(NOT_A_PAGE)


def category(url: Column) -> Column:
    low, out = F.lower(url), None
    for name, marks in CATEGORY_MARKS.items():
        test = low.rlike("|".join(map(re.escape, marks)))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("general")


def urls_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(URL_IN_TEXT), F.lit(0))


def domain_parts(url: Column) -> Column:
    """struct(domain, subdomain, tld, port, scheme, netloc); the last label is taken as public suffix."""
    bare = F.regexp_replace(F.regexp_replace(host(url), "^.*@", ""), r":\d*$", "")
    labels = F.split(bare, r"\.")
    n = F.size(labels)
    return F.struct(
        F.when(n >= 2, F.array_join(F.slice(labels, n - 1, F.lit(2)), ".")).otherwise(bare).alias("domain"),
        F.when(n > 2, F.array_join(F.slice(labels, F.lit(1), n - 2), ".")).otherwise("").alias("subdomain"),
        F.when(n >= 2, F.element_at(labels, -1)).otherwise("").alias("tld"),
        F.regexp_extract(host(url), r":(\d+)$", 1).alias("port"), scheme(url).alias("scheme"), netloc(url).alias("netloc"),
    )


def shape(url: Column) -> Column:
    """Host with ``homepage``, its only path segment, or ``deep_page``."""
    parts = segments(url)
    return F.concat(host(url), F.lit("_"), F.when(F.size(parts) == 0, "homepage").when(F.size(parts) == 1, F.get(parts, 0)).otherwise("deep_page"))


#: Words in a path that tell the kind of page, in order of precedence.
KINDS = {
    "about_page": ("about", "company", "who-we-are"),
    "contact_page": ("contact", "support", "help"),
    "product_page": ("product", "service", "solution"),
    "content_page": ("news", "blog", "article", "press"),
    "profile_page": ("profile", "team", "people", "staff"),
}


def page_kind(url: Column) -> Column:
    way, out = F.lower(path(url)), None
    for name, words in KINDS.items():
        test = way.rlike("|".join(words))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.when(way.isin("", "/"), "homepage").otherwise("general_page")


def parent_path(url: Column) -> Column:
    """Path of all but the last segment."""
    parts = segments(url)
    return F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "/"))


def site_files(url: Column) -> Column:
    """Places where a site lists its pages: robots and sitemaps."""
    origin = F.concat(scheme(url), F.lit("://"), netloc(url))
    return F.array(*[F.concat(origin, F.lit(x)) for x in ("/robots.txt", "/sitemap.xml", "/sitemap_index.xml", "/sitemaps.xml", "/sitemap/sitemap.xml")])


def glob_regex(glob: str) -> str:
    """Unanchored, case-insensitive regular expression of a glob with * and ?."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob)
    return f"(?i){body}"
