"""Crawl filters: boolean columns over a URL and its depth, combined with & and |."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomery.functions import urls

#: Path endings that are not pages.
BLOCKED_SUFFIXES = (
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".svg", ".ico",
    ".mp4", ".avi", ".mov", ".wmv", ".flv", ".webm", ".mp3", ".wav", ".ogg", ".flac", ".zip", ".rar", ".tar", ".gz", ".7z",
    ".exe", ".msi", ".dmg", ".deb", ".rpm",
)


def any_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def all_of(tests: Sequence[Column]) -> Column:
    """A chain that every test must pass; a test without an answer fails, an empty chain passes."""
    return reduce(lambda a, b: a & F.coalesce(b, F.lit(False)), tests, F.lit(True))


def matches_globs(url: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Exclusion wins; without inclusions everything else passes."""
    wanted = any_of([url.rlike(urls.glob_regex(g)) for g in include]) if include else F.lit(True)
    return wanted & ~any_of([url.rlike(urls.glob_regex(g)) for g in exclude])


def in_domains(url: Column, allowed: Sequence[str] = (), blocked: Sequence[str] = ()) -> Column:
    """Domains match anywhere in the host; blocks come first."""
    name = urls.host(url)
    wanted = any_of([F.contains(name, F.lit(d.lower())) for d in allowed]) if allowed else F.lit(True)
    return wanted & ~any_of([F.contains(name, F.lit(d.lower())) for d in blocked])


def is_page(url: Column, allowed_types: Sequence[str] = (), blocked: Sequence[str] = BLOCKED_SUFFIXES) -> Column:
    """Blocked endings fail; a last segment without a dot counts as text/html."""
    way = F.lower(urls.path(url))
    ends = any_of([way.endswith(x) for x in blocked])
    html = F.contains(F.substring_index(way, "/", -1), F.lit(".")) | F.lit("text/html" in allowed_types) if allowed_types else F.lit(True)
    return ~ends & html


def depth_between(depth: Column, least: int = 0, most: int = 10) -> Column:
    return F.coalesce(depth.between(least, most), F.lit(True))


def segments_between(url: Column, least: int = 0, most: int = 10) -> Column:
    return F.size(urls.segments(url)).between(least, most)


def params_allowed(url: Column, allowed: Sequence[str] = (), blocked: Sequence[str] = (), most: int = 5) -> Column:
    names = urls.query_names(url)
    ok = F.size(names) <= most
    if blocked:
        ok = ok & ~F.arrays_overlap(names, F.array(*[F.lit(b.lower()) for b in blocked]))
    if allowed:
        ok = ok & (F.size(F.array_except(names, F.array(*[F.lit(a.lower()) for a in allowed]))) == 0)
    return ok


def admitted(url: Column, depth: Column, most_depth: int, domains: Sequence[str] = (), include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Admission of a crawl frontier: depth, domain, and plain substrings to include or exclude."""
    wanted = any_of([F.contains(url, F.lit(x)) for x in include]) if include else F.lit(True)
    return (depth <= most_depth) & in_domains(url, domains) & wanted & ~any_of([F.contains(url, F.lit(x)) for x in exclude])


#: Globs and limits of the ready-made chains.
PRESETS = {
    "contact": {"include": ["*/contact*", "*/about*", "*/team*", "*/staff*", "*/leadership*", "*/management*", "*/executive*", "*/office*", "*/location*", "*/address*"], "depth": 3, "segments": 5, "params": 2},
    "product": {"include": ["*/product*", "*/service*", "*/solution*", "*/offering*", "*/catalog*", "*/shop*"], "exclude": ["*/cart*", "*/checkout*", "*/payment*"], "depth": 4},
    "news": {"include": ["*/news*", "*/blog*", "*/article*", "*/post*", "*/press*", "*/announcement*", "*/update*"], "depth": 3, "blocked": ["search", "tag", "filter"]},
    "comprehensive": {"exclude": ["*/admin*", "*/login*", "*/register*", "*/cart*", "*/checkout*", "*/payment*", "*/api/*", "*/download*"], "depth": 4, "segments": 6, "params": 3},
}


def preset(name: str, url: Column, depth: Column) -> Column:
    """One of the ready-made chains."""
    spec = PRESETS[name]
    tests = [matches_globs(url, spec.get("include", ()), spec.get("exclude", ())), depth_between(depth, 0, spec["depth"])]
    if "segments" in spec:
        tests.append(segments_between(url, 0, spec["segments"]))
    if name in ("product", "comprehensive"):
        tests.append(is_page(url, ["text/html"] if name == "product" else ()))
    if "params" in spec or "blocked" in spec:
        tests.append(params_allowed(url, blocked=spec.get("blocked", ()), most=spec.get("params", 5)))
    return all_of(tests)
