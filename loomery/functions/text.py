"""Text and HTML detectors as column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The library of text patterns.
PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"(?:\+\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    "url": r"https?://(?:[-\w.])+(?:\:[0-9]+)?(?:/(?:[\w/_.])*(?:\?(?:[\w&=%.])*)?(?:\#(?:[\w.])*)?)?",
    "date": r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\d{4}[/-]\d{1,2}[/-]\d{1,2}\b",
    "time": r"\b\d{1,2}:\d{2}(?::\d{2})?(?:\s?[AaPp][Mm])?\b",
    "currency": r"\$\d+(?:,\d{3})*(?:\.\d{2})?|\d+(?:,\d{3})*(?:\.\d{2})?\s?(?:USD|EUR|GBP|JPY|CAD|AUD)",
    "social_security": r"\b\d{3}-\d{2}-\d{4}\b",
    "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "zip_code": r"\b\d{5}(?:-\d{4})?\b",
    "credit_card": r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
}
#: Types of a short text, first match wins.
TYPES = {
    "price": r"\$[\d,]+\.?\d*|€[\d,]+\.?\d*|£[\d,]+\.?\d*|[\d,]+\.?\d*\s*(?:USD|EUR|GBP)|Price:?\s*[\d,]+\.?\d*",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\+?1?[-.\s]?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}|\+?[0-9]{1,4}[-.\s]?[0-9]{1,4}[-.\s]?[0-9]{1,4}[-.\s]?[0-9]{1,9}",
    "date": r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}",
    "url": r"https?://[^\s<>\"']+|www\.[^\s<>\"']+|[a-zA-Z0-9-]+\.[a-zA-Z]{2,}[^\s<>\"']+",
    "rating": r"\d+\.?\d*/5|\d+\.?\d*\s*stars?|Rating:?\s*\d+\.?\d*",
    "percentage": r"\d+\.?\d*%|\d+\.?\d*\s*percent",
}
#: Substrings that tell frameworks and bot protection.
FRAMEWORKS = {
    "React": ("react", "data-reactroot", "data-react-checksum", "__REACT_DEVTOOLS"),
    "Vue": ("vue", "data-v-", "__VUE__", "v-if", "v-for"),
    "Angular": ("angular", "ng-app", "ng-controller", "ng-", "[ng-"),
    "jQuery": ("jquery", "$(", "data-toggle"),
    "Svelte": ("svelte", "_svelte"),
    "Turbo": ("turbo", "data-turbo", "turbolinks"),
    "Alpine.js": ("alpine", "x-data", "x-show"),
    "HTMX": ("htmx", "hx-"),
    "Stimulus": ("stimulus", "data-controller"),
}
PROTECTION = {
    "Cloudflare": ("cloudflare", "cf-beacon", "cf-ray"),
    "Distil Networks": ("distil", "distilnetworks"),
    "Imperva": ("imperva", "incapsula"),
    "Bot Protection": ("bot", "protection", "antibot"),
    "Rate Limiting": ("rate limit", "throttle", "rate-limit"),
    "Fingerprinting": ("fingerprint", "canvas", "webgl"),
    "Challenge": ("challenge", "verify", "human"),
}
SECURITY = {
    "HTTPS Links": ("https://",),
    "CSP": ("content-security-policy",),
    "HSTS": ("strict-transport-security",),
    "X-Frame-Options": ("x-frame-options",),
    "SRI": ("integrity=",),
    "CSRF Protection": ("csrf", "_token", "authenticity_token"),
}
LOGIN = ("login", "sign in", "log in", "authentication required", "please log in", "access denied", "unauthorized", "signin", "log-in", "member", "account", "password")


#: What every match of a pattern holds: a cheap look that spares most texts the pattern.
GUARDS = {
    "email": "@", "phone": r"\d{3}", "url": "://", "date": r"\d[/-]\d", "time": r"\d:\d", "currency": r"\d", "social_security": r"\d-\d\d-\d", "ip_address": r"\d\.\d", "zip_code": r"\d{5}", "credit_card": r"\d{4}",
}


def _holds(text: Column, guard: str) -> Column:
    return text.rlike(guard) if "\\" in guard else F.contains(text, F.lit(guard))


def matches(text: Column, name: str) -> Column:
    """Distinct matches of one library pattern, in order of appearance; letters match in either case."""
    pattern = PATTERNS[name]
    # Escapes aside, a pattern without letters needs no folding of case.
    folded = f"(?i){pattern}" if re.search("[A-Za-z]", re.sub(r"\\[a-zA-Z]|\(\?:", "", pattern)) else pattern
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(folded), F.lit(0)))
    return F.when(text.isNull(), F.lit(None)).when(_holds(text, GUARDS[name]), found).otherwise(F.array().cast("array<string>"))


def pattern_confidence(found: Column) -> Column:
    """Confidence of an extraction that found so many pattern types: a base of .3 and a tenth each."""
    return F.least(0.3 + 0.1 * found, F.lit(1.0))


def data_type(text: Column) -> Column:
    """price, email, phone, date, url, rating, percentage, number, boolean or text."""
    t, out = F.trim(text), None
    for name, pattern in TYPES.items():
        test = t.rlike(f"(?i){pattern}")
        out = F.when(test, name) if out is None else out.when(test, name)
    digits = F.regexp_replace(t, "[.,]", "")
    return F.coalesce(out.when(digits.rlike(r"^\d+$"), "number").when(F.lower(t).isin("true", "false", "yes", "no"), "boolean").otherwise("text"), F.lit("text"))


def has_any(text: Column, words: Sequence[str]) -> Column:
    """Whether any of the words occurs in the text; a search for plain characters, not a pattern."""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def labels(text: Column, table: Mapping[str, Sequence[str]]) -> Column:
    """Names whose substrings occur in ``text``, in the table's order."""
    return F.array_compact(F.array(*[F.when(has_any(text, words), name) for name, words in table.items()]))


def needs_login(html: Column) -> Column:
    return has_any(F.lower(html), LOGIN)


def without_scripts(html: Column) -> Column:
    """Visible text: no comments, scripts, styles or tags; basic entities decoded."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def _markup(html: Column) -> Column:
    """Tags only: comments and the insides of scripts and styles are gone."""
    return F.regexp_replace(html, r"(?is)<!--.*?-->|(?<=>)[^<]*(?=</(?:script|style)\s*>)", "")


def tag_count(html: Column, tag: str) -> Column:
    return F.regexp_count(_markup(html), F.lit(rf"(?i)<{tag}\b"))


def structural_features(html: Column) -> dict[str, Column]:
    """Counts and flags of a page's markup."""
    names = {"div_count": "div", "span_count": "span", "p_count": "p", "table_count": "table", "form_count": "form", "image_count": "img", "link_count": "a", "button_count": "button", "input_count": "input", "select_count": "select"}
    out = {"total_tags": F.regexp_count(_markup(html), F.lit(r"(?i)<[a-z][a-z0-9]*\b"))}
    out |= {k: tag_count(html, v) for k, v in names.items()}
    out |= {
        "text_length": F.length(without_scripts(html)),
        "has_json_ld": F.contains(F.lower(html), F.lit("application/ld+json")),
        "has_microdata": html.rlike(r"(?i)<[^>]+\sitemscope\b"),
        "has_tables": tag_count(html, "table") > 0,
        "id_count": F.regexp_count(_markup(html), F.lit(r"(?i)<[a-z][^>]*\sid\s*=")),
        "has_viewport": html.rlike(r"(?i)<meta[^>]+name\s*=\s*[\"']?viewport"),
        "has_charset": html.rlike(r"(?i)<meta[^>]+charset\s*="),
        "title_present": html.rlike(r"(?i)<title\b"),
    }
    return out


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1))


def hrefs(html: Column) -> Column:
    """Link targets of all anchors, in order."""
    return F.regexp_extract_all(_markup(html), F.lit(r"""(?i)<a\b[^>]*?\shref\s*=\s*["']([^"'>]*)["']"""), F.lit(1))


def keywords(text: Column, stop: Sequence[str] = ("the", "and", "for", "with", "from", "this", "that", "are", "was")) -> Column:
    """Distinct lower-case tokens longer than two letters that are no stop words."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"\W+"), lambda w: F.length(w) > 2))
    return F.array_except(words, F.array(*map(F.lit, stop)))


def clean_price(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\d.,]", "")


def relevant_lines(text: Column, least: int = 20) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > least)
