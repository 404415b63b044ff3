"""Inference over field names, selectors, values and small structures, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomery.functions.text import has_any

#: Standard names of common fields.
FIELD_NAMES = {
    "headline": "title",
    "name": "title",
    "articleBody": "content",
    "datePublished": "publish_date",
    "telephone": "phone",
    "priceRange": "price_range",
    "openingHours": "hours",
}
#: Types of form inputs, and name words that tell a type, in order of precedence.
INPUT_TYPES = {"email": "email", "tel": "phone", "url": "url", "number": "number", "date": "date", "password": "text", "checkbox": "boolean", "radio": "boolean"}
NAME_WORDS = {
    "email": ("email", "mail"),
    "phone": ("phone", "tel", "mobile"),
    "url": ("url", "website", "link"),
    "date": ("date", "birth", "dob"),
    "price": ("price", "cost", "amount"),
    "name": ("name", "first", "last", "full"),
    "address": ("address", "street", "city", "zip"),
}
BLANKS = ("", "null", "none", "n/a", "unknown")


def _lookup(table: Mapping[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def field_name(name: Column) -> Column:
    """Standard name, lower case with underscores."""
    return F.replace(F.lower(F.coalesce(_lookup(FIELD_NAMES, name), name)), F.lit(" "), F.lit("_"))


def input_type(kind: Column, name: Column, element_id: Column) -> Column:
    """Type of a form field by its input type, else by words in its name or id."""
    words, out = F.lower(F.concat_ws(" ", name, element_id)), None
    for label, marks in NAME_WORDS.items():
        test = has_any(words, marks)
        out = F.when(test, label) if out is None else out.when(test, label)
    return F.coalesce(_lookup(INPUT_TYPES, kind), out.otherwise("text"))


def selector_score(selector: Column) -> Column:
    """Reliability of a CSS selector: ids, classes, attributes, tags, and what adds to or takes from them."""
    dots = F.length(selector) - F.length(F.replace(selector, F.lit("."), F.lit("")))
    base = (
        F.when(selector.startswith("#"), 10.0)
        .when(dots > 0, 8.0 + F.least(dots * 0.5, F.lit(2.0)))
        .when(selector.rlike(r"\[") & selector.rlike(r"\]"), 7.0 + F.when(F.contains(selector, F.lit("data-")), 1.0).otherwise(0.0))
        .when(selector.rlike("^[a-zA-Z]+$"), 6.0)
        .otherwise(0.0)
    )
    combined = F.when(selector.rlike("[ >]"), 1.0).otherwise(0.0)
    long_, digits = F.when(F.length(selector) > 100, 2.0).otherwise(0.0), F.when(selector.rlike(r"\d"), 1.0).otherwise(0.0)
    return F.greatest(base + combined - long_ - digits, F.lit(0.0))


def hybrid_confidence(structured: Column, css: Column, final: Column) -> Column:
    """Confidence from the numbers of structured, selected and final fields."""
    parts = F.least(structured * 0.15, F.lit(0.4)) + F.least(css * 0.1, F.lit(0.3)) + F.least(final * 0.05, F.lit(0.2))
    return F.least(0.3 + parts + F.when((structured > 0) & (css > 0), 0.1).otherwise(0.0), F.lit(1.0))


def page_complexity(html: Column) -> Column:
    """high, medium or low, by points for frameworks, scripts, forms, dynamic loading and protection."""
    scripts, forms = F.regexp_count(html, F.lit("<script")), F.regexp_count(html, F.lit("<form"))
    points = (
        F.when(has_any(html, ("react", "vue", "angular")), 3).otherwise(0)
        + F.when(scripts > 20, 2).when(scripts > 10, 1).otherwise(0)
        + F.when(forms > 5, 2).otherwise(0)
        + F.when(has_any(html, ("ajax", "xhr", "fetch", "websocket")), 2).otherwise(0)
        + F.when(has_any(html, ("captcha", "cloudflare", "bot")), 1).otherwise(0)
    )
    return F.when(points >= 6, "high").when(points >= 3, "medium").otherwise("low")


def first_number(text: Column) -> Column:
    """The first decimal number of a text, such as a rating."""
    return F.nullif(F.regexp_extract(text, r"(\d+\.?\d*)", 1), F.lit("")).cast("double")


def unwrap_redirect(url: Column) -> Column:
    """The target of a redirect link, from its ``url`` parameter; other links stay."""
    target = F.regexp_extract(url, r"[?&]url=([^&#]+)", 1)
    return F.when(target != "", F.url_decode(target)).otherwise(url)


def count_phrase(text: Column, noun: str) -> Column:
    """``N-M nouns`` or ``N nouns`` as it stands in a text, else null."""
    return F.nullif(F.regexp_extract(text, rf"(?i)([\d,]+(?:\s*-\s*[\d,]+)?\+?)\s+{noun}", 1), F.lit(""))


def json_object(text: Column) -> Column:
    """The text if it is JSON, else its widest braces if those are, else null."""
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    valid = lambda c: F.get_json_object(c, "$").isNotNull()
    return F.when(valid(text), text).when(valid(inner), inner)


def blank_to_null(value: Column) -> Column:
    return F.when(~F.lower(F.trim(value)).isin(*BLANKS), value)


def build_url(base: Column, path: Column, params: Column) -> Column:
    """Base and path joined by one slash, then the parameters of a map as they are."""
    joined = F.when(path == "", base).otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(path, "^/+", "")))
    pairs = F.array_join(F.transform(F.map_entries(params), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "&")
    return F.concat(joined, F.when(F.size(params) > 0, F.concat(F.lit("?"), pairs)).otherwise(""))


def feature_hash(features: Sequence[Column]) -> Column:
    """Twelve hexadecimal digits of the fields' sorted JSON."""
    return F.substring(F.md5(F.to_json(F.struct(*features))), 1, 12)


def matches_schema(data: Column, schema: Mapping[str, str], required: Sequence[str] = ()) -> Column:
    """Whether a JSON text has the required keys and values of the declared types (string, number, boolean, array, object)."""
    shapes = {"string": r'^[^\[{].*|^$', "number": r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$", "boolean": "^(true|false)$", "array": r"^\[", "object": r"^\{"}
    ok = F.get_json_object(data, "$").isNotNull()
    for name in required:
        ok = ok & F.get_json_object(data, f"$.{name}").isNotNull()
    for name, kind in schema.items():
        value = F.get_json_object(data, f"$.{name}")
        ok = ok & (value.isNull() | value.rlike(f"(?s){shapes[kind]}"))
    return F.coalesce(ok, F.lit(False))


def proxy_weight(success_rate: Column, seconds: Column) -> Column:
    return 0.7 * success_rate + 0.3 / F.greatest(seconds, F.lit(0.1))


def hash_embedding(text: Column, size: int = 384) -> Column:
    """A repeatable vector of ``size`` numbers in [-1, 1] from three SHA-256 digests, zero beyond 24.

    Each four bytes are one signed integer scaled to the range, so every value is
    finite.
    """
    words = []
    for i in range(3):
        digest = F.sha2(F.concat(text, F.lit(f"_{i}")), 256)
        words += [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(8)]
    numbers = [(w - F.when(w >= 2**31, 2**32).otherwise(0)) / float(2**31) for w in words]
    return F.concat(F.array(*numbers), F.array_repeat(F.lit(0.0), size - len(numbers)))
