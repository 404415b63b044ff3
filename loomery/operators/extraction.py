"""HTML to rows: structured data, tables, lists, forms and navigation, by SQL functions.

Each function explodes a page's blocks into one row per block; nested blocks of one
kind end at the first closing tag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.functions import text as tx


def _blocks(html: Column, tag: str) -> Column:
    return F.regexp_extract_all(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), F.lit(rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>"), F.lit(0))


def _explode(pages: DataFrame, key: str, html: str, tag: str) -> DataFrame:
    return pages.select(key, F.posexplode(_blocks(F.col(html), tag)).alias("pos", "block"))


def json_ld(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, pos, type, json) of every JSON-LD script."""
    scripts = F.regexp_extract_all(F.col(html), F.lit(r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    rows = pages.select(key, F.posexplode(scripts).alias("pos", "json"))
    return rows.select(key, "pos", F.get_json_object("json", "$.@type").alias("type"), "json").where("type IS NOT NULL")


def open_graph(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, property, content) of Open Graph tags, without their prefix."""
    tags = F.regexp_extract_all(F.col(html), F.lit(r"""(?is)<meta\b[^>]*\bproperty\s*=\s*["']og:[^>]*>"""), F.lit(0))
    rows = pages.select(key, F.explode(tags).alias("tag"))
    return rows.select(key, F.regexp_extract("tag", r"""(?i)property\s*=\s*["']og:([^"']*)["']""", 1).alias("property"), F.regexp_extract("tag", r"""(?i)\bcontent\s*=\s*["']([^"']*)["']""", 1).alias("content"))


def microdata(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, property, value): itemprop values, from content, else href, else text."""
    items = F.regexp_extract_all(F.col(html), F.lit(r"""(?is)<[a-z0-9]+\b[^>]*\bitemprop\s*=\s*["'][^"']*["'][^>]*>[^<]*"""), F.lit(0))
    rows = pages.select(key, F.explode(items).alias("x"))
    pick = lambda p: F.nullif(F.regexp_extract("x", p, 1), F.lit(""))
    value = F.coalesce(pick(r"""(?i)\bcontent\s*=\s*["']([^"']*)["']"""), pick(r"""(?i)\bhref\s*=\s*["']([^"']*)["']"""), F.trim(F.regexp_extract("x", r"(?s)>([^<]*)$", 1)))
    return rows.select(key, F.regexp_extract("x", r"""(?i)\bitemprop\s*=\s*["']([^"']*)["']""", 1).alias("property"), value.alias("value"))


def tables(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, pos, rows, cells, has_header, confidence) of tables with two rows and four cells or more."""
    count = lambda p: F.regexp_count("block", F.lit(p))
    out = _explode(pages, key, html, "table").select(key, "pos", count(r"(?i)<tr\b").alias("rows"), count(r"(?i)<t[dh]\b").alias("cells"), (count(r"(?i)<th\b") > 0).alias("has_header"))
    bonus = F.when(F.col("has_header"), 0.2).otherwise(0.0) + F.when(F.col("rows") > 3, 0.1).otherwise(0.0) + F.when(F.col("cells") > 10, 0.1).otherwise(0.0)
    return out.where("rows >= 2 AND cells >= 4").withColumn("confidence", 0.5 + bonus)


def table_cells(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, pos, row, cell, value, type) of every table cell, with its inferred type."""
    rows = _explode(pages, key, html, "table").select(key, "pos", F.posexplode(_blocks(F.col("block"), "tr")).alias("row", "tr"))
    found = F.regexp_extract_all(F.col("tr"), F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), F.lit(1))
    cells = rows.select(key, "pos", "row", F.posexplode(found).alias("cell", "raw"))
    value = tx.without_scripts(F.col("raw"))
    return cells.select(key, "pos", "row", "cell", value.alias("value"), tx.data_type(value).alias("type"))


def lists(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, pos, items) of ul and ol lists."""
    both = F.concat(_blocks(F.col(html), "ul"), _blocks(F.col(html), "ol"))
    return pages.select(key, F.posexplode(both).alias("pos", "block")).select(key, "pos", F.regexp_count("block", F.lit(r"(?i)<li\b")).alias("items")).where("items > 0")


def forms(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, pos, fields, kind) of forms with two fields or more."""
    rows = _explode(pages, key, html, "form").select(key, "pos", F.regexp_count("block", F.lit(r"(?i)<(?:input|select|textarea)\b")).alias("fields"), F.lower("block").alias("low"))
    has = lambda *words: tx.has_any(F.col("low"), words)
    kind = F.when(has("password") & has("confirm", "register", "sign up"), "registration").when(has("password"), "login").when(has("search"), "search").when(has("newsletter", "subscribe"), "newsletter").when(has("message", "contact"), "contact").otherwise("general")
    return rows.where("fields >= 2").select(key, "pos", "fields", kind.alias("kind"))


def navigation(pages: DataFrame, key: str, html: str = "html", least: int = 3) -> DataFrame:
    """(key, pos, links, first_links) of navigation blocks with enough links."""
    rows = _explode(pages, key, html, "nav").select(key, "pos", tx.hrefs(F.col("block")).alias("found"))
    return rows.where(F.size("found") >= least).select(key, "pos", F.size("found").alias("links"), F.slice("found", 1, 10).alias("first_links"))


def fields(pages: DataFrame, key: str, patterns: dict[str, str], html: str = "html") -> DataFrame:
    """One row per page with one column per named regular expression (first group), null where absent."""
    return pages.select(key, *[F.nullif(F.trim(F.regexp_extract(html, p, 1)), F.lit("")).alias(n) for n, p in patterns.items()])
