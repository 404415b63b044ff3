"""Fields of a type from a page's structured data, and from its elements where that lacks them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.operators import extraction, markup

#: For each type, the elements that stand for a field which structured data lacks: classes as ``.name``, else tags, or links that begin so.
FALLBACKS: dict[str, dict[str, tuple[str, ...]]] = {
    "Product": {
        "name": (".product-title", ".product-name", "h1"), "price": (".price", ".cost", ".amount"), "description": (".description", ".product-description"),
        "brand": (".brand", ".manufacturer"), "sku": (".sku", ".product-id"),
    },
    "Organization": {
        "name": (".company-name", ".organization-name", "h1"), "description": (".description", ".about", ".company-description"), "address": (".address", ".location"),
        "telephone": (".phone", ".tel", "tel:"), "email": ("mailto:",), "url": (".website", ".url"),
    },
    "LocalBusiness": {
        "name": (".business-name", ".company-name", "h1"), "address": (".address", ".location"), "telephone": (".phone", ".tel", "tel:"), "openingHours": (".hours", ".opening-hours"), "priceRange": (".price-range", ".pricing"),
    },
    "Article": {"headline": ("h1", ".headline", ".title"), "author": (".author", ".byline"), "datePublished": ("time", ".date", ".published"), "articleBody": (".content", ".article-content", ".post-content")},
}


def _matches(selectors: Sequence[str]):
    tests = []
    for s in selectors:
        if s.startswith("."):
            tests.append(F.array_contains("classes", s[1:]))
        elif s.endswith(":"):
            tests.append(F.coalesce((F.col("tag") == "a") & F.col("attributes")["href"].startswith(s), F.lit(False)))
        else:
            tests.append(F.col("tag") == s)
    return reduce(lambda a, b: a | b, tests)


def hybrid_fields(pages: DataFrame, key: str, kind: str, fallbacks: Mapping[str, Sequence[str]] | None = None, html: str = "html") -> DataFrame:
    """(key, field, value, source): each field of the type ``kind`` once, from JSON-LD, else microdata, else RDFa, else the first element of its fallbacks with a text.

    JSON-LD counts scalar values; microdata and RDFa the content, else the whole text, of
    properties inside an element of the type; blank values count as missing.
    """
    wanted = dict(FALLBACKS[kind] if fallbacks is None else fallbacks)
    nodes = markup.element_table(pages, key, html)
    scripts = extraction.json_ld(pages, key, html).where(F.col("type") == kind)
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.get_json_object("json", f"$.{f}").alias("value")) for f in wanted]))
    found = [scripts.select(key, "pos", fields.alias("x")).select(key, "x.*", F.lit(0).alias("rank"), F.col("pos").alias("at"), F.lit("json_ld").alias("source"))]
    last = lambda c: F.substring_index(F.col("attributes")[c], "/", -1)
    for rank, (source, typed, named) in enumerate((("microdata", "itemtype", "itemprop"), ("rdfa", "typeof", "property")), 1):
        holders = nodes.where(last(typed) == kind).select(key, F.col("pre").alias("c_pre"), F.col("last").alias("c_last"))
        marked = nodes.where(F.col("attributes")[named].isin(*wanted))
        texts = markup.with_text(marked, nodes, key).select(key, "pre", F.col("attributes")[named].alias("field"), F.coalesce(F.nullif(F.col("attributes")["content"], F.lit("")), F.col("text")).alias("value"))
        met = markup.descendants(holders, texts, key)
        found.append(met.select(key, "field", "value", F.lit(rank).alias("rank"), F.col("pre").alias("at"), F.lit(source).alias("source")))
    names = F.array_compact(F.array(*[F.when(_matches(s), F.lit(f)) for f, s in wanted.items()]))
    able = markup.with_text(nodes.withColumn("names", names).where("size(names) > 0"), nodes, key)
    # A link without a text stands for its target.
    text = F.coalesce(F.nullif("text", F.lit("")), F.regexp_extract(F.col("attributes")["href"], "^(?:tel|mailto):(.*)$", 1))
    found.append(able.select(key, F.explode("names").alias("field"), text.alias("value"), F.lit(3).alias("rank"), F.col("pre").alias("at"), F.lit("elements").alias("source")))
    rows = reduce(DataFrame.unionByName, found).where(F.trim("value") != "")
    best = F.min_by(F.struct("value", "source"), F.struct("rank", "at"))
    return rows.groupBy(key, "field").agg(best.alias("x")).select(key, "field", "x.value", "x.source")
