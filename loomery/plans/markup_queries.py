"""Queries over the element table of stored pages, and of pages that Spark builds from the tables; with SQL oracles.

Stored pages hold traps: paragraphs and bold text without an end, an end tag inside a
script, comments, pages cut before their end. Listing pages are built from parts,
contact pages from suppliers, price pages from nations; their oracles count from the
tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.operators import hybrid, markup, page_patterns
from loomery.operators.markup import PathField
from loomery.plans.queries import query
from loomery.session import table

_DEPTHS = "('html', 1), ('head', 2), ('meta', 3), ('title', 3), ('style', 3), ('script', 3), ('body', 2), ('nav', 3), ('ul', 4), ('li', 5), ('a', 6), ('div', 3), ('article', 3), ('h1', 4), ('p', 4), ('b', 5), ('br', 6), ('footer', 3)"


def r9(c: Column) -> Column:
    return F.round(c.cast("double"), 9)


def clear(sql: str) -> str:
    """SQL for the characters that stored markup writes as references."""
    return f"replace(replace({sql}, '&quot;', '\"'), '&amp;', '&')"


@query(f"SELECT page_id, tag, depth, n FROM (SELECT page_id, tag, depth, len(regexp_extract_all(html, '<' || tag || '[ >]')) AS n FROM pages, (VALUES {_DEPTHS}) t(tag, depth)) WHERE n > 0")
def page_elements(spark: SparkSession, sf: str) -> DataFrame:
    nodes = markup.element_table(table(spark, sf, "pages"), "page_id", keep=False).where("pre > 0")
    return nodes.groupBy("page_id", "tag", "depth").agg(F.count("*").alias("n"))


_ITEMS = f"""l AS (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS links, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1) AS labels FROM pages),
i AS (SELECT page_id, generate_subscripts(links, 1) AS i, trim({clear("unnest(labels)")}) AS label, {clear("unnest(links)")} AS link FROM l)"""


@query(f"""WITH {_ITEMS}, k AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS n FROM i WHERE label <> '' OR link <> '')
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INTEGER AS item, nullif(label, '') AS label, nullif(link, '') AS link,
    round(CASE WHEN n > 1 THEN 0.65 ELSE 0.3 + 0.6 * ((label <> '')::INT + (link <> '')::INT) / 2 + 0.05 * ((length(label) > 10)::INT + (length(link) > 10)::INT) END, 9) AS confidence FROM k""")
def page_path_items(spark: SparkSession, sf: str) -> DataFrame:
    fields = [PathField("label", "a"), PathField("link", "./a[@href]", "attribute", "href")]
    return markup.extract_by_paths(table(spark, sf, "pages"), "page_id", "//nav/ul/li", fields).withColumn("confidence", r9(F.col("confidence")))


_ARTICLE = f"""a AS (SELECT page_id, regexp_extract(html, '<article>(.*?)</article>', 1, 's') AS a FROM pages),
p AS (SELECT page_id, a, string_split(a, '<p>') AS p FROM a),
t AS (SELECT page_id, trim({clear("regexp_extract(a, '<h1>(.*?)</h1>', 1, 's')")}, E' \\n\\t') AS headline, trim({clear("regexp_replace(p[len(p)], '<[^>]*>', '', 'g')")}, E' \\n\\t') AS closing, '<b>' || regexp_extract(a, '<b>(.*?)(?:</b>|</p>|<p>|$)', 1, 's') AS bold, contains(a, '<b>') AS has FROM p)"""


@query(f"""WITH {_ARTICLE} SELECT page_id, 0 AS item, nullif(headline, '') AS headline, nullif(closing, '') AS closing, CASE WHEN has THEN bold END AS bold,
    round(least(0.3 + 0.6 * ((headline <> '')::INT + (closing <> '')::INT + has::INT) / 3 + least(0.05 * ((length(headline) > 10)::INT + (length(closing) > 10)::INT + (has AND length(bold) > 10)::INT), 0.1), 1), 9) AS confidence FROM t""")
def page_path_articles(spark: SparkSession, sf: str) -> DataFrame:
    fields = [PathField("headline", ".//h1"), PathField("closing", "p[last()]"), PathField("bold", ".//p/b", "html")]
    return markup.extract_by_paths(table(spark, sf, "pages"), "page_id", "/html/body/article", fields).withColumn("confidence", r9(F.col("confidence")))


@query("""SELECT page_id, round(CASE WHEN contains(html, '<article>') THEN CASE WHEN contains(html, '<p>') OR contains(html, '<br>') OR contains(html, '<h1>') THEN 0.7 + 0.1 * (contains(html, '<h1>')::INT + (len(regexp_extract_all(html, '<p>')) > 2)::INT + contains(html, '<br>')::INT) ELSE 0.4 END ELSE 0.2 END, 9) AS confidence FROM pages""")
def page_path_readiness(spark: SparkSession, sf: str) -> DataFrame:
    fields = [PathField("headline", "h1"), PathField("third", "p[3]"), PathField("break", ".//b/br")]
    return markup.path_readiness(table(spark, sf, "pages"), "page_id", "//article", fields).withColumn("confidence", r9(F.col("confidence")))


@query("""SELECT page_id, (10 + 2 * i)::INTEGER AS pre, '/html/body/nav/ul/li' || CASE WHEN n > 1 THEN '[' || (i + 1) || ']' ELSE '' END AS path, 'li' AS selector FROM (SELECT page_id, n, unnest(range(n)) AS i FROM (SELECT page_id, len(regexp_extract_all(html, '<li>')) AS n FROM pages))
UNION ALL SELECT page_id, (10 + 2 * len(regexp_extract_all(html, '<li>')))::INTEGER, '/html/body/div', 'div.ad' FROM pages WHERE contains(html, '<div class="ad">')""")
def page_absolute_paths(spark: SparkSession, sf: str) -> DataFrame:
    nodes = markup.element_table(table(spark, sf, "pages"), "page_id")
    rows = nodes.where("tag = 'li' OR array_contains(classes, 'ad')")
    return markup.absolute_paths(rows, nodes, "page_id").join(rows.select("page_id", "pre", markup.css_selector().alias("selector")), ["page_id", "pre"])


_SIMILAR = "(2 + CASE WHEN greatest(a.l, b.l) > 0 THEN 1 - abs(a.l - b.l) / greatest(a.l, b.l) ELSE 0 END) / (2 + (greatest(a.l, b.l) > 0)::INT)"


@query(f"""WITH {_ITEMS}, x AS (SELECT page_id, i, length(label) AS l, count(*) OVER (PARTITION BY page_id) AS n FROM i),
g AS (SELECT a.page_id, a.i, b.i AS j, b.l, row_number() OVER (PARTITION BY a.page_id, a.i ORDER BY b.i) AS r, count(*) OVER (PARTITION BY a.page_id, a.i) AS repeats FROM x a JOIN x b ON a.page_id = b.page_id AND (a.i = b.i OR a.i < b.i AND {_SIMILAR} > 0.7) WHERE a.n - a.i >= 3),
c AS (SELECT a.page_id, a.i, any_value(a.repeats) AS repeats, avg({_SIMILAR}) AS consistency FROM g a JOIN g b ON a.page_id = b.page_id AND a.i = b.i AND a.r < b.r AND b.r <= 5 WHERE a.repeats >= 3 GROUP BY 1, 2),
s AS (SELECT *, least(1, 0.5 + consistency * 0.3 + least(repeats / 10, 0.2)) AS confidence FROM c)
SELECT page_id, (8 + 2 * i)::INTEGER AS pre, 'li' AS selector, repeats, round(consistency, 9) AS consistency, round(confidence, 9) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, i) AS place FROM s) WHERE place = 1""")
def page_repeating_structures(spark: SparkSession, sf: str) -> DataFrame:
    nodes = markup.element_table(table(spark, sf, "pages"), "page_id")
    found = page_patterns.repeating_structures(nodes, "page_id")
    return found.withColumn("consistency", r9(F.col("consistency"))).withColumn("confidence", r9(F.col("confidence")))


def joined(spark: SparkSession, sf: str, name: str, key: list[str], order: str, part: Column, head: Column | str, tail: Column | str) -> DataFrame:
    """(page, html): one page for each key, its rows' parts in order between head and tail."""
    rows = table(spark, sf, name).select(F.concat_ws("/", *key).alias("page"), F.struct(order, part.alias("part")).alias("x"), *[(F.lit(x) if isinstance(x, str) else x).alias(n) for n, x in (("head", head), ("tail", tail))])
    pages = rows.groupBy("page").agg(F.array_sort(F.collect_list("x")).alias("xs"), F.first("head").alias("head"), F.first("tail").alias("tail"))
    return pages.select("page", F.concat("head", F.array_join(F.transform("xs", lambda x: x["part"]), ""), "tail").alias("html"))


def s(name: str) -> Column:
    return F.col(name).cast("string")


def when(test: str, *parts: Column | str) -> Column:
    return F.when(F.expr(test), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).otherwise("")


def listing_pages(spark: SparkSession, sf: str, key: list[str]) -> DataFrame:
    """Parts as cards in a grid: a name, now and then an image and a price; old prices stand in comments."""
    price = F.round(F.col("p_retailprice") * 100).cast("long").cast("string")
    card = F.concat(
        F.lit('<div class="product card"><h3 class="name">'), F.col("p_name"), F.lit("</h3>"), when("p_size % 2 = 0", '<img src="/', s("p_partkey"), '.png">'),
        when("p_size % 3 <> 0", '<span class="price"><i>$</i>', price, "</span>"), F.lit('<!-- <b class="price">old</b> --></div>'),
    )
    return joined(spark, sf, "part", key, "p_partkey", card, '<html><body><div class="grid">', "</div></body>")


_CARDS = """cards AS (SELECT {key} AS page, row_number() OVER (PARTITION BY {key} ORDER BY p_partkey) AS i, p_name, p_size % 2 = 0 AS img, p_size % 3 <> 0 AS priced, length(p_name) AS name_l, length(round(p_retailprice * 100)::BIGINT::VARCHAR) + 1 AS price_l, 1 + (p_size % 2 = 0)::INT + 2 * (p_size % 3 <> 0)::INT AS c FROM part),
card AS (SELECT *, name_l + CASE WHEN priced THEN price_l ELSE 0 END AS l, (4 + coalesce(sum(1 + c) OVER (PARTITION BY page ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INTEGER AS pre FROM cards)"""
_ALIKE = "(3 - abs(a.c - b.c) / greatest(a.c, b.c) + CASE WHEN greatest(a.l, b.l) > 0 THEN 1 - abs(a.l - b.l) / greatest(a.l, b.l) ELSE 0 END) / (3 + (greatest(a.l, b.l) > 0)::INT)"


@query(f"""WITH {_CARDS.format(key="p_brand")},
m AS (SELECT a.page, a.i, a.pre, b.i AS j, b.c, b.l, b.img, b.priced, CASE WHEN b.i = a.i THEN 0 WHEN b.i > a.i THEN 1 ELSE 2 END AS turn FROM card a JOIN card b ON a.page = b.page AND (a.i = b.i OR {_ALIKE} > 0.7)),
o AS (SELECT *, count(*) FILTER (turn = 1) OVER (PARTITION BY page, i) AS later, row_number() OVER (PARTITION BY page, i, turn ORDER BY j) AS k FROM m),
g AS (SELECT *, row_number() OVER (PARTITION BY page, i ORDER BY turn, j) AS r, count(*) OVER (PARTITION BY page, i) AS repeats FROM o WHERE turn < 2 OR k <= greatest(1, 9 - later)),
f AS (SELECT page, i, any_value(pre) AS pre, any_value(repeats) AS repeats, count(*) AS names, count_if(priced) AS prices, count_if(img) AS images FROM g WHERE r <= 5 AND repeats >= 3 GROUP BY 1, 2),
n AS (SELECT a.page, a.i, avg({_ALIKE}) AS consistency FROM g a JOIN g b ON a.page = b.page AND a.i = b.i AND a.r < b.r AND b.r <= 5 GROUP BY 1, 2),
q AS (SELECT *, round(least(0.6 + 0.1 * (prices + names), 1), 9) AS confidence FROM f JOIN n USING (page, i))
SELECT page, pre, 'div.product.card' AS selector, repeats, round(consistency, 9) AS consistency, prices, names, images, confidence FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY confidence DESC, pre) AS place FROM q) WHERE place = 1""")
def page_product_patterns(spark: SparkSession, sf: str) -> DataFrame:
    nodes = markup.element_table(listing_pages(spark, sf, ["p_brand"]), "page")
    found = page_patterns.product_patterns(nodes, "page")
    return found.withColumn("consistency", r9(F.col("consistency"))).withColumn("confidence", r9(F.col("confidence")))


@query(f"""WITH {_CARDS.format(key="p_brand")}, n AS (SELECT *, sum(priced::INT) OVER (PARTITION BY page ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS ahead FROM card)
SELECT page, pre AS container, (pre + 2 + img::INT)::INTEGER AS price FROM n WHERE priced AND ahead >= 2""")
def page_price_containers(spark: SparkSession, sf: str) -> DataFrame:
    nodes = markup.element_table(listing_pages(spark, sf, ["p_brand"]), "page")
    return page_patterns.price_containers(nodes, "page")


@query("""SELECT page_id, CASE WHEN page_id % 3 = 1 THEN 'div.entry' ELSE 'article' END AS selector, trim(replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'), '&quot;', '"'), '&amp;', '&'), E' \\n\\t') AS headline, page_id % 2 = 0 AS has_author, page_id % 3 = 1 AS has_date, page_id % 5 = 0 AS has_content,
    round(0.7 + 0.1 * ((page_id % 2 = 0)::INT + (page_id % 3 = 1)::INT + (page_id % 5 = 0)::INT), 9) AS confidence FROM pages""")
def page_article_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Stored articles with a byline, a date in a wrapping element, or a marked body spliced in."""
    inner = F.concat(when("page_id % 2 = 0", '<p class="byline">By <b>Ann</b></p>'), when("page_id % 5 = 0", '<div class="body"></div>'))
    html = F.replace(F.col("html"), F.lit("<article>"), F.concat(when("page_id % 3 = 1", '<div class="entry"><i class="published"></i>'), F.lit("<article>"), inner))
    html = F.replace(html, F.lit("</article>"), F.concat(F.lit("</article>"), when("page_id % 3 = 1", "</div>")))
    nodes = markup.element_table(table(spark, sf, "pages").withColumn("html", html), "page_id")
    found = page_patterns.article_pattern(nodes, "page_id")
    titles = markup.with_text(nodes, nodes, "page_id").select("page_id", F.col("pre").alias("title"), F.col("text").alias("headline"))
    return found.join(titles, ["page_id", "title"]).select("page_id", "selector", "headline", *[F.col(c).isNotNull().alias(f"has_{c}") for c in ("author", "date", "content")], r9(F.col("confidence")).alias("confidence"))


@query("""WITH n AS (SELECT s_nationkey::VARCHAR AS page, count(*) AS emails, count_if(s_acctbal > 0) AS phones, s_nationkey % 2 = 0 AS placed FROM supplier GROUP BY ALL),
c AS (SELECT *, least(1, 0.4 + 0.2 * (emails + phones) + 0.1 * placed::INT) AS confidence FROM n)
SELECT page, 3 AS pre, 'section.info' AS selector, emails, phones, placed AS has_address, round(confidence, 9) AS confidence, round((emails + phones + placed::INT) * round(confidence, 6), 6) AS score FROM c""")
def page_contact_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers of a nation as cards inside one section; an address inside it for some."""
    card = F.concat(F.lit('<div class="card"><p><a href="mailto:s'), s("s_suppkey"), F.lit('@x.org">Mail <b>'), F.col("s_name"), F.lit("</b></a>"), when("s_acctbal > 0", '<a href="tel:', s("s_suppkey"), '">call</a>'), F.lit("</div>"))
    pages = joined(spark, sf, "supplier", ["s_nationkey"], "s_suppkey", card, '<html><body><section class="info">', F.concat(when("s_nationkey % 2 = 0", '<p class="address">Here'), F.lit("</section></body></html>")))
    found = page_patterns.contact_pattern(markup.element_table(pages, "page"), "page")
    return found.select("page", "pre", "selector", "emails", "phones", F.col("address").isNotNull().alias("has_address"), r9(F.col("confidence")).alias("confidence"), "score")


@query("""WITH p AS (SELECT n_regionkey::VARCHAR AS page, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i, n_name, n_nationkey % 2 = 0 AS priced, n_nationkey % 3 = 0 AS listed FROM nation),
q AS (SELECT *, (3 + coalesce(sum(2 + priced::INT + 3 * listed::INT) OVER (PARTITION BY page ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INTEGER AS pre, round(0.6 + 0.2 * priced::INT + 0.1 * listed::INT, 9) AS confidence FROM p)
SELECT page, pre, 'div.plan' AS selector, CASE WHEN priced THEN pre + 2 END AS price, pre + 1 AS name, CASE WHEN listed THEN pre + 2 + priced::INT END AS features, confidence FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY confidence DESC, pre) AS place FROM q) WHERE place = 1""")
def page_pricing_patterns(spark: SparkSession, sf: str) -> DataFrame:
    plan = F.concat(F.lit('<div class="plan"><h2 class="title">'), F.col("n_name"), F.lit("</h2>"), when("n_nationkey % 2 = 0", '<b class="amount">', s("n_nationkey"), "</b>"), when("n_nationkey % 3 = 0", '<ul class="features"><li>x<li>y</ul>'), F.lit("</div>"))
    pages = joined(spark, sf, "nation", ["n_regionkey"], "n_nationkey", plan, "<html><body>", "</body></html>")
    return page_patterns.pricing_patterns(markup.element_table(pages, "page"), "page")


def listed_elements(pages: DataFrame) -> DataFrame:
    """(page, pos, kind, length, tag, classes): the parts of listing cards and their kinds."""
    nodes = markup.element_table(pages, "page", keep=False).where("depth > 4 AND tag <> 'i'")
    kind = F.when(F.col("tag") == "img", "image").when(page_patterns.marked(page_patterns.PRICED), "price").when(page_patterns.marked(page_patterns.NAMED), "name").otherwise("text")
    return nodes.select("page", F.col("pre").alias("pos"), kind.alias("kind"), (F.col("text_to") - F.col("text_from")).alias("length"), "tag", "classes")


@query(f"""WITH {_CARDS.format(key="p_brand || '/' || p_size")}, e AS (SELECT page, pre + 1 AS pos, 'name' AS kind FROM card UNION ALL SELECT page, pre + 2 + img::INT, 'price' FROM card WHERE priced)
SELECT a.page, a.pos AS source, b.pos AS target, 'product_to_price' AS relation, 0.8::DOUBLE AS confidence FROM e a JOIN e b ON a.page = b.page AND a.pos < b.pos AND a.kind = 'name' AND b.kind = 'price'""")
def page_element_relations(spark: SparkSession, sf: str) -> DataFrame:
    return page_patterns.element_relations(listed_elements(listing_pages(spark, sf, ["p_brand", "p_size"])), "page")


@query(f"""WITH {_CARDS.format(key="p_brand")}, t AS (SELECT page, count(*) AS cards, count_if(img) AS images, count_if(priced) AS prices, min(pre + 2) FILTER (img) AS first_image, min(pre + 2 + img::INT) FILTER (priced) AS first_price FROM card GROUP BY 1),
n AS (SELECT *, cards + images + prices AS n, list_filter([CASE WHEN cards >= 0.4 * (cards + images + prices) THEN 'name' END, CASE WHEN prices > 0 AND prices >= 0.4 * (cards + images + prices) THEN 'price' END], lambda x: x IS NOT NULL) AS common FROM t),
o AS (SELECT *, list_transform(list_sort(list_filter([row(0, 'h3'), row(first_image, 'img'), row(first_price, 'span')], lambda x: x[1] IS NOT NULL)), lambda x: x[2]) AS tags, list_transform(list_sort(list_filter([row(0, 'name'), row(first_image, 'image'), row(first_price, 'price')], lambda x: x[1] IS NOT NULL)), lambda x: x[2]) AS kinds FROM n),
c AS (SELECT *, CASE WHEN n > 1 THEN (len(common) / n + CASE WHEN len(tags) = 1 THEN 1 ELSE 0.5 END) / 2 ELSE 1 END AS consistency FROM o)
SELECT page, n, array_to_string(common, ',') AS common_classes, array_to_string(tags, ',') AS tags, array_to_string(kinds, ',') AS kinds, round(consistency, 9) AS consistency, round(least(1, 0.6 + 0.3 * consistency + 0.1 * (len(common) > 0)::INT + 0.1 * (len(kinds) > 1)::INT), 9) AS confidence,
    array_to_string(list_concat(list_transform(common, lambda x: '.' || x), tags, flatten(list_transform(tags, lambda t: list_transform(common, lambda x: t || '.' || x))))[1:5], ',') AS selectors FROM c""")
def page_element_consensus(spark: SparkSession, sf: str) -> DataFrame:
    elements = listed_elements(listing_pages(spark, sf, ["p_brand"]))
    found = page_patterns.element_consensus(elements, ["page"], 0.4)
    lists = [F.array_join(c, ",").alias(c) for c in ("common_classes", "tags", "kinds", "selectors")]
    return found.select("page", "n", *lists, r9(F.col("consistency")).alias("consistency"), r9(F.col("confidence")).alias("confidence"))


@query("""WITH p AS (SELECT page_id, page_id % 4 AS k, trim(replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'), '&quot;', '"'), '&amp;', '&'), E' \\n\\t') AS h FROM pages)
SELECT page_id, 'headline' AS field, CASE k WHEN 0 THEN 'LD ' || page_id WHEN 1 THEN 'Micro ' || page_id ELSE h END AS value, CASE k WHEN 0 THEN 'json_ld' WHEN 1 THEN 'microdata' ELSE 'elements' END AS source FROM p
UNION ALL SELECT page_id, 'author', CASE k WHEN 2 THEN 'Rdf A.' ELSE 'By ' || page_id || ' Ann' END, CASE k WHEN 2 THEN 'rdfa' ELSE 'elements' END FROM p
UNION ALL SELECT page_id, 'datePublished', '2024-01-02', 'json_ld' FROM p WHERE k = 0""")
def page_hybrid_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Stored articles with one kind of structured data spliced in, and a byline for what it lacks."""
    page = F.col("page_id").cast("string")
    data = F.concat(
        when("page_id % 4 = 0", '<script type="application/ld+json">{"@type": "Article", "headline": "LD ', page, '", "author": "", "datePublished": "2024-01-02"}</script>'),
        when("page_id % 4 = 1", '<div itemscope itemtype="https://schema.org/Article"><p itemprop="headline">Micro <b>', page, "</b></p></div>"),
        when("page_id % 4 = 2", '<div typeof="Article"><i property="author" content="Rdf A.">x</i></div>'), F.lit('<!-- <b class="author">no</b> --><p class="byline">By '), page, F.lit(" <b>Ann</b></p>"),
    )
    pages = table(spark, sf, "pages").withColumn("html", F.replace("html", F.lit("<article>"), F.concat(data, F.lit("<article>"))))
    return hybrid.hybrid_fields(pages, "page_id", "Article")
