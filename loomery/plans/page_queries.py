"""Queries over page markup and URLs, with SQL oracles.

The tables' pages hold plain prose, so markup that reaches every branch is spliced into
them, in a way that page ids decide; what the stored page holds besides, with its
unclosed elements, comments and scripts, has to be seen or left alone. Where stored
words would count, pages are built from ids alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.functions import inference
from loomery.functions import text as tx
from loomery.operators import extraction, graph, page_fields, url_predicates
from loomery.plans.queries import query, r4
from loomery.session import table



def i() -> Column:
    return F.col("page_id")


def s() -> Column:
    return i().cast("string")


def built(spark: SparkSession, sf: str, *parts: Column | str) -> DataFrame:
    """(page_id, url, html) with markup put together from ``parts``."""
    html = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return table(spark, sf, "pages").select("page_id", "url", html.alias("html"))


def spliced(spark: SparkSession, sf: str, *parts: Column | str) -> DataFrame:
    """(page_id, url, html): the stored pages with ``parts`` before their article."""
    extra = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return table(spark, sf, "pages").select("page_id", "url", F.replace("html", F.lit("<article>"), F.concat(extra, F.lit("<article>"))).alias("html"))


def when(test: Column, *parts: Column | str) -> Column:
    return F.when(test, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).otherwise("")


_SEEN = "regexp_replace(regexp_replace(html, '<!--.*?-->|<script>.*?</script>|<style>.*?</style>', ' ', 'gs'), '<[^>]*>', ' ', 'g')"


@query(f"""WITH t AS (SELECT page_id, {_SEEN} AS t FROM pages), l AS (SELECT page_id, regexp_extract_all(t, '{tx.PATTERNS["email"]}') AS mails, {" || ".join(f"regexp_extract_all(t, '{p}')" for p in page_fields.PHONES)} AS calls FROM t)
SELECT page_id, array_to_string(list_sort(list_distinct(mails || ['sales' || page_id || '@site.org'] || CASE WHEN page_id % 2 = 0 THEN ['info' || page_id || '@site.org'] ELSE [] END)), ',') AS emails,
    array_to_string(list_sort(list_distinct(calls || CASE page_id % 3 WHEN 0 THEN ['+49 30 1234567'] WHEN 1 THEN ['555-123-4567'] ELSE [] END)), ',') AS phones, CASE WHEN page_id % 4 = 0 THEN 'Main Street ' || page_id ELSE '' END AS addresses,
    CASE WHEN page_id % 5 = 0 THEN 'https://twitter.com/u' || page_id ELSE '' END AS social_links, (page_id % 2)::INT AS contact_forms FROM l""")
def page_contacts(spark: SparkSession, sf: str) -> DataFrame:
    rows = spliced(
        spark, sf, when(i() % 2 == 0, '<a href="mailto:info', s(), '@site.org?subject=x">mail</a>'), "<p>write to sales", s(), "@site.org now</p>", '<!-- <b class="phone">123</b> -->',
        F.when(i() % 3 == 0, '<a href="tel:+49 30 1234567">call</a>').when(i() % 3 == 1, "<p>or 555-123-4567</p>").otherwise(""),
        when(i() % 4 == 0, '<div class="box address"><p> Main <b>Street</b> ', s(), " </p></div>"), when(i() % 5 == 0, '<a href="https://twitter.com/u', s(), '">t</a>'), when(i() % 2 == 1, '<form action="/contact/send"><input></form>'),
    )
    return page_fields.contacts(rows, "page_id").select("page_id", *[F.array_join(k, ",").alias(k) for k in ("emails", "phones", "addresses", "social_links")], "contact_forms")


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Head ' || page_id ELSE trim(replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'), '&quot;', '"'), '&amp;', '&'), E' \\n\\t') END AS title, CASE WHEN page_id % 3 = 0 THEN '030-' || page_id END AS phone, CASE WHEN page_id % 5 = 0 THEN 'a' || page_id || '@b.org' END AS email FROM pages""")
def page_headlines(spark: SparkSession, sf: str) -> DataFrame:
    rows = spliced(spark, sf, when(i() % 2 == 0, "<h1> Head <i>", s(), "</i> </h1>"), when(i() % 3 == 0, '<a href="tel:030-', s(), '">x</a>'), when(i() % 5 == 0, '<a href="mailto:a', s(), '@b.org">x</a>'), "<!-- <h1>not this</h1> -->")
    return page_fields.headline_contacts(rows, "page_id")


@query("""SELECT page_id, pos, CASE WHEN pos % 2 = 0 THEN '/p/' || page_id || '/' || pos END AS link, CASE WHEN page_id % 2 = 0 THEN '2024-01-0' || (pos + 1) END AS shown_at, 'Item ' || pos AS name, CASE WHEN pos <> 1 THEN '$' || (page_id + pos) END AS price
    FROM (SELECT page_id, unnest(range((page_id % 4)::BIGINT))::INT AS pos FROM pages)""")
def page_cards(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda n: F.concat(F.lit('<li class="card product"><h3 class="name">Item '), F.lit(str(n)), F.lit("</h3>"), when(F.lit(n != 1), '<b class="price now"><i>$</i>', (i() + n).cast("string"), "</b>"), when(F.lit(n % 2 == 0), '<a href="/p/', s(), f'/{n}">go</a>'), when(i() % 2 == 0, f'<time datetime="2024-01-0{n + 1}">x</time>'), F.lit("</li>"))
    rows = spliced(spark, sf, "<ul>", *[when(i() % 4 > n, one(n)) for n in range(3)], "</ul>")
    return page_fields.cards(rows, "page_id", ("product", "item"), {"name": ("name", "title"), "price": ("price",)})


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'next_button' WHEN 1 THEN 'numbered_pages' WHEN 2 THEN 'load_more' ELSE 'none' END AS kind, CASE WHEN page_id % 4 = 0 THEN 'https://shop.org/list?p=' || page_id END AS next_url,
    CASE WHEN page_id % 4 = 1 THEN 2 ELSE 0 END AS pages, CASE WHEN page_id % 4 = 1 THEN (page_id % 9)::INT ELSE 1 END AS current, CASE WHEN page_id % 8 = 1 THEN 17 WHEN page_id % 4 = 1 THEN 2 ELSE 1 END AS total FROM pages""")
def page_pagination(spark: SparkSession, sf: str) -> DataFrame:
    rows = spliced(
        spark, sf, "<body>", when(i() % 4 == 0, '<a rel="next" href="/list?p=', s(), '">Next</a>'),
        when(i() % 4 == 1, '<div class="pagination"><a href="/a">1</a><a href="/b">2</a><span class="current">', (i() % 9).cast("string"), "</span>", when(i() % 8 == 1, "page 1 of 17"), "</div>"), when(i() % 4 == 2, '<button class="btn load-more">more</button>'), "</body>",
    )
    return rows.select("page_id", page_fields.pagination(F.col("html"), F.lit("https://shop.org/start")).alias("p")).select("page_id", "p.*")


@query("SELECT page_id, page_id % 3 < 2 AS endless, CASE WHEN page_id % 3 = 0 THEN 'spinner' ELSE '' END AS loading, CASE WHEN page_id % 2 = 0 THEN 'feed,timeline' ELSE '' END AS feeds FROM pages")
def page_endless(spark: SparkSession, sf: str) -> DataFrame:
    rows = spliced(spark, sf, "<body>", when(i() % 3 == 0, '<i class="spinner big"></i>'), when(i() % 3 == 1, "<script>new IntersectionObserver(f)</script>"), when(i() % 2 == 0, '<div class="timeline feed"></div>'), '<p class="spinners">x</p></body>')
    found = rows.select("page_id", page_fields.endless(F.col("html")).alias("e"))
    return found.select("page_id", "e.endless", F.array_join("e.loading", ",").alias("loading"), F.array_join("e.feeds", ",").alias("feeds"))


@query("""SELECT page_id, 0 AS pos, 'Person' AS type, 'name' AS property, 'N' || page_id AS value FROM pages UNION ALL SELECT page_id, 0, 'Person', 'age', '7' FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 1, 'Place', 'city', 'C' || page_id FROM pages WHERE page_id % 3 = 0""")
def page_rdfa(spark: SparkSession, sf: str) -> DataFrame:
    rows = spliced(spark, sf, '<div typeof="http://schema.org/Person"><b property="name"> N', s(), " </b>", when(i() % 2 == 0, '<meta property="age" content="7">'), '<i property="empty"></i></div>', when(i() % 3 == 0, '<div typeof="Place"><span property="city">C', s(), "</span></div>"))
    return page_fields.rdfa(rows, "page_id")


@query("SELECT page_id, 'li.card.item' AS selector, 3 + page_id % 2 AS n FROM pages UNION ALL SELECT page_id, 'p.note', 3 FROM pages WHERE page_id % 3 = 0")
def page_repeats(spark: SparkSession, sf: str) -> DataFrame:
    rows = spliced(spark, sf, '<li class="item card">a</li><li class="card item">b</li><LI class="item  card">c</LI>', when(i() % 2 == 1, '<li class="card item">d</li>'), '<p class="note">1</p><p class="note">2</p>', when(i() % 3 == 0, '<p class="note">3</p>'))
    return page_fields.element_counts(rows, "page_id")


@query("""SELECT page_id, round(least(1, CASE WHEN page_id % 3 = 0 THEN 0.3 ELSE (page_id % 2) / (page_id % 3) * 0.3 END + CASE WHEN page_id % 4 = 0 THEN 0.1 ELSE 0 END + (contains(html, '<nav>')::INT + contains(html, '<article>')::INT + contains(html, '<footer>')::INT + (page_id % 2 = 0)::INT) / 7 * 0.3 + CASE WHEN contains(html, '<h1>') THEN 0.2 ELSE 0 END), 4) AS score FROM pages""")
def page_accessibility(spark: SparkSession, sf: str) -> DataFrame:
    rows = spliced(spark, sf, F.repeat(F.lit("<img src=x>"), (i() % 3).cast("int")), when((i() % 2 == 1) & (i() % 3 > 0), "<b alt='x'></b>"), when(i() % 4 == 0, "<i aria-label=a aria-hidden=b></i>"), when(i() % 2 == 0, "<main></main>"))
    return rows.select("page_id", r4(page_fields.accessibility(F.col("html"))).alias("score"))


@query("""SELECT page_id, round(least(1, 0.2 + least((page_id % 8) * 0.08, 0.4) + CASE WHEN page_id % 3 = 0 THEN 0.1 ELSE 0 END), 4) AS news, round(least(1, 0.2 + least((page_id % 5) * 0.1, 0.5)), 4) AS shop FROM pages""")
def page_scores(spark: SparkSession, sf: str) -> DataFrame:
    news = F.array_join(F.slice(F.array(*map(F.lit, page_fields.NEWS_WORDS)), F.lit(1), (i() % 8).cast("int")), " ")
    shop = F.array_join(F.slice(F.array(*map(F.lit, ("cart", "buy", "shop", "checkout"))), F.lit(1), (i() % 5).cast("int")), " ")
    rows = built(spark, sf, "<p>", news, when(i() % 3 == 0, "<time>now</time>"), "</p>").select("page_id", page_fields.news_score(F.col("html")).alias("news"))
    other = built(spark, sf, "<p>", shop, "</p>").select("page_id", page_fields.shop_score(F.col("html")).alias("shop"))
    return rows.join(other, "page_id").select("page_id", r4(F.col("news")).alias("news"), r4(F.col("shop")).alias("shop"))


@query("""SELECT page_id, round(least(CASE page_id % 5 WHEN 0 THEN 0.9 WHEN 1 THEN 0.4 WHEN 2 THEN 0.95 WHEN 3 THEN 0.8 ELSE 0.9 END + CASE WHEN page_id % 2 = 0 THEN 0.1 ELSE 0 END, 1), 4) AS confidence FROM pages""")
def entity_confidence(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda *values: F.get(F.array(*map(F.lit, values)), (i() % 5).cast("int"))
    kind = pick("price", "price", "email", "phone", "date")
    context = F.when(i() % 2 == 0, F.concat(F.lit("the "), F.upper(kind))).otherwise("nothing")
    return table(spark, sf, "pages").select("page_id", r4(page_fields.entity_confidence(pick("$5", "12345678", "a@b.org", "555-1234", "2024-01-05"), kind, context)).alias("confidence"))


@query("""SELECT page_id, page_id % 4 IN (0, 1) AS valid, CASE page_id % 4 WHEN 0 THEN 'https' WHEN 1 THEN 'https' WHEN 2 THEN 'ftp' ELSE '' END AS scheme, CASE page_id % 4 WHEN 0 THEN 'a' || page_id || '.org' WHEN 1 THEN 'b.org' WHEN 2 THEN 'c.org' ELSE '' END AS domain,
    CASE page_id % 4 WHEN 2 THEN 'Invalid scheme: ftp' WHEN 3 THEN 'URL must be a non-empty string' ELSE '' END AS errors, CASE WHEN page_id % 4 = 1 THEN 'Added missing https:// scheme' ELSE '' END AS warnings FROM pages""")
def url_validation(spark: SparkSession, sf: str) -> DataFrame:
    url = F.when(i() % 4 == 0, F.concat(F.lit(" https://a"), s(), F.lit(".org/x "))).when(i() % 4 == 1, "b.org/page").when(i() % 4 == 2, "ftp://c.org/x").otherwise("")
    v = table(spark, sf, "pages").select("page_id", page_fields.url_validation(url).alias("v"))
    return v.select("page_id", "v.valid", "v.scheme", "v.domain", F.array_join("v.errors", ";").alias("errors"), F.array_join("v.warnings", ";").alias("warnings"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'site.co.uk' WHEN 1 THEN 'site' || page_id || '.com' ELSE 'host' END AS registered, page_id % 3 = 0 AS same FROM pages")
def registered_domains(spark: SparkSession, sf: str) -> DataFrame:
    url = F.when(i() % 3 == 0, "https://www.shop.site.co.uk:8080/x").when(i() % 3 == 1, F.concat(F.lit("http://a.b.site"), s(), F.lit(".com/"))).otherwise("http://host/")
    mine = page_fields.registered_domain(url)
    return table(spark, sf, "pages").select("page_id", mine.alias("registered"), (mine == page_fields.registered_domain(F.lit("http://other.site.co.uk"))).alias("same"))


@query("""SELECT page_id, 0 AS pos, 'Product' AS type, 'P' || page_id AS name FROM pages UNION ALL SELECT page_id, 1, 'NewsArticle', NULL FROM pages WHERE page_id % 2 = 0""")
def page_json_ld(spark: SparkSession, sf: str) -> DataFrame:
    rows = spliced(spark, sf, '<script type="application/ld+json">{"@type": "Product", "name": "P', s(), '"}</script>', when(i() % 2 == 0, '<script type="application/ld+json">{"@type": "NewsArticle"}</script>'))
    return extraction.json_ld(rows, "page_id").select("page_id", "pos", "type", F.get_json_object("json", "$.name").alias("name"))


@query("SELECT page_id, 'name' AS property, 'N' || page_id AS value FROM pages UNION ALL SELECT page_id, 'link', '/l' FROM pages UNION ALL SELECT page_id, 'price', '5' FROM pages WHERE page_id % 2 = 0")
def page_microdata(spark: SparkSession, sf: str) -> DataFrame:
    rows = spliced(spark, sf, '<div itemscope><b itemprop="name"> N', s(), ' </b><a itemprop="link" href="/l">x</a>', when(i() % 2 == 0, '<meta itemprop="price" content="5">'), "</div>")
    return extraction.microdata(rows, "page_id")


@query("SELECT page_id, 0 AS pos, (2 + page_id % 3)::INT AS rows, (2 * (2 + page_id % 3))::INT AS cells, page_id % 2 = 0 AS has_header, round(0.5 + CASE WHEN page_id % 2 = 0 THEN 0.2 ELSE 0 END + CASE WHEN page_id % 3 = 2 THEN 0.1 ELSE 0 END, 4) AS confidence FROM pages")
def page_tables(spark: SparkSession, sf: str) -> DataFrame:
    first = F.when(i() % 2 == 0, "<tr><th>a</th><th>b</th></tr>").otherwise("<tr><td>a</td><td>b</td></tr>")
    rows = spliced(spark, sf, "<table>", first, F.repeat(F.lit("<tr><td>1</td><td>2</td></tr>"), (1 + i() % 3).cast("int")), "</table><table><tr><td>x</td></tr></table>")
    return extraction.tables(rows, "page_id").withColumn("confidence", r4(F.col("confidence")))


@query("SELECT page_id, 0 AS pos, 2 AS fields, CASE page_id % 4 WHEN 0 THEN 'login' WHEN 1 THEN 'search' WHEN 2 THEN 'registration' ELSE 'general' END AS kind FROM pages")
def page_forms(spark: SparkSession, sf: str) -> DataFrame:
    inner = F.when(i() % 4 == 0, '<input name="u"><input type="password">').when(i() % 4 == 1, '<input name="search"><select></select>').when(i() % 4 == 2, '<input type="password"><input name="confirm">').otherwise("<input><textarea></textarea>")
    return extraction.forms(spliced(spark, sf, "<form>", inner, "</form><form><input></form>"), "page_id")


@query("SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'price' WHEN 1 THEN 'email' WHEN 2 THEN 'percentage' WHEN 3 THEN 'number' WHEN 4 THEN 'boolean' ELSE 'text' END AS type FROM pages")
def data_types(spark: SparkSession, sf: str) -> DataFrame:
    value = F.get(F.array(*map(F.lit, ("$5.00", "a.b@c.org", "5%", "12", "Yes", "words only"))), (i() % 6).cast("int"))
    return table(spark, sf, "pages").select("page_id", tx.data_type(value).alias("type"))


@query("SELECT page_id, 'https://b.org/x/' || page_id || '?a=1' AS built FROM pages")
def url_build(spark: SparkSession, sf: str) -> DataFrame:
    params = F.create_map(F.lit("a"), F.lit("1"))
    return table(spark, sf, "pages").select("page_id", inference.build_url(F.lit("https://b.org/"), F.concat(F.lit("x/"), s()), params).alias("built"))


@query("SELECT page_id, page_id % 4 = 0 AND page_id % 5 <= 3 AS contact, page_id % 4 = 2 AND page_id % 5 <= 3 AS news FROM pages")
def filter_presets(spark: SparkSession, sf: str) -> DataFrame:
    way = F.get(F.array(*map(F.lit, ("contact/us", "other/page", "news/today", "x"))), (i() % 4).cast("int"))
    url = F.concat(F.lit("https://a.org/en/"), way)
    return table(spark, sf, "pages").select("page_id", url_predicates.preset("contact", url, i() % 5).alias("contact"), url_predicates.preset("news", url, i() % 5).alias("news"))


@query("WITH RECURSIVE t(node, generation) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey < 3 UNION ALL SELECT n.n_nationkey, t.generation + 1 FROM t JOIN nation n ON n.n_nationkey = t.node + 3) SELECT node::VARCHAR AS node, generation FROM t")
def plan_generations(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("n_nationkey")
    needs = table(spark, sf, "nation").select(key.cast("string").alias("node"), F.when(key >= 3, (key - 3).cast("string")).alias("depends_on"))
    return graph.generations(needs).select("node", "generation")
