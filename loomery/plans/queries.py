"""Queries over the driver's tables, each with an independent SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.functions import inference
from loomery.functions import text as tx
from loomery.functions import urls
from loomery.operators import clustering, executions, exploration, extraction, graph, merging, rates, records, similarity, trends, url_predicates, url_scores
from loomery.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r4(c: Column) -> Column:
    return F.round(c.cast("double"), 4)


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", "url")


#: Pieces of SQL that several oracles share.
HOST = "lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1))"
PATH = "regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
SEGS = f"list_filter(string_split({PATH}, '/'), lambda x: x <> '')"
ASK = "regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)"


@query(f"SELECT {HOST} AS host, count(*) AS n_pages, count(DISTINCT {PATH}) AS n_paths, max(len({SEGS})) AS max_depth FROM pages GROUP BY 1")
def host_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = pages(spark, sf).select(urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path"), F.size(urls.segments(F.col("url"))).alias("depth"))
    return rows.groupBy("host").agg(F.count("*").alias("n_pages"), F.count_distinct("path").alias("n_paths"), F.max("depth").cast("long").alias("max_depth"))


@query(f"""SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) || '://' || {HOST} || CASE WHEN {PATH} IN ('', '/') THEN '/' ELSE rtrim({PATH}, '/') END
       || CASE WHEN {ASK} <> '' THEN '?' || {ASK} ELSE '' END AS normalized FROM pages""")
def url_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("page_id", urls.normalize(F.col("url")).alias("normalized"))


@query("SELECT page_id, rtrim(regexp_replace(url, '#.*$', ''), '/') AS link FROM pages")
def url_normalize_link(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("page_id", urls.normalize_link(F.col("url")).alias("link"))


@query("""SELECT category, count(*) AS n FROM (SELECT CASE
       WHEN regexp_matches(lower(url), '/product/|/item/|/shop/|/store/|/cart|/checkout|/catalog/') THEN 'ecommerce'
       WHEN regexp_matches(lower(url), '/profile/|/user/|/people/|/connect/|/follow|/friend|/group/') THEN 'social'
       WHEN regexp_matches(lower(url), '/article/|/news/|/story/|/post/|/blog/|/press/') THEN 'news'
       WHEN regexp_matches(lower(url), '/listing/|/business/|/directory/|/search|/browse|/category/') THEN 'directory'
       ELSE 'general' END AS category FROM pages) GROUP BY 1""")
def url_category(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).groupBy(urls.category(F.col("url")).alias("category")).agg(F.count("*").alias("n"))


@query(f"""SELECT page_id, CASE WHEN len(l) >= 2 THEN l[-2] || '.' || l[-1] ELSE h END AS domain, CASE WHEN len(l) > 2 THEN array_to_string(l[1:len(l)-2], '.') ELSE '' END AS subdomain,
       CASE WHEN len(l) >= 2 THEN l[-1] ELSE '' END AS tld, p AS port, s AS scheme, n AS netloc
       FROM (SELECT *, string_split(h, '.') AS l FROM (SELECT page_id, regexp_replace({HOST}, ':[0-9]*$', '') AS h, regexp_extract({HOST}, ':([0-9]+)$', 1) AS p, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS s, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) AS n FROM pages))""")
def url_domain_parts(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("page_id", urls.domain_parts(F.col("url")).alias("p")).select("page_id", "p.domain", "p.subdomain", "p.tld", "p.port", "p.scheme", "p.netloc")


@query(f"SELECT page_id, {HOST} || '_' || CASE len({SEGS}) WHEN 0 THEN 'homepage' WHEN 1 THEN {SEGS}[1] ELSE 'deep_page' END AS shape FROM pages")
def url_shape(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("page_id", urls.shape(F.col("url")).alias("shape"))


@query(f"""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(p, 'about|company|who-we-are') THEN 'about_page' WHEN regexp_matches(p, 'contact|support|help') THEN 'contact_page'
       WHEN regexp_matches(p, 'product|service|solution') THEN 'product_page' WHEN regexp_matches(p, 'news|blog|article|press') THEN 'content_page' WHEN regexp_matches(p, 'profile|team|people|staff') THEN 'profile_page'
       WHEN p IN ('', '/') THEN 'homepage' ELSE 'general_page' END AS kind FROM (SELECT lower({PATH}) AS p FROM pages)) GROUP BY 1""")
def url_page_kind(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).groupBy(urls.page_kind(F.col("url")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"SELECT parent, count(*) AS n FROM (SELECT '/' || array_to_string(s[1:greatest(len(s)-1, 0)], '/') AS parent FROM (SELECT {SEGS} AS s FROM pages)) GROUP BY 1 ORDER BY n DESC, parent LIMIT 10")
def url_parent_paths(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).groupBy(urls.parent_path(F.col("url")).alias("parent")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "parent").limit(10)


@query(f"SELECT page_id, unnest(['/robots.txt', '/sitemap.xml', '/sitemap_index.xml', '/sitemaps.xml', '/sitemap/sitemap.xml']) AS file, regexp_extract(url, '^([a-z]+)', 1) || '://' || regexp_extract(url, '//([^/?#]*)', 1) AS origin FROM pages")
def url_site_files(spark: SparkSession, sf: str) -> DataFrame:
    rows = pages(spark, sf).select("page_id", F.concat(urls.scheme(F.col("url")), F.lit("://"), urls.netloc(F.col("url"))).alias("origin"), F.explode(urls.site_files(F.col("url"))).alias("whole"))
    return rows.select("page_id", F.replace(F.col("whole"), F.col("origin"), F.lit("")).alias("file"), "origin")


@query("SELECT page_id, regexp_matches(lower(url), 'mailto:|tel:|javascript:|#|\\.css$|\\.js$|\\.jpg$|\\.png$|\\.gif$|\\.pdf$|\\.doc$|\\.zip$') AS is_false_positive FROM pages")
def url_false_positive(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("page_id", urls.is_false_positive(F.col("url")).alias("is_false_positive"))


@query("SELECT page_id, regexp_matches(lower(url), '.*/en/.*') OR regexp_matches(lower(url), '.*blog\\..*') AS keeps FROM pages WHERE NOT regexp_matches(lower(url), '.*\\.example\\.net.*utm_.ource.*')")
def filter_globs(spark: SparkSession, sf: str) -> DataFrame:
    kept = pages(spark, sf).where(url_predicates.matches_globs(F.col("url"), exclude=["*.example.net*utm_?ource*"]))
    return kept.select("page_id", url_predicates.matches_globs(F.col("url"), include=["*/en/*", "*blog.*"]).alias("keeps"))


@query(f"SELECT page_id FROM pages WHERE NOT contains({HOST}, 'cheap-pills') AND (contains({HOST}, 'example.com') OR contains({HOST}, 'example.org'))")
def filter_domains(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).where(url_predicates.in_domains(F.col("url"), ["example.com", "example.org"], ["cheap-pills"])).select("page_id")


@query(f"SELECT page_id, len({SEGS}) BETWEEN 1 AND 2 AS short FROM pages")
def filter_segments(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("page_id", url_predicates.segments_between(F.col("url"), 1, 2).alias("short"))


@query(f"SELECT page_id, {ASK} = '' OR (NOT contains({ASK}, 'utm_source=') AND len(string_split({ASK}, '&')) <= 2) AS passes FROM pages")
def filter_params(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("page_id", url_predicates.params_allowed(F.col("url"), blocked=["utm_source"], most=2).alias("passes"))


@query(f"""SELECT page_id, NOT regexp_matches(lower(url), '/admin|/login|/register|/cart|/checkout|/payment|/api/|/download') AND len({SEGS}) BETWEEN 0 AND 6 AND len({SEGS}) <= 4
       AND NOT regexp_matches(lower({PATH}), '\\.(pdf|docx?|xlsx?|pptx?|jpe?g|png|gif|bmp|svg|ico|mp4|avi|mov|wmv|flv|webm|mp3|wav|ogg|flac|zip|rar|tar|gz|7z|exe|msi|dmg|deb|rpm)$')
       AND ({ASK} = '' OR len(string_split({ASK}, '&')) <= 3) AS passes FROM pages""")
def filter_comprehensive(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("page_id", url_predicates.preset("comprehensive", F.col("url"), F.size(urls.segments(F.col("url")))).alias("passes"))


@query(f"SELECT page_id, count(*) FILTER (contains(lower(url), w)) > 0 AS hit, round(least(sum(CASE WHEN list_contains(string_split(lower({PATH}), '/'), w) THEN v WHEN contains(lower(url), w) THEN v / 2 ELSE 0 END) / 3.1, 1), 4) AS score FROM pages, (VALUES ('en', 1.0), ('blog', 0.8), ('example', 0.7), ('es', 0.6)) AS t(w, v) GROUP BY page_id, url")
def score_keywords(spark: SparkSession, sf: str) -> DataFrame:
    words = {"en": 1.0, "blog": 0.8, "example": 0.7, "es": 0.6}
    u = F.col("url")
    return pages(spark, sf).select("page_id", tx.has_any(F.lower(u), list(words)).alias("hit"), r4(url_scores.keyword_score(u, words)).alias("score"))


@query(f"SELECT page_id, round(greatest(0, 1 - len({SEGS}) / 10.0), 4) AS shallow, round(greatest(0, 1 - abs(len({SEGS}) - 3) / 7.0), 4) AS deep FROM pages")
def score_depth(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("page_id", r4(url_scores.depth_score(F.col("url"))).alias("shallow"), r4(url_scores.depth_score(F.col("url"), False, 3)).alias("deep"))


@query(f"""SELECT page_id, greatest(0.5, CASE WHEN regexp_matches(h, '\\.(edu|gov)$') THEN 0.9 ELSE 0.5 END, CASE WHEN regexp_matches(h, '\\.org$') THEN 0.7 ELSE 0.5 END, CASE WHEN regexp_matches(h, '(blog|news)\\.') THEN 0.8 ELSE 0.5 END)::DOUBLE AS score
       FROM (SELECT page_id, {HOST} AS h FROM pages)""")
def score_authority(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("page_id", url_scores.authority_score(F.col("url")).alias("score"))


@query(f"""SELECT page_id, round(least(0.25 * k + 0.25 * greatest(0, 1 - d / 10.0) + 0.25 * a + 0.25 * f, 1), 4) AS score FROM (SELECT page_id,
       least(list_sum(list_transform(['about','contact','product','service','news','team','company','business','information'], lambda w: CASE WHEN list_contains(string_split(lower({PATH}), '/'), w) THEN 1.0 WHEN contains(lower(url), w) THEN 0.5 ELSE 0 END)) / 9, 1) AS k, len({SEGS}) AS d,
       greatest(0.5, CASE WHEN regexp_matches({HOST}, '\\.(edu|gov)$') THEN 0.9 ELSE 0.5 END, CASE WHEN regexp_matches({HOST}, '\\.org$') THEN 0.7 ELSE 0.5 END, CASE WHEN regexp_matches({HOST}, '(blog|news)\\.') THEN 0.8 ELSE 0.5 END) AS a,
       least(0.5 + 0.2 * (regexp_matches(url, '/202[0-9]/')::INT + regexp_matches(url, '/\\d{{4}}/\\d{{2}}/')::INT + contains(lower(url), '/news/')::INT + contains(lower(url), '/blog/')::INT + contains(lower(url), '/press/')::INT + contains(lower(url), '/update/')::INT), 1) AS f FROM pages)""")
def score_comprehensive(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("page_id", r4(url_scores.preset_score("comprehensive", F.col("url"), 1999)).alias("score"))


@query("""SELECT * FROM (SELECT 'l_quantity' AS field, count(l_quantity) AS count, round(avg(l_quantity), 4) AS mean, median(l_quantity) AS median, min(l_quantity) AS min, max(l_quantity) AS max, round(stddev_samp(l_quantity), 4) AS std_dev, round(sum(l_quantity), 2) AS sum FROM lineitem
       UNION ALL SELECT 'l_discount', count(l_discount), round(avg(l_discount), 4), median(l_discount), min(l_discount), max(l_discount), round(stddev_samp(l_discount), 4), round(sum(l_discount), 2) FROM lineitem)""")
def record_profile(spark: SparkSession, sf: str) -> DataFrame:
    p = records.numeric_profile(table(spark, sf, "lineitem").select("l_quantity", "l_discount"))
    return p.select("field", "count", r4(F.col("mean")).alias("mean"), "median", "min", "max", r4(F.col("std_dev")).alias("std_dev"), F.round("sum", 2).alias("sum"))


@query("SELECT event_type, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM events), 4) AS percentage FROM events GROUP BY 1")
def record_group_share(spark: SparkSession, sf: str) -> DataFrame:
    return records.group_share(table(spark, sf, "events"), "event_type").select("event_type", "count", r4(F.col("percentage")).alias("percentage"))


@query("SELECT round(avg(value), 4) AS average, median(value) AS median, min(value) AS min, max(value) AS max, round(max(value) - min(value), 4) AS range, round(stddev_samp(value), 4) AS std_dev FROM events")
def price_statistics(spark: SparkSession, sf: str) -> DataFrame:
    s = records.price_statistics(table(spark, sf, "events").select("value"))
    return s.select(r4(F.col("average")).alias("average"), "median", "min", "max", r4(F.col("range")).alias("range"), r4(F.col("std_dev")).alias("std_dev"))


@query("SELECT p_brand, round(avg(p_retailprice), 4) AS average, min(p_retailprice) AS min, max(p_retailprice) AS max, count(*) AS count FROM part GROUP BY 1")
def price_by_group(spark: SparkSession, sf: str) -> DataFrame:
    s = records.price_statistics(table(spark, sf, "part").select("p_brand", "p_retailprice"), "p_retailprice", "p_brand")
    return s.select("p_brand", r4(F.col("average")).alias("average"), "min", "max", "count")


@query("""WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, (max(o_totalprice) - min(o_totalprice)) / 5 AS w FROM orders)
       SELECT i::INT AS bin, count(o_totalprice) AS count FROM range(5) AS g(i), e LEFT JOIN orders ON CASE WHEN o_totalprice <= lo + w THEN 0 WHEN o_totalprice <= lo + 2 * w THEN 1 WHEN o_totalprice <= lo + 3 * w THEN 2 WHEN o_totalprice <= lo + 4 * w THEN 3 ELSE 4 END = i GROUP BY 1""")
def price_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return records.histogram(table(spark, sf, "orders"), "o_totalprice").select("bin", "count")


_ENTITY_SQL = {
    "organizations": r"\b[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*\s+(?:Inc|Corp|LLC|Ltd|Company|Co)\b",
    "prices": r"\$[\d,]+\.?\d*|\d+\.?\d*\s*(?:USD|EUR|GBP)",
    "dates": r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{4}[-/]\d{1,2}[-/]\d{1,2}",
    "emails": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "urls": r"https?://[^\s]+",
}


@query("SELECT entity_type, count(*) AS n, count(DISTINCT value) AS n_distinct FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS entity_type, unnest(regexp_extract_all(text, '{p}')) AS value FROM documents" for k, p in _ENTITY_SQL.items()) + ") GROUP BY 1")
def entity_counts(spark: SparkSession, sf: str) -> DataFrame:
    found = records.entities(table(spark, sf, "documents"), F.col("text"), list(_ENTITY_SQL))
    pairs = found.groupBy("entity_type", "value").agg(F.count("*").alias("k"))
    return pairs.groupBy("entity_type").agg(F.sum("k").alias("n"), F.count("*").alias("n_distinct"))


@query("WITH c AS (SELECT entity_type, value, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS entity_type, unnest(regexp_extract_all(text, '{p}')) AS value FROM documents" for k, p in _ENTITY_SQL.items()) + """) GROUP BY 1, 2),
       r AS (SELECT *, count(*) OVER (PARTITION BY entity_type) AS n_distinct, row_number() OVER (PARTITION BY entity_type ORDER BY n DESC, value) AS rank FROM c) SELECT entity_type, value, n, n_distinct, rank FROM r WHERE rank <= 5""")
def entity_top(spark: SparkSession, sf: str) -> DataFrame:
    found = records.entity_frequency(table(spark, sf, "documents"), F.col("text"), types=list(_ENTITY_SQL))
    return found.select("entity_type", "value", "n", "n_distinct", F.col("rank").cast("long").alias("rank"))


@query("SELECT value, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '" + _ENTITY_SQL["emails"] + "')) AS value FROM documents) GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
def entity_top_emails(spark: SparkSession, sf: str) -> DataFrame:
    return records.entity_frequency(table(spark, sf, "documents"), F.col("text"), types=["emails"]).select("value", "n")


@query("""WITH s AS (SELECT contains(t,'good')::INT+contains(t,'great')::INT+contains(t,'excellent')::INT+contains(t,'amazing')::INT+contains(t,'love')::INT+contains(t,'best')::INT+contains(t,'wonderful')::INT+contains(t,'fantastic')::INT AS p,
       contains(t,'bad')::INT+contains(t,'poor')::INT+contains(t,'terrible')::INT+contains(t,'hate')::INT+contains(t,'worst')::INT+contains(t,'awful')::INT+contains(t,'horrible')::INT+contains(t,'disappointing')::INT AS n FROM (SELECT lower(text) AS t FROM documents))
       SELECT label, count(*) FILTER (CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END = label) AS count FROM s, (VALUES ('positive'), ('negative'), ('neutral')) AS v(label) GROUP BY 1""")
def sentiment_share(spark: SparkSession, sf: str) -> DataFrame:
    return records.sentiment_share(table(spark, sf, "documents"), F.col("text")).select("label", "count")


@query(" UNION ALL ".join(f"""SELECT '{c}' AS field, round(100.0 * count(NULLIF({c}::VARCHAR, '')) / count(*), 4) AS completeness, count(*) - count(NULLIF({c}::VARCHAR, '')) AS missing_count, count(DISTINCT NULLIF({c}::VARCHAR, '')) AS unique_values,
       round((100.0 * count(NULLIF({c}::VARCHAR, '')) / count(*) + 100.0 * count(DISTINCT NULLIF({c}::VARCHAR, '')) / count(*)) / 2, 4) AS quality_score FROM customer""" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")))
def data_quality(spark: SparkSession, sf: str) -> DataFrame:
    q = records.data_quality(table(spark, sf, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    return q.select("field", r4(F.col("completeness")).alias("completeness"), "missing_count", "unique_values", r4(F.col("quality_score")).alias("quality_score"))


@query("SELECT p_type AS value, count(*) AS count, round(count(*) * 100.0 / (SELECT count(p_type) FROM part), 4) AS percentage FROM part GROUP BY 1 ORDER BY count DESC, value LIMIT 10")
def frequency_table(spark: SparkSession, sf: str) -> DataFrame:
    return records.frequency(table(spark, sf, "part"), "p_type").select("value", "count", r4(F.col("percentage")).alias("percentage"))


@query("SELECT event_id, round(abs((value - m) / s), 4) AS z_score FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) WHERE abs((value - m) / s) > 2.0")
def anomaly_zscore(spark: SparkSession, sf: str) -> DataFrame:
    return records.anomalies(table(spark, sf, "events"), "value", 2.0).select("event_id", r4(F.col("z_score")).alias("z_score"))


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
       a AS (SELECT user_id, n, avg(value) FILTER (k <= n // 2) AS f, avg(value) FILTER (k > n // 2) AS s, max(value) FILTER (k = 1) AS b, max(value) FILTER (k = n) AS e FROM r GROUP BY user_id, n)
       SELECT user_id, CASE WHEN s > f * 1.1 THEN 'increasing' WHEN s < f * 0.9 THEN 'decreasing' ELSE 'stable' END AS trend, b AS start_value, e AS end_value, round(e - b, 4) AS total_change, n AS data_points FROM a WHERE n >= 2""")
def trend_halves(spark: SparkSession, sf: str) -> DataFrame:
    t = records.trend(table(spark, sf, "events"), "value", ["ts", "event_id"], "user_id")
    return t.select("user_id", "trend", "start_value", "end_value", r4(F.col("total_change")).alias("total_change"), "data_points")


@query("""WITH a AS (SELECT user_id, sum(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT user_id, sum(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1)
       SELECT user_id, CASE WHEN a.user_id IS NULL THEN 'only_in_2' WHEN b.user_id IS NULL THEN 'only_in_1' ELSE 'both' END AS side, round(b.v - a.v, 4) AS v_difference, CASE WHEN a.v <> 0 THEN round((b.v - a.v) / a.v * 100, 4) END AS v_percent_change FROM a FULL JOIN b USING (user_id)""")
def compare_datasets(spark: SparkSession, sf: str) -> DataFrame:
    sums = lambda kind: table(spark, sf, "events").where(F.col("event_type") == kind).groupBy("user_id").agg(F.sum("value").alias("v"))
    return records.compare(sums("view"), sums("purchase"), "user_id", ["v"]).select("user_id", "side", r4(F.col("v_difference")).alias("v_difference"), r4(F.col("v_percent_change")).alias("v_percent_change"))


@query("SELECT event_type, count(*) AS uses, count(*) FILTER (value < 10) AS successes, count(*) FILTER (value >= 10) AS failures, round(sum(value), 2) AS total_time, round(avg(value), 4) AS avg_time, round(count(*) FILTER (value < 10) * 1.0 / count(*), 4) AS success_rate FROM events GROUP BY 1")
def tool_performance(spark: SparkSession, sf: str) -> DataFrame:
    p = executions.tool_performance(table(spark, sf, "events"), "event_type", F.col("value") < 10, F.col("value"))
    return p.select("event_type", "uses", "successes", "failures", F.round("total_time", 2).alias("total_time"), r4(F.col("avg_time")).alias("avg_time"), r4(F.col("success_rate")).alias("success_rate"))


@query("""SELECT event_type, n, v[least(n * 50 // 100, n - 1) + 1] AS p50, v[least(n * 95 // 100, n - 1) + 1] AS p95 FROM (SELECT event_type, count(*) AS n, list(value ORDER BY value) AS v FROM events GROUP BY 1)""")
def tool_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return executions.floor_percentiles(table(spark, sf, "events"), "event_type", "value", [50, 95])


@query("SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS date, count(*) AS total_executions, sum(value::DECIMAL(18, 4))::DOUBLE / count(value) AS avg_execution_time, round(count(*) FILTER (value < 10) * 1.0 / count(*), 4) AS success_rate FROM events GROUP BY 1, 2")
def daily_tool_performance(spark: SparkSession, sf: str) -> DataFrame:
    d = executions.daily_performance(table(spark, sf, "events"), "event_type", "ts", F.col("value") < 10, F.col("value").cast("decimal(18,4)"))
    return d.select("event_type", "date", "total_executions", "avg_execution_time", r4(F.col("success_rate")).alias("success_rate"))


@query("""WITH p AS (SELECT event_type AS tool, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_tool FROM events)
       SELECT tool, next_tool, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY tool), 4) AS share FROM p WHERE next_tool IS NOT NULL GROUP BY 1, 2""")
def tool_transitions(spark: SparkSession, sf: str) -> DataFrame:
    t = executions.transitions(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type")
    return t.select("tool", "next_tool", "n", r4(F.col("share")).alias("share"))


@query("""WITH p AS (SELECT conv_id, string_agg(role, ' -> ' ORDER BY turn) AS pattern, bool_and(length(text) > 20) AS ok, count(*) AS k FROM conversations GROUP BY 1)
       SELECT pattern, count(*) AS frequency, round(count(*) FILTER (ok) * 1.0 / count(*), 4) AS success_rate FROM p GROUP BY 1""")
def usage_patterns(spark: SparkSession, sf: str) -> DataFrame:
    p = executions.usage_patterns(table(spark, sf, "conversations"), "conv_id", ["turn"], "role", F.length("text") > 20, F.lit(1.0))
    return p.select("pattern", "frequency", r4(F.col("success_rate")).alias("success_rate"))


@query("SELECT c_nationkey, c_mktsegment, n FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS r FROM customer GROUP BY 1, 2) WHERE r = 1")
def mode_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return executions.modes(table(spark, sf, "customer"), "c_nationkey", "c_mktsegment")


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, count(*) AS n FROM lineitem GROUP BY 1")
def linear_slope(spark: SparkSession, sf: str) -> DataFrame:
    s = executions.linear_slope(table(spark, sf, "lineitem"), "l_returnflag", F.col("l_quantity"), F.col("l_extendedprice"))
    return s.select("l_returnflag", r4(F.col("slope")).alias("slope"), "n")


@query("SELECT p_brand, round(sum(p_retailprice * p_size) / sum(p_size), 4) AS rate, sum(p_size) AS attempts FROM part GROUP BY 1")
def weighted_rate(spark: SparkSession, sf: str) -> DataFrame:
    w = executions.weighted_rate(table(spark, sf, "part"), "p_brand", F.col("p_retailprice"), F.col("p_size"))
    return w.select("p_brand", r4(F.col("rate")).alias("rate"), "attempts")


@query("SELECT round(avg(value), 4) AS avg, max(value) AS max, min(value) AS min, count(value) AS n FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 1440 MINUTE AND ts <= TIMESTAMP '2024-01-20 00:00:00'")
def metrics_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = executions.trailing_summary(table(spark, sf, "events"), "ts", "value", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz" if dict(table(spark, sf, "events").dtypes)["ts"] == "timestamp_ntz" else "timestamp"), 1440)
    return s.select(r4(F.col("avg")).alias("avg"), "max", "min", "n")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS in_window FROM events")
def sliding_rate(spark: SparkSession, sf: str) -> DataFrame:
    return rates.sliding_rate(table(spark, sf, "events"), "user_id", "ts", 3600).select("event_id", "in_window")


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 600 SECOND PRECEDING AND CURRENT ROW) - 1 < 3 AS allowed FROM events")
def rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    return rates.rate_limited(table(spark, sf, "events"), "event_type", "ts", 0.005, 600).select("event_id", "allowed")


@query("""WITH m AS (SELECT user_id, ts, value > 5 AS holds, sum((value <= 5)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS span FROM events)
       SELECT user_id, count(*) AS n FROM m WHERE holds GROUP BY user_id, span HAVING max(ts) - min(ts) >= INTERVAL 6 HOUR""")
def sustained_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return rates.sustained(table(spark, sf, "events"), "user_id", "ts", "event_id", F.col("value") > 5, 21600).select("user_id", "n")


@query("SELECT event_id, sum(value::DECIMAL(18, 4)) OVER w::DOUBLE / count(value) OVER w AS running_mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_mean(spark: SparkSession, sf: str) -> DataFrame:
    # Decimal sums are exact in any order, so no digit of the mean depends on the engine.
    events = table(spark, sf, "events").withColumn("value", F.col("value").cast("decimal(18,4)"))
    return rates.running_mean(events, "user_id", ["ts", "event_id"], "value").select("event_id", "running_mean")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING), 4) AS trailing_mean FROM events")
def trailing_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rates.trailing_mean(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value", 5).select("event_id", r4(F.col("trailing_mean")).alias("trailing_mean"))


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
       SELECT user_id, round(sum(value * pow(0.8, n - k) * CASE WHEN k = 1 THEN 1 ELSE 0.2 END), 4) AS ema, max(n) AS n FROM r GROUP BY 1""")
def moving_average(spark: SparkSession, sf: str) -> DataFrame:
    return rates.moving_average(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value", 0.2).select("user_id", r4(F.col("ema")).alias("ema"), "n")


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def page_titles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", tx.title(F.col("html")).alias("title"))


@query("""WITH m AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'), '(?is)(<script\\b[^>]*>|<style\\b[^>]*>)[^<]*', '\\1', 'g') AS h FROM pages)
       SELECT page_id, len(regexp_extract_all(h, '(?i)<p\\b')) AS p_count, len(regexp_extract_all(h, '(?i)<a\\b')) AS link_count, len(regexp_extract_all(h, '(?i)<div\\b')) AS div_count FROM m""")
def page_structure(spark: SparkSession, sf: str) -> DataFrame:
    f = tx.structural_features(F.col("html"))
    return table(spark, sf, "pages").select("page_id", *[f[k].cast("long").alias(k) for k in ("p_count", "link_count", "div_count")])


@query("SELECT page_id, len(regexp_extract_all(html, '(?i)<a\\b[^>]*?\\shref\\s*=\\s*[\"'']([^\"''>]*)[\"'']')) AS n_links FROM pages")
def page_link_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.size(tx.hrefs(F.col("html"))).cast("long").alias("n_links"))


@query("""WITH l AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*?\\shref\\s*=\\s*["'']([^"''>]*)["'']', 1)) AS href FROM pages)
       SELECT DISTINCT page_id, rtrim(regexp_replace(origin || href, '#.*$', ''), '/') AS link FROM l WHERE starts_with(href, '/')""")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").select("page_id", "url", F.explode(F.array_distinct(tx.hrefs(F.col("html")))).alias("href")).where("href LIKE '/%'")
    return rows.select("page_id", urls.normalize_link(urls.resolve_link(F.col("url"), F.col("href"))).alias("link")).distinct()


def _marks_sql(text: str, marks: dict[str, tuple[str, ...]]) -> str:
    tests = [" OR ".join(f"contains({text}, '{m}')" for m in words) for words in marks.values()]
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {t} THEN '{name}' END" for name, t in zip(marks, tests, strict=True)) + ")"


@query(f"""SELECT page_id, {_marks_sql("html", tx.FRAMEWORKS)} AS frameworks, {_marks_sql("lower(html)", tx.SECURITY)} AS security, {_marks_sql("lower(html)", tx.PROTECTION)} AS protection,
       regexp_matches(lower(html), 'login|sign in|log in|authentication required|access denied|unauthorized|signin|log-in|member|account|password') AS needs_login FROM pages""")
def page_technology(spark: SparkSession, sf: str) -> DataFrame:
    # Lower case once for all words.
    pages = table(spark, sf, "pages").select("page_id", "html", F.lower("html").alias("low"))
    h, low = F.col("html"), F.col("low")
    found = {"frameworks": tx.labels(h, tx.FRAMEWORKS), "security": tx.labels(low, tx.SECURITY), "protection": tx.labels(low, tx.PROTECTION)}
    return pages.select("page_id", *[F.array_join(v, ",").alias(k) for k, v in found.items()], tx.has_any(low, tx.LOGIN).alias("needs_login"))


@query("SELECT doc_id, " + ", ".join(f"len(list_distinct(regexp_extract_all(text, '(?i){p}'))) AS {k}" for k, p in tx.PATTERNS.items()) + " FROM documents")
def text_patterns(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", *[F.size(tx.matches(t, k)).cast("long").alias(k) for k in tx.PATTERNS])


@query("""SELECT d.doc_id, l.n, d.lang FROM (SELECT doc_id, lang FROM documents) d LEFT JOIN (SELECT doc_id, len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 20)) AS n FROM documents) l USING (doc_id)""")
def text_relevant_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(tx.relevant_lines(F.col("text"))).cast("long").alias("n"), "lang")


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label, list_dot_product(embedding::DOUBLE[], q.e::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(q.e::DOUBLE[], q.e::DOUBLE[])) AS sim FROM embeddings, q)
       SELECT vec_id, round(sim, 4) AS similarity FROM s ORDER BY sim DESC, vec_id LIMIT 10""")
def vector_nearest(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    return similarity.nearest(v, v.where("vec_id = 0"), 10).orderBy(F.desc("similarity"), "vec_id").select("vec_id", r4(F.col("similarity")).alias("similarity"))


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 1), s AS (SELECT vec_id, label, list_dot_product(embedding::DOUBLE[], q.e::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(q.e::DOUBLE[], q.e::DOUBLE[])) AS sim FROM embeddings, q),
       t AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS r FROM s) SELECT vec_id, label, round(sim, 4) AS similarity FROM t WHERE r <= 5 ORDER BY sim DESC, vec_id LIMIT 5""")
def vector_nearest_in_groups(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    return similarity.nearest(v, v.where("vec_id = 1"), 5, group="label").orderBy(F.desc("similarity"), "vec_id").select("vec_id", "label", r4(F.col("similarity")).alias("similarity"))


_SEARCH_SQL = """WITH q AS (SELECT vec_id AS query, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query, vec_id, label, list_dot_product(embedding::DOUBLE[], q.e::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(q.e::DOUBLE[], q.e::DOUBLE[])) AS sim FROM embeddings, q)"""


@query(f"""{_SEARCH_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, vec_id) AS r FROM s)
       SELECT query, vec_id, round(sim, 4) AS similarity FROM t WHERE r <= 10""")
def vector_search(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    return similarity.nearest(v, v.where("vec_id % 100 = 0"), 10).select("query", "vec_id", r4(F.col("similarity")).alias("similarity"))


@query(f"""{_SEARCH_SQL}, g AS (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY sim DESC, vec_id) AS r FROM s), t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, vec_id) AS place FROM g WHERE r <= 5)
       SELECT query, vec_id, label, round(sim, 4) AS similarity FROM t WHERE place <= 5""")
def vector_search_in_groups(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    return similarity.nearest(v, v.where("vec_id % 100 = 0"), 5, group="label").select("query", "vec_id", "label", r4(F.col("similarity")).alias("similarity"))


@query("""WITH t AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS word FROM benchmark), tf AS (SELECT item_id, word, count(*) AS tf FROM t GROUP BY 1, 2),
       df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1), w AS (SELECT item_id, word, tf * (ln((1.0 + (SELECT count(*) FROM benchmark)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (word)),
       n AS (SELECT item_id, word, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS x FROM w)
       SELECT a.item_id AS a, b.item_id AS b, round(sum(a.x * b.x), 4) AS similarity FROM n a JOIN n b USING (word) WHERE a.item_id < b.item_id GROUP BY 1, 2 HAVING sum(a.x * b.x) >= 0.3""")
def text_similarity(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array_remove(F.split(F.lower("text"), "[^a-z0-9]+"), "")
    w = similarity.tf_idf(table(spark, sf, "benchmark"), "item_id", words)
    pairs = similarity.text_similarity(w.withColumnRenamed("item_id", "a"), w.withColumnRenamed("item_id", "b"), "a", "b", 0.3, F.col("a") < F.col("b"))
    return pairs.select("a", "b", r4(F.col("similarity")).alias("similarity"))


def _links(spark: SparkSession, sf: str) -> DataFrame:
    """A link graph from orders: customer c links to the customers (7 c + i) mod n for each of its orders i."""
    n = table(spark, sf, "customer").agg(F.count("*").alias("n"))
    rows = table(spark, sf, "orders").join(F.broadcast(n)).select(F.col("o_custkey").alias("src"), (F.col("o_custkey") * 7 + F.col("o_orderkey") % 5).alias("k"), "n", F.col("o_orderkey").alias("pos"))
    return rows.select("src", F.pmod("k", "n").alias("dst"), "pos")


_LINK_SQL = "l AS (SELECT o_custkey AS src, (o_custkey * 7 + o_orderkey % 5) % (SELECT count(*) FROM customer) AS dst, o_orderkey AS pos FROM orders)"


@query(f"""WITH RECURSIVE {_LINK_SQL}, b AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT l.dst, b.depth + 1 FROM b JOIN l ON l.src = b.node WHERE b.depth < 4)
       SELECT node, min(depth) AS depth FROM b GROUP BY 1""")
def graph_breadth_first(spark: SparkSession, sf: str) -> DataFrame:
    start = spark.createDataFrame([(1,)], "node long")
    return graph.breadth_first(_links(spark, sf), start, 4).select("node", "depth")


@query(f"WITH {_LINK_SQL} SELECT dst AS node, count(*) AS n_links FROM l GROUP BY 1")
def graph_in_links(spark: SparkSession, sf: str) -> DataFrame:
    return graph.in_links(_links(spark, sf))


@query(f"""WITH {_LINK_SQL}, c AS (SELECT dst, count(*) AS c FROM l GROUP BY 1), m AS (SELECT max(c) AS m FROM c)
       SELECT c_custkey AS url, round(CASE WHEN c IS NULL THEN 0.3 ELSE least(0.3 + 0.7 * log10(1 + 9.0 * c / m), 1) END, 4) AS popularity FROM customer, m LEFT JOIN c ON dst = c_custkey""")
def score_popularity(spark: SparkSession, sf: str) -> DataFrame:
    candidates = table(spark, sf, "customer").select(F.col("c_custkey").alias("url"))
    return url_scores.link_popularity(candidates, _links(spark, sf)).select("url", r4(F.col("popularity")).alias("popularity"))


@query(f"SELECT page_id, url, round(greatest(0, 1 - len({SEGS}) / 10.0), 4) AS score FROM pages ORDER BY score DESC, url LIMIT 20")
def graph_best_first(spark: SparkSession, sf: str) -> DataFrame:
    scored = pages(spark, sf).withColumn("score", r4(url_scores.depth_score(F.col("url"))))
    return graph.best_first_order(scored, 20).select("page_id", "url", "score")


@query("SELECT role, count(*) AS n, count(*) FILTER (role IN ('user', 'assistant', 'system')) AS valid FROM conversations GROUP BY 1")
def role_check(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_if(F.col("role").isin("user", "assistant", "system")).alias("valid"))


@query("SELECT date, count(*) AS total_sessions, round(avg(m), 4) AS avg_messages, round(avg(r), 4) AS avg_success_rate FROM (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS date, count(*) AS m, avg((event_type <> 'error')::INT) AS r FROM events GROUP BY 1, 2) GROUP BY 1")
def daily_sessions(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "events").groupBy("user_id", F.date_trunc("day", F.col("ts")).alias("date")).agg(F.count("*").alias("m"), F.avg((F.col("event_type") != "error").cast("int")).alias("r"))
    return s.groupBy("date").agg(F.count("*").alias("total_sessions"), r4(F.avg("m")).alias("avg_messages"), r4(F.avg("r")).alias("avg_success_rate"))


@query("SELECT source AS content_type, count(*) AS total_analyses, round(avg(quality), 4) AS avg_quality, round(avg(toxic), 4) AS avg_toxic, round(avg(n_chars), 4) AS avg_chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def content_statistics(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left")
    return rows.groupBy(F.col("source").alias("content_type")).agg(F.count("*").alias("total_analyses"), r4(F.avg("quality")).alias("avg_quality"), r4(F.avg("toxic")).alias("avg_toxic"), r4(F.avg("n_chars")).alias("avg_chars"))


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM pages) AS pages, (SELECT count(DISTINCT conv_id) FROM conversations) AS conversations, (SELECT count(*) FROM events WHERE event_type = 'error') AS errors")
def system_health(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda name, agg: table(spark, sf, name).agg(agg)
    parts = [one("documents", F.count("*").alias("documents")), one("pages", F.count("*").alias("pages")), one("conversations", F.count_distinct("conv_id").alias("conversations")), one("events", F.count_if(F.col("event_type") == "error").alias("errors"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))
    return out


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00'")
def retention(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where("ts >= TIMESTAMP_NTZ '2024-01-10 00:00:00'").select("event_id")


@query("SELECT page_id, i - 1 AS pos, len(regexp_extract_all(b, '(?i)<li\\b')) AS items FROM (SELECT page_id, unnest(bs) AS b, generate_subscripts(bs, 1) AS i FROM (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<ul\\b[^>]*>.*?</ul\\s*>') AS bs FROM pages)) WHERE items > 0")
def html_lists(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.lists(table(spark, sf, "pages"), "page_id").select("page_id", F.col("pos").cast("long").alias("pos"), F.col("items").cast("long").alias("items"))


@query("""SELECT page_id, len(l) AS links, l[1] AS first_link FROM (SELECT page_id, regexp_extract_all(b, '(?i)<a\\b[^>]*?\\shref\\s*=\\s*["'']([^"''>]*)["'']', 1) AS l FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<nav\\b[^>]*>.*?</nav\\s*>')) AS b FROM pages)) WHERE len(l) >= 3""")
def html_navigation(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.navigation(table(spark, sf, "pages"), "page_id").select("page_id", F.col("links").cast("long").alias("links"), F.get("first_links", 0).alias("first_link"))


@query("""SELECT page_id, NULLIF(trim(regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1)), '') AS heading, NULLIF(trim(regexp_extract(html, '(?i)<html[^>]*\\blang="([^"]*)"', 1)), '') AS lang FROM pages""")
def html_fields(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.fields(table(spark, sf, "pages"), "page_id", {"heading": r"(?is)<h1\b[^>]*>(.*?)</h1>", "lang": r'(?i)<html[^>]*\blang="([^"]*)"'})


@query("""SELECT c_custkey, round(0.7 * f / 3.0 + 0.3 * CASE WHEN f = 0 THEN 0 ELSE q / f END, 4) AS confidence FROM (SELECT c_custkey, (length(c_name) > 0)::INT + (length(c_nationkey::VARCHAR) > 0)::INT + (length(c_mktsegment) > 0)::INT AS f,
       CASE WHEN length(c_name) > 2 THEN 1 ELSE 0.3 END + CASE WHEN length(c_nationkey::VARCHAR) > 2 THEN 1 ELSE 0.3 END + CASE WHEN length(c_mktsegment) > 2 THEN 1 ELSE 0.3 END AS q FROM customer)""")
def extraction_confidence(spark: SparkSession, sf: str) -> DataFrame:
    values = [F.col(c) for c in ("c_name", "c_nationkey", "c_mktsegment")]
    return table(spark, sf, "customer").select("c_custkey", r4(merging.extraction_confidence(values)).alias("confidence"))


@query("SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def distinct_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return merging.distinct_first(table(spark, sf, "events"), "event_type", "event_id").select("event_type", "event_id", "value")


@query("SELECT lower(p_brand) AS name, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_brand), p_size ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r = 1")
def entity_dedup(spark: SparkSession, sf: str) -> DataFrame:
    best = merging.best_confidence(table(spark, sf, "part"), [F.lower("p_brand"), F.col("p_size")], "p_retailprice", "p_partkey")
    return best.select(F.lower("p_brand").alias("name"), "p_partkey", "p_retailprice")


@query("SELECT user_id, event_type, min_by(props, event_id) AS props FROM events WHERE length(trim(props)) > 0 GROUP BY 1, 2")
def merge_by_priority(spark: SparkSession, sf: str) -> DataFrame:
    return merging.merge_by_priority(table(spark, sf, "events"), "user_id", "event_type", "props", "event_id")


@query("""WITH r AS (SELECT user_id, event_type, props, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, props) AS r FROM events)
       SELECT user_id, event_type, max(props) FILTER (r = 1) AS props, count(DISTINCT props) - 1 AS conflicts FROM r GROUP BY 1, 2""")
def merge_by_weight(spark: SparkSession, sf: str) -> DataFrame:
    return merging.merge_by_weight(table(spark, sf, "events"), "user_id", "event_type", "props", "value")


@query("SELECT user_id, missing FROM (SELECT DISTINCT user_id FROM events), (VALUES ('view'), ('signup'), ('purchase'), ('click'), ('error')) AS v(missing) WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = events.user_id AND event_type = missing)".replace("(SELECT DISTINCT user_id FROM events)", "(SELECT DISTINCT user_id FROM events) AS events"))
def missing_fields(spark: SparkSession, sf: str) -> DataFrame:
    return merging.missing_fields(table(spark, sf, "events"), "user_id", "event_type", ["view", "signup", "purchase", "click", "error"])


@query("SELECT count(s) AS total, round(avg(s), 4) AS average, max(s) AS highest, min(s) AS lowest, count(*) FILTER (s >= 0.8) AS high, count(*) FILTER (s >= 0.5 AND s < 0.8) AS medium, count(*) FILTER (s < 0.5) AS low FROM (SELECT l_quantity / 50 AS s FROM lineitem)")
def score_statistics(spark: SparkSession, sf: str) -> DataFrame:
    b = merging.score_buckets(table(spark, sf, "lineitem").select((F.col("l_quantity") / 50).alias("s")), "s")
    return b.select("total", r4(F.col("average")).alias("average"), "highest", "lowest", "high", "medium", "low")


@query(f"""WITH p AS (SELECT len({SEGS}) AS depth, len(regexp_extract_all(html, '(?i)<a\\b[^>]*?\\shref\\s*=\\s*["'']([^"''>]*)["'']')) AS n FROM pages)
       SELECT depth::INT AS depth, count(*) AS pages, sum(n)::BIGINT AS links, round(avg(n), 4) AS avg_links FROM p GROUP BY 1""")
def crawl_depths(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select(F.size(urls.segments(F.col("url"))).alias("depth"), F.size(tx.hrefs(F.col("html"))).alias("n_links"), F.lit(True).alias("success"))
    return graph.depth_statistics(p).select("depth", "pages", "links", r4(F.col("avg_links")).alias("avg_links"))


@query("SELECT class, count(*) AS n FROM (SELECT CASE WHEN contains(lower(text), 'http') THEN 'linked' WHEN contains(lower(text), '@') THEN 'contact' ELSE 'plain' END AS class FROM documents) GROUP BY 1")
def content_classes(spark: SparkSession, sf: str) -> DataFrame:
    c = merging.content_class(F.col("text"), {"linked": ["http"], "contact": ["@"]}, "plain")
    return table(spark, sf, "documents").groupBy(c.alias("class")).agg(F.count("*").alias("n"))


@query("SELECT failure, count(*) AS n FROM (SELECT CASE WHEN contains(t, 'timeout') THEN 'timeout' WHEN contains(t, 'not found') OR contains(t, '404') THEN 'not_found' WHEN contains(t, 'permission') OR contains(t, 'forbidden') THEN 'permission' WHEN contains(t, 'parse') OR contains(t, 'extract') THEN 'extraction' ELSE 'other' END AS failure FROM (SELECT lower(url) AS t FROM pages)) GROUP BY 1")
def failure_classes(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).groupBy(executions.failure_class(F.col("url")).alias("failure")).agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, CASE WHEN avg((value < 20)::INT) > 0.8 THEN 'healthy' WHEN avg((value < 20)::INT) > 0.5 THEN 'degraded' ELSE 'unhealthy' END AS status FROM events GROUP BY 1")
def provider_status(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg((F.col("value") < 20).cast("int")).alias("rate"))
    return s.select("event_type", "n", executions.health(F.col("rate")).alias("status"))


@query("SELECT doc_id, len(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda w: length(w) > 2 AND w NOT IN ('the','and','for','with','from','this','that','are','was')))) AS n FROM documents")
def text_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(tx.keywords(F.col("text"))).cast("long").alias("n"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal >= 6 THEN 'high' WHEN s_acctbal >= 3 THEN 'medium' ELSE 'low' END AS level, round(least(0.5 + least(0.1 * s_nationkey, 0.3) + greatest(0, 0.2 - s_nationkey / 10.0), 1), 4) AS score FROM supplier")
def strategy_scores(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select("s_suppkey", merging.complexity(F.col("s_acctbal")).alias("level"), r4(merging.strategy_score(F.lit(0.5), F.col("s_nationkey"), F.col("s_nationkey"))).alias("score"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'building' ELSE replace(lower(c_mktsegment), ' ', '_') END AS name FROM customer")
def field_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", inference.field_name(F.col("c_mktsegment")).alias("name"))


@query("""SELECT page_id, greatest(CASE WHEN starts_with(h, '#') THEN 10 WHEN contains(h, '.') THEN 8 + least((length(h) - length(replace(h, '.', ''))) * 0.5, 2) WHEN regexp_matches(h, '^[a-zA-Z]+$') THEN 6 ELSE 0 END
       + CASE WHEN regexp_matches(h, '[ >]') THEN 1 ELSE 0 END - CASE WHEN regexp_matches(h, '[0-9]') THEN 1 ELSE 0 END, 0)::DOUBLE AS score FROM (SELECT page_id, regexp_extract(url, '//([^/?#]*)', 1) AS h FROM pages)""")
def selector_scores(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("page_id", inference.selector_score(urls.netloc(F.col("url"))).alias("score"))


@query("SELECT ps AS p_size, round(least(0.3 + least(ps * 0.15, 0.4) + least((ps % 5) * 0.1, 0.3) + least(ps * 0.05, 0.2) + CASE WHEN ps > 0 AND ps % 5 > 0 THEN 0.1 ELSE 0 END, 1), 4) AS confidence FROM (SELECT DISTINCT p_size AS ps FROM part)")
def hybrid_confidence(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("p_size")
    return table(spark, sf, "part").select("p_size").distinct().select("p_size", r4(inference.hybrid_confidence(s, s % 5, s)).alias("confidence"))


@query("""SELECT level, count(*) AS n FROM (SELECT CASE WHEN p >= 6 THEN 'high' WHEN p >= 3 THEN 'medium' ELSE 'low' END AS level FROM (SELECT CASE WHEN regexp_matches(html, 'react|vue|angular') THEN 3 ELSE 0 END
       + CASE WHEN len(regexp_extract_all(html, '<script')) > 20 THEN 2 WHEN len(regexp_extract_all(html, '<script')) > 10 THEN 1 ELSE 0 END + CASE WHEN len(regexp_extract_all(html, '<form')) > 5 THEN 2 ELSE 0 END
       + CASE WHEN regexp_matches(html, 'ajax|xhr|fetch|websocket') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(html, 'captcha|cloudflare|bot') THEN 1 ELSE 0 END AS p FROM pages)) GROUP BY 1""")
def page_complexity(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").groupBy(inference.page_complexity(F.col("html")).alias("level")).agg(F.count("*").alias("n"))


@query("SELECT page_id, CAST(NULLIF(regexp_extract(url, '([0-9]+\\.?[0-9]*)', 1), '') AS DOUBLE) AS number FROM pages")
def first_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("page_id", inference.first_number(F.col("url")).alias("number"))


@query("SELECT event_id, props IS NOT NULL AND json_extract_string(props, '$.k') IS NOT NULL AS valid, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_records(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("props")
    return table(spark, sf, "events").select("event_id", inference.matches_schema(p, {"k": "number"}, ["k"]).alias("valid"), F.get_json_object(inference.json_object(p), "$.k").cast("long").alias("k"))


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
       a AS (SELECT user_id, n, avg(value) FILTER (k <= n // 3) AS e, avg(value) FILTER (k > n - ceil(n / 3)) AS l FROM r GROUP BY 1, 2)
       SELECT user_id, CASE WHEN n < 5 THEN 'insufficient_data' WHEN l > e * 1.1 THEN 'improving' WHEN l < e * 0.9 THEN 'declining' ELSE 'stable' END AS trend, n FROM a""")
def trend_thirds(spark: SparkSession, sf: str) -> DataFrame:
    return trends.trend_by_thirds(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value")


@query("""WITH q AS (SELECT l_linenumber AS d, avg(l_quantity) AS q FROM lineitem GROUP BY 1), s AS (SELECT q - lag(q) OVER (ORDER BY d) AS x FROM q), c AS (SELECT count(*) FILTER (x > 0) AS rises, count(*) FILTER (x < 0) AS falls FROM s)
       SELECT rises, falls, CASE WHEN rises > falls THEN 'improving' WHEN falls > rises THEN 'declining' ELSE 'stable' END AS trend FROM c""")
def depth_quality_trend(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.avg("l_quantity").alias("q"))
    return trends.depth_trend(q, "l_linenumber", "q")


@query("SELECT event_id, least(value / 40 * CASE WHEN value / 30 > 0.8 THEN 1.2 WHEN value / 30 > 0.6 THEN 1.1 ELSE 1 END * CASE WHEN value > 2 THEN 1.15 ELSE 1 END * CASE WHEN user_id % 5 < 3 THEN 1.1 ELSE 1 END, 1) AS score FROM events")
def boosted_scores(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", trends.boosted(v / 40, v / 30, v, F.col("user_id") % 5).alias("score"))


@query("SELECT event_type, round(CASE WHEN s > 0.95 THEN least(10 * 1.1, 20) WHEN s < 0.8 THEN greatest(10 * 0.8, 1) ELSE 10 END, 4)::DOUBLE AS rate FROM (SELECT event_type, avg((value < 15)::INT) AS s FROM events GROUP BY 1)")
def adaptive_rate(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "events").groupBy("event_type").agg(F.avg((F.col("value") < 15).cast("int")).alias("s"))
    return s.select("event_type", r4(trends.adaptive_rate(F.lit(10.0), F.lit(10.0), F.col("s"))).alias("rate"))


@query("SELECT round(avg(1.0 / (1 + abs(a - i))), 6) AS agreement FROM (SELECT row_number() OVER (ORDER BY p_partkey) AS a, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS i FROM part)")
def rank_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return trends.rank_agreement(table(spark, sf, "part"), "p_partkey", "p_retailprice").select(F.round("agreement", 6).alias("agreement"))


@query("""WITH w AS (SELECT item_id, i * 8 + k AS place, ('0x' || substr(sha256(text || '_' || i), 8 * k + 1, 8))::BIGINT AS u FROM benchmark, range(3) a(i), range(8) b(k))
       SELECT item_id, place::INT AS place, (u - CASE WHEN u >= 2147483648 THEN 4294967296 ELSE 0 END) / 2147483648 AS value, 384::INT AS size FROM w""")
def hash_embedding(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "benchmark").select("item_id", inference.hash_embedding(F.col("text")).alias("v"))
    return v.select("item_id", F.posexplode(F.slice("v", 1, 24)).alias("place", "value"), F.size("v").alias("size"))


def _explored(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    links = F.size(tx.hrefs(F.col("html")))
    return table(spark, sf, "pages").select("url", F.size(urls.segments(u)).alias("depth"), urls.parent_path(u).alias("parent"), (links > 3).alias("success"), links.alias("n_links"), (F.col("page_id") % 7).cast("double").alias("seconds"), (F.col("page_id") % 10 / 10).alias("score"))


_EXPLORED = f"""e AS (SELECT url, len({SEGS}) AS depth, len(regexp_extract_all(html, '(?i)<a\\b[^>]*?\\shref\\s*=\\s*["'']([^"''>]*)["'']')) AS n_links, (page_id % 7)::DOUBLE AS seconds, page_id % 10 / 10.0 AS score, {HOST} AS host FROM pages)"""


@query(f"WITH {_EXPLORED} SELECT count(*) AS pages, count(*) FILTER (n_links > 3) AS successful, round(avg((n_links > 3)::INT), 4) AS success_rate, sum(n_links)::BIGINT AS links, round(avg(seconds), 4) AS avg_seconds, count(DISTINCT host) AS hosts, max(depth)::INT AS max_depth FROM e")
def crawl_statistics(spark: SparkSession, sf: str) -> DataFrame:
    s = exploration.crawl_statistics(_explored(spark, sf))
    return s.select("pages", "successful", r4(F.col("success_rate")).alias("success_rate"), "links", r4(F.col("avg_seconds")).alias("avg_seconds"), "hosts", "max_depth")


@query(f"WITH {_EXPLORED} SELECT depth::INT AS depth, count(*) OVER (PARTITION BY depth) AS n, url, n_links::BIGINT AS n_links FROM e")
def site_map(spark: SparkSession, sf: str) -> DataFrame:
    return exploration.site_map(_explored(spark, sf)).select("depth", "n", "url", F.col("n_links").cast("long").alias("n_links"))


@query(f"WITH {_EXPLORED}, c AS (SELECT depth, count(*) AS n FROM e GROUP BY 1) SELECT depth::INT AS depth, n, round(n * 1.0 / sum(n) OVER (), 4) AS share, round(sum(n) OVER (ORDER BY depth) * 1.0 / sum(n) OVER (), 4) AS reached FROM c")
def depth_report(spark: SparkSession, sf: str) -> DataFrame:
    return exploration.depth_report(_explored(spark, sf)).select("depth", "n", r4(F.col("share")).alias("share"), r4(F.col("reached")).alias("reached"))


@query(f"WITH {_EXPLORED} SELECT round(avg((score > 0.7)::INT), 4) AS efficiency, count(*) AS n FROM e WHERE n_links > 3")
def discovery_efficiency(spark: SparkSession, sf: str) -> DataFrame:
    return exploration.discovery_efficiency(_explored(spark, sf)).select(r4(F.col("efficiency")).alias("efficiency"), "n")


@query("SELECT bucket, count(*) AS n, count(*) FILTER (score >= 0.7) AS passing FROM (SELECT score, CASE WHEN score >= 0.8 THEN 'excellent' WHEN score >= 0.6 THEN 'good' WHEN score >= 0.4 THEN 'fair' ELSE 'poor' END AS bucket FROM (SELECT CASE WHEN NOT contains(url, '?') THEN 0 ELSE page_id % 10 / 10.0 END AS score FROM pages)) GROUP BY 1")
def score_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    p = pages(spark, sf)
    scores = p.select(F.col("page_id").alias("url"), F.when(F.contains("url", F.lit("?")), F.col("page_id") % 10 / 10).alias("score"))
    return exploration.enrich_scores(p.select(F.col("page_id").alias("url")), scores.where("score IS NOT NULL")).groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("passes").alias("passing"))


@query("""WITH c AS (SELECT p_brand, p_size, p_name, min(p_partkey) AS k, count(*) AS n FROM part GROUP BY 1, 2, 3)
       SELECT a.k AS a, b.k AS b, a.n AS a_rows, b.n AS b_rows FROM c a JOIN c b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.k < b.k AND 1 - levenshtein(a.p_name, b.p_name) * 1.0 / greatest(length(a.p_name), length(b.p_name), 1) >= 0.8""")
def near_strings(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_name", F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("g"))
    return clustering.near_strings(p, "p_partkey", "g", "p_name").select("a", "b", "a_rows", "b_rows")


@query("SELECT s_suppkey, round((CASE WHEN s_acctbal = 0 AND n = 0 THEN 1 ELSE 1 - abs(s_acctbal - n) / greatest(abs(s_acctbal), abs(n)) END + (s_nationkey = 3)::INT) / 2.0, 4) AS similarity FROM (SELECT *, 1000.0::DOUBLE AS n FROM supplier)")
def feature_similarity(spark: SparkSession, sf: str) -> DataFrame:
    s = clustering.feature_similarity([(F.col("s_acctbal"), F.lit(1000.0)), (F.col("s_nationkey"), F.lit(3))], ["number", "equal"])
    return table(spark, sf, "supplier").select("s_suppkey", r4(s).alias("similarity"))


@query()
def usage_clusters(spark: SparkSession, sf: str) -> DataFrame:
    users = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").cast("double").alias("n"), F.avg("value").alias("mean"), F.avg((F.col("event_type") == "error").cast("int")).alias("errors"))
    return clustering.k_means(users, ["n", "mean", "errors"]).groupBy("cluster").agg(F.count("*").alias("size"), r4(F.avg("mean")).alias("mean"))
