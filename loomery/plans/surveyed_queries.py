"""Queries of operators that other modules only use inside: admission, chains, orders of walks, merging tables, small inferences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.functions import inference, urls
from loomery.functions import text as tx
from loomery.operators import exploration, graph, merging, trends, url_predicates
from loomery.plans.queries import _LINK_SQL, _links, query, r4
from loomery.session import table
from loomery.sources import tables
from loomery.streaming import windows

_HOST = "lower(regexp_extract(url, '://([^/?#]*)', 1))"
_SEGMENTS = "len(list_filter(string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> ''))"


@query(f"SELECT page_id, {_SEGMENTS} <= 2 AND (contains({_HOST}, 'example.com') OR contains({_HOST}, 'example.net')) AND (contains(url, '/en/') OR contains(url, '/de')) AND NOT contains(url, '?') AND NOT contains(url, '.html') AS admitted FROM pages")
def crawl_admission(spark: SparkSession, sf: str) -> DataFrame:
    depth = F.size(F.filter(F.split(urls.path(F.col("url")), "/"), lambda x: x != ""))
    return table(spark, sf, "pages").select("page_id", url_predicates.admitted(F.col("url"), depth, 2, ["example.com", "example.net"], ["/en/", "/de"], ["?", ".html"]).alias("admitted"))


def walk(spark: SparkSession, sf: str) -> DataFrame:
    return graph.breadth_first(_links(spark, sf), spark.createDataFrame([(1,)], "node long"), 4)


_WALK = f"{_LINK_SQL}, b AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT l.dst, b.depth + 1 FROM b JOIN l ON l.src = b.node WHERE b.depth < 4), d AS (SELECT node, min(depth) AS depth FROM b GROUP BY 1)"


@query(f"WITH RECURSIVE {_WALK} SELECT node, (depth + 1)::INTEGER AS steps, 1::BIGINT AS root, node AS ends, true AS linked FROM d")
def path_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of a walk: their length, ends, and whether every step of them is a link."""
    tree = walk(spark, sf)
    chains = graph.path_chains(tree)
    steps = chains.select("node", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.struct(F.get("path", i - 1).alias("src"), F.get("path", i).alias("dst")))).alias("s")).select("node", "s.*").where("dst IS NOT NULL")
    broken = steps.join(_links(spark, sf).select("src", "dst").distinct(), ["src", "dst"], "left_anti").select("node").distinct().withColumn("linked", F.lit(False))
    return chains.join(broken, "node", "left").select("node", F.size("path").alias("steps"), F.get("path", F.lit(0)).alias("root"), F.element_at("path", -1).alias("ends"), F.coalesce("linked", F.lit(True)).alias("linked"))


@query(f"WITH RECURSIVE {_WALK} SELECT node, depth FROM d ORDER BY depth DESC, node LIMIT 10")
def deepest_pages(spark: SparkSession, sf: str) -> DataFrame:
    return trends.deepest(walk(spark, sf).select("node", "depth"), 10)


@query(f"SELECT depth, sum(n)::BIGINT AS links FROM (SELECT {_SEGMENTS}::INTEGER AS depth, len(regexp_extract_all(html, '<a href')) AS n FROM pages) GROUP BY 1 ORDER BY links DESC, depth LIMIT 1")
def productive_depth(spark: SparkSession, sf: str) -> DataFrame:
    depth = F.size(F.filter(F.split(urls.path(F.col("url")), "/"), lambda x: x != ""))
    pages = table(spark, sf, "pages").select(depth.alias("depth"), F.size(tx.hrefs(F.col("html"))).cast("long").alias("n_links"))
    return graph.most_productive_depth(pages)


@query(f"""WITH RECURSIVE {_WALK}, p AS (SELECT d.node, d.depth, min(l.src) AS parent FROM d JOIN l ON l.dst = d.node JOIN d e ON e.node = l.src AND e.depth = d.depth - 1 GROUP BY 1, 2), q AS (SELECT p.*, (SELECT min(pos) FROM l WHERE l.src = p.parent AND l.dst = p.node) AS pos FROM p),
k AS (SELECT 1::BIGINT AS node, 0 AS depth, [0::BIGINT] AS key UNION ALL SELECT q.node, q.depth, list_append(k.key, q.pos) FROM k JOIN q ON q.parent = k.node AND q.depth = k.depth + 1) SELECT node, depth, row_number() OVER (ORDER BY key, node) - 1 AS at FROM k""")
def depth_first(spark: SparkSession, sf: str) -> DataFrame:
    return exploration.depth_first_order(_links(spark, sf), walk(spark, sf))


@query("""SELECT page_id, trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(html, '<!--.*?-->|<script>.*?</script>|<style>.*?</style>', ' ', 'gs'), '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM pages""")
def page_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", tx.without_scripts(F.col("html")).alias("text"))


@query("SELECT l_orderkey, l_linenumber, printf('%.2f', l_extendedprice) AS price FROM lineitem")
def price_texts(spark: SparkSession, sf: str) -> DataFrame:
    shown = F.concat(F.lit("Price: "), F.get(F.array(F.lit("$"), F.lit("EUR "), F.lit("")), F.col("l_linenumber") % 3), F.format_string("%.2f", "l_extendedprice"), F.lit(" each*"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", inference.first_number(shown).alias("n"), tx.clean_price(shown).alias("price")).select("l_orderkey", "l_linenumber", "price")


@query("SELECT page_id, url AS target FROM pages")
def redirect_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Stored urls, every other one wrapped into a redirect."""
    wrapped = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://r.example.org/go?src=a&url="), F.url_encode("url"), F.lit("&t=1"))).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", inference.unwrap_redirect(wrapped).alias("target"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_size || '-' || (p_size + 10) WHEN 1 THEN '1,' || printf('%03d', p_size) || '+' WHEN 2 THEN p_size::VARCHAR END AS staff FROM part")
def count_phrases(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    said = F.when(size % 4 == 0, F.concat(size, F.lit("-"), size + 10, F.lit(" Employees"))).when(size % 4 == 1, F.concat(F.lit("1,"), F.format_string("%03d", "p_size"), F.lit("+ employees"))).when(size % 4 == 2, F.concat(size, F.lit(" employees"))).otherwise("no employees")
    text = F.concat(F.col("p_name"), F.lit(" GmbH, founded 1999, "), said, F.lit(" in 3 offices"))
    return table(spark, sf, "part").select("p_partkey", inference.count_phrase(text, "employees").alias("staff"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'new ' || c_name FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 1")
def inserted_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    changes = c.where("c_custkey % 3 = 0").withColumn("c_name", F.concat(F.lit("new "), F.col("c_name")))
    return tables.insert_if_absent(c.where("c_custkey % 2 = 0"), changes.unionByName(changes), ["c_custkey"])


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1")
def upserted_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The latest order of each customer, merged from an older and a newer half."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return tables.upsert(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_custkey"], "o_orderkey")


@query("SELECT strftime(o_orderdate, '%Y_%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def monthly_orders(spark: SparkSession, sf: str) -> DataFrame:
    return tables.monthly(table(spark, sf, "orders"), "o_orderdate").groupBy("month").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT user_id AS pattern, max(ts) AS last_used, count(*) AS n, avg((value > 8)::INT) AS rate, avg(value) / 100 AS confidence FROM events GROUP BY 1)
SELECT pattern FROM p WHERE last_used >= TIMESTAMP '2024-01-30' - INTERVAL 5 DAY AND NOT (n >= 10 AND rate < 0.3 AND confidence < 0.4) ORDER BY last_used DESC, pattern LIMIT 40""")
def kept_patterns(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "events").groupBy(F.col("user_id").alias("pattern")).agg(F.max("ts").alias("last_used"), F.count("*").alias("n"), F.avg((F.col("value") > 8).cast("int")).alias("rate"), (F.avg("value") / 100).alias("confidence"))
    return exploration.evict(p, F.lit("2024-01-30").cast("timestamp"), 5, 40).select("pattern")


@query("SELECT event_type, round(avg((value > 5)::INT) / (sum(value) / count(*) / 60), 4) AS efficiency, round(0.4 * avg((value > 5)::INT) + 0.3 * min(value) / 10 + 0.3 * 0.5, 4) AS quality FROM events GROUP BY 1")
def work_scores(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy("event_type").agg(F.avg((F.col("value") > 5).cast("int")).alias("rate"), F.avg("value").alias("seconds"), F.min("value").alias("least"))
    return e.select("event_type", r4(merging.efficiency(F.col("rate"), F.col("seconds"))).alias("efficiency"), r4(merging.extraction_quality(F.col("rate"), F.col("least") / 10, F.lit(0.5))).alias("quality"))


@query("SELECT doc_id, round(1 + 0.5 * (doc_id % 10) / 10 + least(length(text) / 100, 0.3), 4) AS weight FROM documents")
def field_weights(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", r4(merging.field_weight(F.lit(1.0), (F.col("doc_id") % 10) / 10, F.col("text"))).alias("weight"))


@query("""SELECT p_partkey, substring(md5('{"p_brand":"' || p_brand || '","p_size":' || p_size || '}'), 1, 12) AS hash FROM part""")
def part_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", inference.feature_hash([F.col("p_brand"), F.col("p_size")]).alias("hash"))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(count(*) / 86400.0, 9) AS rate, round(sum(value), 2) AS total, max(value) AS most FROM events GROUP BY 1, 2")
def daily_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming window aggregate, over a stored table."""
    found = windows.windowed_rates(table(spark, sf, "events"), "ts", "event_type", "value", "1 day", "1 day")
    # Values have two decimals, so a mean times its number is never near a half.
    return found.select("start", "event_type", "n", F.round("rate", 9).alias("rate"), F.round(F.col("mean") * F.col("n"), 2).alias("total"), "most")
