"""Queries of lookups, walks, entities and structure, with SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.operators import discovery, entities, json_types, markup, matching, vector_index
from loomery.plans.queries import query, r4
from loomery.session import table

_WORDS = "list_filter(regexp_split_to_array(lower(text), '\\W+'), lambda w: length(w) > 1)"


@query(f"""WITH t AS (SELECT item_id, unnest({_WORDS}) AS word FROM benchmark), tf AS (SELECT item_id, word, count(*) AS tf FROM t GROUP BY 1, 2), df AS (SELECT word, ln((1.0 + (SELECT count(*) FROM benchmark)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
w AS (SELECT item_id, word, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY item_id)) AS x FROM tf JOIN df USING (word)),
q AS (SELECT doc_id, word, n * idf / sqrt(sum(n * idf * n * idf) OVER (PARTITION BY doc_id)) AS y FROM (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({_WORDS}) AS word FROM documents) GROUP BY 1, 2) JOIN df USING (word)),
s AS (SELECT doc_id, item_id, sum(x * y) AS score FROM q JOIN w USING (word) GROUP BY 1, 2 HAVING sum(x * y) > 0.1)
SELECT doc_id, item_id, round(score, 4) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 12) DESC, item_id)::INTEGER AS place FROM s) WHERE place <= 3""")
def text_tool_matches(spark: SparkSession, sf: str) -> DataFrame:
    found = matching.text_matches(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", table(spark, sf, "benchmark"), "item_id", 3)
    return found.select("doc_id", "item_id", r4(F.col("score")).alias("score"), "place")


_LOOKUP = """q AS (SELECT vec_id AS query, label AS l, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query, vec_id, round(list_dot_product(embedding::DOUBLE[], e) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(e, e)), 9) AS sim FROM embeddings JOIN q ON label = l WHERE embedding[2] >= 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, vec_id)::INTEGER AS place FROM s)"""


@query(f"WITH {_LOOKUP} SELECT query, vec_id, round(sim, 4) AS similarity, place FROM r WHERE place <= 5")
def vector_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Exact lookup among vectors of the query's label that pass a condition."""
    v = table(spark, sf, "embeddings")
    found = vector_index.search(vector_index.build_index(v, cells=16), v.where("vec_id % 100 = 0"), 5, F.get("embedding", F.lit(1)) >= 0, ["label"], exact=True)
    return found.select("query", "vec_id", r4(F.col("similarity")).alias("similarity"), "place")


@query(f"WITH {_LOOKUP} SELECT count(*) AS wanted, true AS recalled FROM r WHERE place <= 5")
def vector_lookup_recall(spark: SparkSession, sf: str) -> DataFrame:
    """The probed lookup against the exact one: how many rows are wanted, and whether nine of ten are found.

    These vectors have no clusters (a neighbour is as likely in the last cell as in the first), so nearly all cells are probed.
    """
    v = table(spark, sf, "embeddings")
    index, asked, passes = vector_index.build_index(v, cells=16), v.where("vec_id % 100 = 0"), F.get("embedding", F.lit(1)) >= 0
    exact = vector_index.search(index, asked, 5, passes, ["label"], exact=True)
    probed = vector_index.search(index, asked, 5, passes, ["label"], probes=15).select("query", "vec_id", F.lit(1).alias("hit"))
    both = exact.join(probed, ["query", "vec_id"], "left")
    return both.agg(F.count("*").alias("wanted"), (F.count("hit") >= 0.9 * F.count("*")).alias("recalled"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first FROM orders)
SELECT '/o/' || first AS start, (i - 1)::INTEGER AS page_no, '/o/' || o_orderkey AS url, CASE WHEN i < n AND i < 8 THEN NULL WHEN i < n THEN 'max_pages' WHEN o_custkey % 3 = 0 THEN 'cycle' WHEN o_custkey % 3 = 1 THEN 'no_next' ELSE 'missing' END AS stop FROM o WHERE i <= 8""")
def page_walks(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a customer as pages, each with a link to the next; the last links to the first, to nothing, or to a page that is not stored."""
    o = table(spark, sf, "orders")
    own = F.struct("o_orderkey")
    lists = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(own)).alias("os"))
    last = F.when(F.col("o_custkey") % 3 == 0, F.get("os", F.lit(0))["o_orderkey"]).when(F.col("o_custkey") % 3 == 2, F.lit(-1))
    each = lists.select(F.posexplode("os").alias("i", "o"), F.coalesce(F.get("os", F.col("i") + 1)["o_orderkey"], last).alias("ahead"))
    link = F.when(F.col("ahead").isNotNull(), F.concat(F.lit('<nav><ul><li><a href="/about">x</a><li><a class="n" rel="next" href="/o/'), F.col("ahead"), F.lit('">more</a></ul></nav>'))).otherwise("")
    pages = each.select(F.concat(F.lit("/o/"), F.col("o.o_orderkey")).alias("url"), "i", F.concat(F.lit("<html><body><!-- <a rel=\"next\" href=\"/no\"> -->"), link, F.lit("</body></html>")).alias("html"))
    nodes = markup.element_table(pages, "url")
    ahead = markup.select(nodes, "url", "//nav//a[@rel='next']").groupBy("url").agg(F.min_by(F.col("attributes")["href"], "pre").alias("next_url"))
    return discovery.paginated(pages.join(ahead.hint("merge"), "url", "left"), pages.where("i = 0"), most=8)


@query()
def best_first_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Customers linked by orders, scored by their balance; compared with a heap in test_lookups.py."""
    orders, people = table(spark, sf, "orders"), table(spark, sf, "customer")
    name = lambda c: F.concat(F.lit("/customer/"), c.cast("string"))
    links = orders.select(name(F.col("o_custkey")).alias("src"), name((F.col("o_custkey") * 7 + F.col("o_orderkey") % 5) % people.count()).alias("dst"))
    scores = people.select(name(F.col("c_custkey")).alias("url"), F.greatest(F.lit(0.0), F.col("c_acctbal") / 10000).alias("score"), F.length("c_name").alias("content"))
    walk = discovery.best_first(links, scores, spark.createDataFrame([("/customer/1",)], "url string"), 60, 5, 20)
    return walk.select("visit", "url", "depth", r4(F.col("score")).alias("score"))


_MAIL, _DAY = entities.KINDS["email"][0], r"\d{4}-\d{1,2}-\d{1,2}"


@query(f"""WITH k(kind, p) AS (VALUES ('email', '(?i){_MAIL}'), ('date', '{_DAY}')),
m AS (SELECT doc_id, kind, text, regexp_extract_all(text, p) AS hits, string_split_regex(text, p) AS gaps FROM documents, k WHERE regexp_matches(text, p)),
x AS (SELECT doc_id, kind, text, unnest(hits) AS value, unnest(list_transform(range(1, len(hits) + 1), lambda i: list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0))) AS start FROM m),
c AS (SELECT *, least(CASE WHEN kind = 'email' THEN 0.95 WHEN regexp_matches(value, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 0.9 ELSE 0.7 END + CASE WHEN contains(lower(text), kind) THEN 0.1 ELSE 0 END, 1) AS confidence FROM x)
SELECT doc_id, kind, value, start::INTEGER AS start, regexp_replace(substring(text, greatest(start - 50, 0)::BIGINT + 1, (start + length(value) + 50 - greatest(start - 50, 0))::BIGINT), '^\\s+|\\s+$', '', 'g') AS context, round(confidence, 4) AS confidence, mentions
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, lower(value) ORDER BY confidence DESC, start) AS place, count(*) OVER (PARTITION BY doc_id, kind, lower(value)) AS mentions FROM c) WHERE place = 1""")
def document_entities(spark: SparkSession, sf: str) -> DataFrame:
    found = entities.entities(table(spark, sf, "documents"), "doc_id", kinds={"email": (_MAIL,), "date": (_DAY,)})
    return found.withColumn("confidence", r4(F.col("confidence")))


@query("""WITH e AS (SELECT *, event_id % 4 = 0 AS q, event_type = 'click' AS c FROM events), n AS (SELECT count(*) AS n, count_if(q) AS q, count_if(c) AS c, count_if(q AND NOT c) AS t, count_if(event_id % 10 = 0) AS bad FROM e)
SELECT '$' AS path, 'object' AS type, n, 0 AS nulls, NULL::DOUBLE AS share FROM n UNION ALL SELECT '$.k', 'integer', n - bad, 0, 1.0 FROM n UNION ALL SELECT '$.type', 'string', n - bad, 0, 1.0 FROM n
UNION ALL SELECT '$.value', 'number', count(*), 0, 1.0 FROM e WHERE event_id % 10 <> 0 UNION ALL SELECT '$.tags', 'array', count(*), 0, round(count(*) / any_value((SELECT n - bad FROM n)), 9) FROM e WHERE c AND event_id % 10 <> 0
UNION ALL SELECT '$.tags[]', 'string', 2 * count(*), 0, 2.0 FROM e WHERE c AND event_id % 10 <> 0 UNION ALL SELECT '$.inner', 'object', count(*), 0, round(count(*) / any_value((SELECT n - bad FROM n)), 9) FROM e WHERE q AND event_id % 10 <> 0
UNION ALL SELECT '$.inner.user', 'integer', count(*), count_if(user_id % 2 = 0), 1.0 FROM e WHERE q AND event_id % 10 <> 0""")
def event_structure(spark: SparkSession, sf: str) -> DataFrame:
    """Properties of events with fields spliced in: arrays of mixed scalars, nested objects with nulls, and rows that are no JSON."""
    e = table(spark, sf, "events")
    more = [
        F.lit(', "type": "'), F.col("event_type"), F.lit('", "value": '), F.format_string("%.3f", F.col("value") + 0.001), F.when(F.col("event_type") == "click", F.concat(F.lit(', "tags": ["x", '), F.col("user_id").cast("string"), F.lit("]"))).otherwise(""),
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit(', "inner": {"user": '), F.when(F.col("user_id") % 2 == 0, "null").otherwise(F.col("user_id").cast("string")), F.lit("}"))).otherwise(""), F.lit("}"),
    ]
    json = F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.concat(F.regexp_replace("props", r"\}$", ""), *more))
    tree = json_types.type_tree(e.select(json.alias("json")), "json")
    return tree.select("path", "type", "n", "nulls", F.round("share", 9).alias("share"))
