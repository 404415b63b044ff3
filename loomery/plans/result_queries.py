"""Queries over results of strategies, requests to tools, and page scores, with SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.operators import executions, matching, page_fields, paragraphs, reports, strategies
from loomery.plans.log_queries import LOG, PLANS, PROFILES, log, plans
from loomery.plans.page_queries import built, i, when
from loomery.plans.queries import query, r4
from loomery.session import table

RESULTS = f"{LOG}, results AS (SELECT plan, strategy, event_id AS position, ok, confidence, (cpu::BIGINT % 6)::BIGINT AS n_fields, seconds FROM log)"
SCORED = f"{RESULTS}, scored AS (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY confidence DESC, position) AS place, CASE WHEN ok THEN least(confidence + least(0.1 * n_fields, 0.3) + greatest(0, 0.2 - seconds / 10), 1) ELSE 0 END AS score FROM results)"


def results(spark: SparkSession, sf: str) -> DataFrame:
    return log(spark, sf).select("plan", "strategy", F.col("event_id").alias("position"), "ok", "confidence", (F.col("cpu").cast("long") % 6).alias("n_fields"), "seconds")


@query(f"WITH {RESULTS}, c AS (SELECT plan, coalesce(min(position) FILTER (ok), max(position)) AS position FROM results GROUP BY 1) SELECT c.plan, c.position, r.strategy, r.ok, (SELECT count(*) FROM results x WHERE x.plan = c.plan AND x.position <= c.position) AS attempts FROM c JOIN results r ON r.plan = c.plan AND r.position = c.position")
def first_successes(spark: SparkSession, sf: str) -> DataFrame:
    return strategies.first_success(results(spark, sf), "plan").select("plan", "position", "strategy", "ok", F.col("attempts").cast("long").alias("attempts"))


@query(f"WITH {RESULTS}, r AS (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY position) AS place FROM results) SELECT plan, position, place FROM r WHERE place <= 3")
def parallel_results(spark: SparkSession, sf: str) -> DataFrame:
    return strategies.first_strategies(results(spark, sf), "plan", 3).select("plan", "position", F.col("place").cast("long").alias("place"))


@query(f"WITH {SCORED} SELECT plan, position, score::DOUBLE AS score FROM scored WHERE place <= 3 QUALIFY row_number() OVER (PARTITION BY plan ORDER BY score DESC, place) = 1")
def competitive_results(spark: SparkSession, sf: str) -> DataFrame:
    return strategies.best_of_confident(results(spark, sf), "plan").select("plan", "position", "score")


@query(f"WITH {RESULTS}, o AS (SELECT plan, position % 2 AS field, CASE WHEN n_fields > 0 THEN strategy || n_fields ELSE ' ' END AS value, row_number() OVER (PARTITION BY plan ORDER BY confidence + CASE WHEN strategy = 'css' THEN 0.1 ELSE 0 END DESC, position) AS place FROM results) SELECT plan, field, min_by(value, place) AS value FROM o WHERE trim(value) <> '' GROUP BY 1, 2")
def collaborative_results(spark: SparkSession, sf: str) -> DataFrame:
    value = F.when(F.col("n_fields") > 0, F.concat("strategy", F.col("n_fields").cast("string"))).otherwise(" ")
    rows = results(spark, sf).withColumns({"field": F.col("position") % 2, "value": value})
    return strategies.filled_in_order(strategies.collaboration_order(rows, "plan"), "plan")


@query(f"WITH {LOG}, r AS (SELECT domain, tool AS strategy, min(event_id) AS position, count(*) AS attempts, (count(*) FILTER (ok)) / count(*) AS rate, max(confidence) AS confidence FROM log GROUP BY 1, 2) SELECT domain, coalesce((list(strategy ORDER BY rate DESC, position) FILTER (rate > 0.9 AND attempts >= 3))[1], (list(strategy ORDER BY confidence DESC, position))[1]) AS strategy FROM r GROUP BY 1")
def adaptive_choices(spark: SparkSession, sf: str) -> DataFrame:
    rows = log(spark, sf).groupBy("domain", F.col("tool").alias("strategy")).agg(F.min("event_id").alias("position"), F.count("*").alias("attempts"), (F.count_if("ok") / F.count("*")).alias("rate"), F.max("confidence").alias("confidence"))
    return strategies.adaptive_choice(rows, "domain", 3, 0.9)


@query(f"WITH {RESULTS} SELECT plan, round(least(0.5 + CASE WHEN count(*) > 1 THEN 0.15 ELSE 0.05 END + CASE WHEN sum(n_fields) > 5 THEN 0.1 WHEN sum(n_fields) > 3 THEN 0.05 ELSE 0 END, 1), 4)::DOUBLE AS confidence, max(n_fields) < 4 AS needs_more FROM results GROUP BY 1")
def hybrid_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return strategies.hybrid_outcome(results(spark, sf), "plan", F.lit(0.5), 4).withColumn("confidence", r4(F.col("confidence")))


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'Product' WHEN 1 THEN 'Organization,LocalBusiness' WHEN 2 THEN 'Article' WHEN 3 THEN 'Organization,LocalBusiness' WHEN 4 THEN 'LocalBusiness,Organization' ELSE 'Product,Organization,Article' END AS types,
    CASE page_id % 4 WHEN 0 THEN 'llm_extraction' WHEN 1 THEN 'llm_extraction,css_extraction' WHEN 2 THEN 'css_extraction,llm_extraction' ELSE 'llm_extraction' END AS fallback, page_id % 3 < 2 AS enhance, round(0.8 * (0.7 + 0.3 * (page_id % 11) / 10), 4)::DOUBLE AS rate FROM pages""")
def strategy_rules(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda *values: F.get(F.array(*map(F.lit, values)), (i() % len(values)).cast("int"))
    purpose, primary = pick(*strategies.STRUCTURED_TYPES, "other"), pick("css_extraction", "json_css_hybrid", "regex_extraction", "unknown")
    wanted = F.array(F.lit("a"), F.lit("b"))
    found = F.slice(wanted, F.lit(1), (i() % 3).cast("int"))
    return table(spark, sf, "pages").select(
        "page_id", F.array_join(strategies.structured_types(purpose), ",").alias("types"), F.array_join(strategies.fallbacks(primary), ",").alias("fallback"), strategies.needs_enhancement(found, wanted).alias("enhance"),
        r4(strategies.adjusted_rate(F.lit(0.8), (i() % 11) / 10)).alias("rate"),
    )


@query("SELECT page_id, CASE WHEN page_id % 10 >= 8 THEN 'expand_scope' ELSE concat_ws(',', CASE WHEN page_id % 10 < 3 THEN 'adjust_weights' END, CASE WHEN page_id % 10 < 8 THEN 'review_filters' END, CASE WHEN page_id % 10 < 5 THEN 'widen_goals' END, CASE WHEN page_id % 10 < 6 THEN 'tune_scores' END) END AS advice FROM pages")
def effectiveness_advice(spark: SparkSession, sf: str) -> DataFrame:
    x = (i() % 10) / 10
    return table(spark, sf, "pages").select("page_id", F.array_join(strategies.effectiveness_advice(x, x, x, x), ",").alias("advice"))


@query(f"WITH {LOG}, {PLANS}, p AS (SELECT plan, tools, lead(tools) OVER (PARTITION BY plan % 97 ORDER BY plan) AS new FROM plans) SELECT plan, array_to_string(list_sort(list_filter(list_distinct(new), lambda t: NOT list_contains(tools, t))), ',') AS added, array_to_string(list_sort(list_filter(list_distinct(tools), lambda t: NOT list_contains(new, t))), ',') AS removed FROM p WHERE new IS NOT NULL")
def plan_changes(spark: SparkSession, sf: str) -> DataFrame:
    later = F.lead("tools").over(Window.partitionBy(F.col("plan") % 97).orderBy("plan"))
    rows = plans(spark, sf).select("plan", "tools", later.alias("new")).where("new IS NOT NULL")
    both = rows.select("plan", strategies.array_changes(F.col("tools"), F.col("new")).alias("c"))
    return both.select("plan", F.array_join("c.added", ",").alias("added"), F.array_join("c.removed", ",").alias("removed"))


@query("SELECT page_id, key, old, new FROM (SELECT page_id, 'a' AS key, '1' AS old, (page_id % 3)::VARCHAR AS new FROM pages UNION ALL SELECT page_id, 'b', 'x', NULL FROM pages UNION ALL SELECT page_id, 'c', NULL, 'y' FROM pages WHERE page_id % 2 = 0) WHERE old IS DISTINCT FROM new")
def parameter_changes(spark: SparkSession, sf: str) -> DataFrame:
    old = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("x"))
    new = F.create_map(F.lit("a"), (i() % 3).cast("string"))
    new = F.when(i() % 2 == 0, F.map_concat(new, F.create_map(F.lit("c"), F.lit("y")))).otherwise(new)
    rows = table(spark, sf, "pages").select("page_id", F.explode(strategies.map_changes(old, new)).alias("key", "v"))
    return rows.select("page_id", "key", "v.old", "v.new")


@query("WITH c AS (SELECT c_custkey AS url, (c_custkey * 7919) % 10007 AS at FROM customer), l AS (SELECT o_custkey AS src, o_orderkey % (SELECT count(*) FROM customer) AS dst FROM orders) SELECT b.url, max_by(a.url, a.at * 1000000000 + a.url) AS parent FROM l JOIN c a ON a.url = l.src JOIN c b ON b.url = l.dst WHERE a.at < b.at GROUP BY 1")
def discovered_parents(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    customers = table(spark, sf, "customer")
    crawled = customers.select(key.alias("url"), (key * 7919 % 10007).alias("at"))
    links = table(spark, sf, "orders").join(F.broadcast(customers.agg(F.count("*").alias("n")))).select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % F.col("n")).alias("dst"))
    return strategies.discovered_parents(crawled, links)


#: A catalogue of tools: keywords; capabilities, inputs, outputs; performance, reliability.
KEYWORDS = {"crawler": ("alpha", "the", "ing"), "analyzer": ("tion", "data"), "exporter": ("out", "zzz")}
TOOLS = {"crawler": (("crawl", "extract"), ("url",), ("html",)), "analyzer": (("analyze",), ("html",), ("report",)), "exporter": (("export",), ("report",), ("file",))}
QUALITY = {"crawler": (0.5, 1.0), "analyzer": (1.0, 0.5), "exporter": (0.75, 0.75)}
_HITS = "(contains(lower(text), '{}'))::INT"


def _keyword_sql(words: tuple[str, ...]) -> str:
    return "(" + " + ".join(_HITS.format(w) for w in words) + f") / {len(words)} * 0.8"


_KEYWORD_ROWS = " UNION ALL ".join(f"SELECT doc_id, '{tool}' AS tool, {_keyword_sql(words)} AS score FROM documents" for tool, words in KEYWORDS.items())


@query(f"SELECT doc_id, tool, round(score, 4) AS score FROM ({_KEYWORD_ROWS}) WHERE score > 0")
def tool_keyword_matches(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.explode(matching.keyword_matches(F.col("text"), KEYWORDS)).alias("m"))
    return rows.select("doc_id", "m.tool", r4(F.col("m.score")).alias("score"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'crawler:1.26' WHEN 1 THEN 'analyzer:0.6,crawler:0.78' WHEN 2 THEN 'exporter:1.26' ELSE '' END AS tools FROM pages""")
def tool_matches(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda *sets: F.get(F.array(*[F.array(*map(F.lit, x)).cast("array<string>") for x in sets]), (i() % 4).cast("int"))
    wanted, takes, gives = pick(("crawl",), ("crawl", "analyze"), ("export",), ("sing",)), pick(("url",), ("url",), ("report",), ("none",)), pick(("html",), (), ("file",), ())
    found = matching.capability_matches(wanted, takes, gives, TOOLS)
    best = matching.best_tools([found, F.filter(found, lambda m: m["tool"] == "exporter")], QUALITY, 2)
    return table(spark, sf, "pages").select("page_id", F.array_join(F.array_sort(F.transform(best, lambda m: F.concat(m["tool"], F.lit(":"), F.round(m["score"], 4).cast("string")))), ",").alias("tools"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'crawler:3.0' WHEN 1 THEN 'exporter:1.0' WHEN 2 THEN 'crawler:1.0' ELSE '' END AS tools, CASE page_id % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 0.5 ELSE 0 END::DOUBLE AS template, CASE WHEN page_id % 2 = 0 THEN 'export_csv,analyze' ELSE 'export_json' END AS expanded FROM pages")
def intent_matches(spark: SparkSession, sf: str) -> DataFrame:
    request = F.get(F.array(*map(F.lit, ("Crawl a site", "save it", "fetch it", "nothing"))), (i() % 4).cast("int"))
    found = matching.intent_scores(request, {"crawler": ("crawl",), "exporter": ("export",)}, [("crawl", "fetch"), ("export", "save")])
    available = F.when(i() % 2 == 0, F.array(*map(F.lit, ("analyze", "export_csv", "export_json")))).otherwise(F.array(F.lit("export_json")))
    return table(spark, sf, "pages").select(
        "page_id", F.array_join(F.transform(found, lambda m: F.concat(m["tool"], F.lit(":"), m["score"].cast("string"))), ",").alias("tools"), matching.template_match(request, ("crawl", "save")).alias("template"),
        F.array_join(matching.expanded_template(available, ("export_*", "analyze", "other")), ",").alias("expanded"),
    )


@query("WITH c AS (SELECT DISTINCT p_brand AS tool, p_size AS capability FROM part), o AS (SELECT DISTINCT a.tool, b.tool AS other FROM c a JOIN c b USING (capability) WHERE a.tool <> b.tool), p AS (SELECT p_brand AS tool, avg(p_retailprice) AS t FROM part GROUP BY 1) SELECT o.tool, o.other, round(a.t - b.t, 4) AS saved FROM o JOIN p a ON a.tool = o.tool JOIN p b ON b.tool = o.other WHERE b.t < 0.99 * a.t")
def faster_tools(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    others = matching.alternatives(p.select(F.col("p_brand").alias("tool"), F.col("p_size").alias("capability")).distinct())
    profiles = p.groupBy(F.col("p_brand").alias("tool")).agg(F.avg("p_retailprice").alias("avg_seconds"))
    return matching.faster_alternatives(profiles, others, 0.99).withColumn("saved", r4(F.col("saved")))


_A, _B = "red apple tree grows near old stone house every single summer", "quick brown foxes jump over lazy sleeping dogs during cold nights"


@query("SELECT page_id, place, 1.0::DOUBLE AS score, CASE WHEN place = 1 THEN 2 + page_id % 3 ELSE 1 END AS size FROM pages, (VALUES (1), (2)) v(place)")
def paragraph_clusters(spark: SparkSession, sf: str) -> DataFrame:
    rows = built(spark, sf, f"<p>{_A}</p><div>too short</div><p>{_B}</p>", F.repeat(F.lit(f"<section>{_A}</section>"), (1 + i() % 3).cast("int")))
    return paragraphs.clusters(rows, "page_id").select("page_id", "place", r4(F.col("score")).alias("score"), F.size("members").cast("long").alias("size"))


@query(f"SELECT page_id, 1 AS place, '{_B}' AS text FROM pages")
def paragraphs_about(spark: SparkSession, sf: str) -> DataFrame:
    rows = built(spark, sf, f"<p>{_A}</p><p>{_B}</p>", F.repeat(F.lit(f"<p>{_A}</p>"), (i() % 3).cast("int")))
    return paragraphs.clusters(rows, "page_id", query="quick brown foxes jump", least=0.3).select("page_id", "place", "text")


@query("""SELECT page_id, round(0.3 + least((page_id % 3 + (page_id % 2 = 0)::INT) * 0.1, 0.4) + CASE WHEN page_id % 2 = 0 THEN 0.2 ELSE 0 END + CASE WHEN page_id % 5 = 0 THEN 0.1 ELSE 0 END, 4)::DOUBLE AS directory, round(0.3 + CASE WHEN page_id % 2 = 0 THEN 0.4 ELSE 0 END + CASE WHEN page_id % 3 = 2 THEN 0.1 ELSE 0 END, 4)::DOUBLE AS social,
    round(0.5 + CASE WHEN page_id % 2 = 0 THEN 0.1 ELSE 0 END + CASE WHEN page_id % 5 = 0 THEN 0.1 ELSE 0 END, 4)::DOUBLE AS structured, CASE WHEN page_id % 12 >= 10 THEN 0.9 WHEN page_id % 12 >= 5 THEN 0.8 WHEN page_id % 12 >= 2 THEN 0.6 ELSE 0.3 END::DOUBLE AS clusters,
    concat_ws(',', CASE WHEN page_id % 5 = 0 THEN 'recaptcha' END, CASE WHEN page_id % 3 = 0 THEN 'text_captcha' END) AS captchas FROM pages""")
def page_confidences(spark: SparkSession, sf: str) -> DataFrame:
    rows = built(spark, sf, F.get(F.array(F.lit("<p>"), F.lit("<p>listing "), F.lit("<p>listing directory about ")), (i() % 3).cast("int")), when(i() % 2 == 0, "<h2></h2><h2></h2><h3></h3><h1></h1><b itemtype=t></b>"), when(i() % 5 == 0, '<a href="tel:1"></a><a href="tel:2"></a><a href="tel:3"></a><b class="g-recaptcha"></b><b typeof=x></b>'), when(i() % 3 == 0, '<u name="captcha"></u>'))
    h = F.col("html")
    url = F.when(i() % 2 == 0, "https://www.linkedin.com/in/a").otherwise("https://a.org/")
    return rows.select("page_id", r4(page_fields.directory_score(h)).alias("directory"), r4(page_fields.social_score(url, h)).alias("social"), r4(page_fields.structured_score(h, F.lit("other"))).alias("structured"), page_fields.cluster_score(i() % 12).alias("clusters"), F.array_join(page_fields.captchas(h), ",").alias("captchas"))


@query("""SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'email' WHEN 1 THEN 'name' WHEN 2 THEN 'phone' WHEN 3 THEN 'company' WHEN 4 THEN 'message' WHEN 5 THEN 'password' WHEN 6 THEN 'message' ELSE 'unknown' END AS purpose, round(CASE page_id % 3 WHEN 0 THEN 1 WHEN 1 THEN (1 + 1.0 / 3 + 0.5) / 3 ELSE 0 END, 4)::DOUBLE AS alike,
    CASE page_id % 4 WHEN 0 THEN 'product_to_price' WHEN 1 THEN 'article_to_author' END AS relation, CASE WHEN page_id % 2 = 0 THEN 'contact_info_present' ELSE 'detailed_text_content' END AS indicators FROM pages""")
def element_rules(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda *values: F.get(F.array(*map(F.lit, values)), (i() % len(values)).cast("int"))
    purpose = page_fields.field_purpose(pick("Your E-Mail", "username", "Mobile no", "organization", "your inquiry", "pw", "x", "x"), pick("text", "text", "text", "text", "text", "password", "text", "text"), pick("input", "input", "input", "input", "input", "input", "textarea", "input"))
    element = lambda tag, classes, children, length: F.struct(tag.alias("tag"), F.array(*map(F.lit, classes)).alias("classes"), F.lit(children).alias("children"), F.lit(length).alias("length"))
    one, same, other = element(F.lit("li"), ("a", "b"), 0, 10), element(F.lit("li"), ("a", "b"), 0, 10), element(F.when(i() % 3 == 1, "li").otherwise("p"), ("b", "c"), 0, 5)
    alike = F.when(i() % 3 == 0, page_fields.structural_similarity(one, same)).otherwise(page_fields.structural_similarity(one, other))
    relation = page_fields.relation(F.lit("text"), pick("price", "name", "name", "text"), pick(0, 99, 100, 0))
    fields = F.when(i() % 2 == 0, F.create_map(F.lit("email"), F.lit("a@b.org"))).otherwise(F.create_map(F.lit("text"), F.repeat(F.lit("x"), F.lit(51))))
    return table(spark, sf, "pages").select("page_id", purpose.alias("purpose"), r4(alike).alias("alike"), relation.alias("relation"), F.array_join(page_fields.success_indicators(fields), ",").alias("indicators"))


@query("SELECT page_id, round(least(length(html) / 10000, 1), 4) AS length, 0.0::DOUBLE AS structured, 0.4::DOUBLE AS meta, round(least(len(regexp_extract_all(html, '(?i)<a\\b')) / 50, 1), 4) AS links, 0.5::DOUBLE AS forms FROM pages")
def page_quality(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "pages").select("page_id", page_fields.page_quality(F.col("html")).alias("q"))
    return q.select("page_id", *[r4(F.col(f"q.{c}")).alias(c) for c in ("length", "structured", "meta", "links", "forms")])


@query("WITH d AS (SELECT l_linenumber AS depth, count(*) AS pages, sum(l_quantity) AS links, avg(l_extendedprice) AS a, avg(l_quantity) AS b FROM lineitem WHERE l_discount > 0.02 GROUP BY 1) SELECT depth, pages, links, round(a, 4) AS avg_length, round(b, 4) AS avg_links, depth = (SELECT depth FROM d ORDER BY a DESC, depth LIMIT 1) AS richest, depth = (SELECT depth FROM d ORDER BY b DESC, depth LIMIT 1) AS most_connected FROM d")
def content_by_depth(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("depth"), (F.col("l_discount") > 0.02).alias("success"), F.col("l_extendedprice").alias("length"), F.col("l_quantity").alias("n_links"))
    out = reports.content_by_depth(rows)
    return out.select("depth", "pages", "links", r4(F.col("avg_length")).alias("avg_length"), r4(F.col("avg_links")).alias("avg_links"), "richest", "most_connected")


@query(f"WITH {LOG} SELECT domain, strategy, count(*) AS attempts, round((count(*) FILTER (ok)) / count(*), 4) AS rate FROM log GROUP BY ROLLUP (domain, strategy)")
def performance_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return reports.performance_rollup(log(spark, sf), ["domain", "strategy"]).withColumn("rate", r4(F.col("rate")))


@query(f"WITH {LOG}, {PROFILES} SELECT tool, round(success_rate, 4) AS success_rate FROM (SELECT * FROM profiles ORDER BY success_rate, tool LIMIT 3) WHERE success_rate < 0.8")
def improvement_areas(spark: SparkSession, sf: str) -> DataFrame:
    return reports.improvement_areas(reports.tool_profiles(log(spark, sf))).select("tool", r4(F.col("success_rate")).alias("success_rate"))


_FAILURES = "failures AS (SELECT CASE WHEN contains(t, 'timeout') THEN 'timeout' WHEN contains(t, 'not found') OR contains(t, '404') THEN 'not_found' WHEN contains(t, 'permission') OR contains(t, 'forbidden') THEN 'permission' WHEN contains(t, 'parse') OR contains(t, 'extract') THEN 'extraction' ELSE 'other' END AS failure, count(*) AS n FROM (SELECT lower(error) AS t FROM log WHERE error IS NOT NULL) GROUP BY 1)"


@query(f"WITH {LOG}, {PROFILES}, {_FAILURES}, r AS (SELECT 0 AS step, '' AS subject, 'low_success_rate' AS kind FROM log HAVING avg(ok::INT) < 0.7 UNION ALL SELECT 1, tool, 'weak_tool' FROM profiles WHERE success_rate < 0.6 UNION ALL SELECT 1, tool, 'slow_tool' FROM profiles WHERE avg_seconds > 30 UNION ALL SELECT 2, failure, 'common_failure' FROM failures WHERE n > 5) SELECT row_number() OVER (ORDER BY step, subject, kind DESC) AS place, kind, subject FROM r ORDER BY 1 LIMIT 5")
def learning_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    rows = log(spark, sf)
    overall = rows.agg(F.avg(F.col("ok").cast("int")).alias("success_rate"))
    failures = rows.where("error IS NOT NULL").groupBy(executions.failure_class(F.col("error")).alias("failure")).agg(F.count("*").alias("n"))
    return reports.recommendations(overall, reports.tool_profiles(rows), failures).withColumn("place", F.col("place").cast("long"))


@query(f"WITH {LOG}, c AS (SELECT domain, cpu::BIGINT % 13 AS field, count(*) AS n FROM log WHERE confidence > 0.7 GROUP BY 1, 2) SELECT domain, field, n FROM c QUALIFY row_number() OVER (PARTITION BY domain ORDER BY n DESC, field) <= 5")
def common_fields(spark: SparkSession, sf: str) -> DataFrame:
    rows = log(spark, sf).withColumn("field", F.col("cpu").cast("long") % 13)
    return reports.common_fields(rows, "field", "domain", 5, 0.7).select("domain", "field", "n")


@query("WITH c AS (SELECT event_id // 3 AS tool, event_type, user_id % 2 AS parity FROM events) SELECT tool, 'type' AS parameter, min(event_type) AS value, count(event_type) AS n FROM c GROUP BY 1 HAVING min(event_type) = max(event_type) AND count(event_type) > 1 UNION ALL SELECT tool, 'parity', min(parity)::VARCHAR, count(*) FROM c GROUP BY 1 HAVING min(parity) = max(parity) AND count(*) > 1")
def constant_parameters(spark: SparkSession, sf: str) -> DataFrame:
    pairs = F.create_map(F.lit("type"), F.col("event_type"), F.lit("parity"), (F.col("user_id") % 2).cast("string"))
    calls = table(spark, sf, "events").select(F.floor(F.col("event_id") / 3).alias("tool"), F.explode(pairs).alias("parameter", "value"))
    return reports.constant_parameters(calls, ["tool", "parameter"], "value")


@query(f"WITH {LOG}, {PLANS} SELECT plan, array_to_string(list_transform(tools, lambda t, k: k || ':' || t), ',') AS steps, 0.72::DOUBLE AS confidence FROM plans WHERE NOT ok ORDER BY plan DESC LIMIT 10")
def failed_plans(spark: SparkSession, sf: str) -> DataFrame:
    rows = reports.failed_plans(plans(spark, sf)).select("plan", reports.renumbered(F.col("tools"), F.lit(0.8)).alias("p"))
    return rows.select("plan", F.array_join(F.transform("p.steps", lambda x: F.concat(x["step"].cast("string"), F.lit(":"), x["tool"])), ",").alias("steps"), r4(F.col("p.confidence")).alias("confidence"))
