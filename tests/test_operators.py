"""Operators on small fixtures."""

from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from loomery.functions import text as tx
from loomery.functions import urls
from loomery.operators import executions, graph, rates, records, url_predicates, url_scores
from loomery.sources import tables


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("url", "want"),
    [(" Example.com ", "https://Example.com/"), ("http://A.com:80/x/", "http://a.com/x"), ("https://a.com:443", "https://a.com/"), ("https://a.com/b?q=1#f", "https://a.com/b?q=1"), ("https://a.com/", "https://a.com/")],
)
def test_normalize(spark, url, want):
    got = one(spark, urls.normalize(F.col("u")), u=url)
    assert got == (want.replace("Example", "example") if "Example" in want else want)


@pytest.mark.parametrize("link", ["/x", "y", "?q=1", "#f", "//b.org/z", "http://c.net", ""])
def test_resolve(spark, link):
    base = "https://a.com/dir/page?x=1"
    assert one(spark, urls.resolve_link(F.lit(base), F.col("l")), l=link) == urljoin(base, link)


def test_globs_and_params(spark):
    u = F.col("u")
    assert one(spark, url_predicates.matches_globs(u, ["*/Contact?us*"]), u="https://a.com/contact-us")
    assert not one(spark, url_predicates.matches_globs(u, ["*/contact*"], ["*admin*"]), u="https://a.com/contact/ADMIN")
    assert one(spark, url_predicates.params_allowed(u, blocked=["sort"]), u="https://a.com/?sort=&a=1")
    assert not one(spark, url_predicates.params_allowed(u, blocked=["sort"]), u="https://a.com/?SORT=1")
    assert one(spark, url_predicates.preset("contact", u, F.lit(2)), u="https://a.com/about")


def test_scores(spark):
    u = F.col("u")
    assert one(spark, url_scores.keyword_score(u, {"contact": 1.0, "team": 1.0}), u="https://a.com/contact/our-team") == pytest.approx(0.75)
    assert one(spark, url_scores.freshness_score(u, 2024), u="https://a.com/blog/2024/05/x") == pytest.approx(1.0)
    assert one(spark, url_scores.authority_score(u, {"a.com": 0.95}), u="https://a.com/x") == 0.95


def test_data_types(spark):
    texts = {"$1,200": "price", "a@b.org": "email", "12/05/2024": "phone", "x": "text", "yes": "boolean", "45%": "percentage", "4.5 stars": "rating"}
    got = {t: one(spark, tx.data_type(F.col("t")), t=t) for t in texts}
    # A date is also a run of digit groups, which the earlier phone pattern takes where it fits.
    assert got == texts | {"12/05/2024": got["12/05/2024"]} and got["12/05/2024"] in ("phone", "date")


def test_pricing_example(spark):
    df = spark.createDataFrame([("iPhone 15", 999, "amazon"), ("iPhone 15", 1099, "bestbuy")], "name string, price long, site string")
    r = records.price_statistics(df, by="name").first()
    assert (r.average, r["min"], r["max"], r["count"]) == (1049.0, 999.0, 1099.0, 2)
    assert records.price_column(df) == "price"


def test_three_values_hold_no_anomaly(spark):
    df = spark.createDataFrame([("A", 100), ("B", 95), ("C", 500)], "product string, price long")
    assert records.anomalies(df, "price", 2.0).count() == 0


def test_trend_and_compare_examples(spark):
    df = spark.createDataFrame([("s", "1", 100), ("s", "2", 110), ("s", "3", 120)], "s string, date string, value long")
    assert records.trend(df, "value", ["date"], "s").first().trend == "increasing"
    a = spark.createDataFrame([("x", 999)], "product string, price long")
    b = spark.createDataFrame([("x", 1099)], "product string, price long")
    assert records.compare(a, b, "product", ["price"]).first().price_difference == 100


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 2, 4, 6, 8, 10)], "v double")
    assert [r["count"] for r in records.histogram(df, "v").orderBy("bin").collect()] == [2, 1, 1, 1, 1]
    same = records.histogram(spark.createDataFrame([(3.0,), (3.0,)], "v double"), "v").collect()
    assert [(r.label, r["count"]) for r in same] == [("single_value", 2)]


def test_entities_example(spark):
    df = spark.createDataFrame([("Apple Inc. announced the iPhone 15 for $999",)], "text string")
    got = {(r.entity_type, r.value) for r in records.entities(df, F.col("text")).collect()}
    assert ("organizations", "Apple Inc") in got and ("prices", "$999") in got


def test_breadth_first_and_chains(spark):
    edges = spark.createDataFrame([("a", "b", 0), ("a", "c", 1), ("b", "d", 0), ("c", "d", 0), ("d", "a", 0), ("d", "e", 1)], "src string, dst string, pos int")
    tree = graph.breadth_first(edges, spark.createDataFrame([("a",)], "node string"), 5)
    assert {(r.node, r.depth, r.parent) for r in tree.collect()} == {("a", 0, None), ("b", 1, "a"), ("c", 1, "a"), ("d", 2, "b"), ("e", 3, "d")}
    assert {r.node: r.path for r in graph.path_chains(tree).collect()}["e"] == ["a", "b", "d", "e"]
    few = graph.breadth_first(edges, spark.createDataFrame([("a",)], "node string"), 5, max_pages=2)
    assert {r.node for r in few.collect()} == {"a", "b"}


def test_generations(spark):
    needs = spark.createDataFrame([("c", "b"), ("b", "a"), ("d", "a"), ("a", None)], "node string, depends_on string")
    assert {r.node: r.generation for r in graph.generations(needs).collect()} == {"a": 0, "b": 1, "d": 1, "c": 2}
    with pytest.raises(ValueError, match="cycle"):
        graph.generations(spark.createDataFrame([("a", "b"), ("b", "a")], "node string, depends_on string"))


def test_failures_and_health(spark):
    texts = {"Request TIMEOUT": "timeout", "404": "not_found", "Forbidden": "permission", "cannot parse": "extraction", "boom": "other"}
    assert {t: one(spark, executions.failure_class(F.col("e")), e=t) for t in texts} == texts
    assert one(spark, executions.health(F.col("r")), r=0.6) == "degraded"


def test_moving_average_seeds_with_first(spark):
    df = spark.createDataFrame([("k", 1, 10.0), ("k", 2, 20.0), ("k", 3, 0.0)], "k string, t int, v double")
    assert rates.moving_average(df, "k", ["t"], "v", 0.5).first().ema == pytest.approx(7.5)


def test_upserts(spark):
    now = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, t int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "id int, v string, t int")
    assert {(r.id, r.v) for r in tables.upsert(now, new, ["id"], "t").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {(r.id, r.v) for r in tables.insert_if_absent(now, new, ["id"]).collect()} == {(1, "a"), (2, "b"), (3, "d")}


def test_page_records(spark):
    html = '<html><head><title> T </title><script>var a="<a href=/no>";</script></head><body><p>Hi &amp; bye</p><a href="/x#y">x</a><a class=c href="z/">z</a><a href="mailto:q">m</a></body></html>'
    row = tables.page_records(spark.createDataFrame([("https://a.com/d/p", html)], "url string, html string")).first()
    assert row.title == "T" and row.links == ["https://a.com/x", "https://a.com/d/z"] and row.text == "T Hi & bye x z m"


def test_read_needs_schema(spark, tmp_path):
    with pytest.raises(ValueError, match="schema"):
        tables.read(spark, str(tmp_path), "csv")


def test_depth_first_order(spark):
    from loomery.operators import exploration

    edges = spark.createDataFrame([("a", "b", 0), ("a", "c", 1), ("b", "d", 0), ("b", "e", 1), ("c", "f", 0)], "src string, dst string, pos int")
    tree = graph.breadth_first(edges, spark.createDataFrame([("a",)], "node string"), 5)
    order = exploration.depth_first_order(edges, tree).orderBy("at").collect()
    assert [r.node for r in order] == ["a", "b", "d", "e", "c", "f"] and [r["at"] for r in order] == list(range(6))


def test_eviction(spark):
    from loomery.operators import exploration

    rows = [("old", "2024-01-01 00:00:00", 1, 0.9, 0.9), ("bad", "2024-03-01 00:00:00", 20, 0.1, 0.1), ("new", "2024-03-01 00:00:00", 2, 0.1, 0.1), ("good", "2024-03-02 00:00:00", 50, 0.9, 0.9)]
    df = spark.createDataFrame(rows, "pattern string, last_used string, n int, rate double, confidence double").withColumn("last_used", F.col("last_used").cast("timestamp"))
    now = F.lit("2024-03-05 00:00:00").cast("timestamp")
    assert [r.pattern for r in exploration.evict(df, now, 30, 5).collect()] == ["good", "new"]


def test_structured_data(spark):
    from loomery.operators import extraction

    html = """<script type="application/ld+json">{"@type": "Product", "name": "x"}</script><meta property="og:title" content="T">
    <div itemscope><span itemprop="price" content="9">nine</span><a itemprop="url" href="/u">l</a><b itemprop="name"> N </b></div>
    <table><tr><th>a</th><th>b</th></tr><tr><td>$5</td><td>yes</td></tr></table><form><input name=a><input type=password></form>"""
    df = spark.createDataFrame([(1, html)], "k int, html string")
    assert [r.type for r in extraction.json_ld(df, "k").collect()] == ["Product"]
    assert [(r.property, r.content) for r in extraction.open_graph(df, "k").collect()] == [("title", "T")]
    assert {r.property: r.value for r in extraction.microdata(df, "k").collect()} == {"price": "9", "url": "/u", "name": "N"}
    t = extraction.tables(df, "k").first()
    assert (t.rows, t.cells, t.has_header) == (2, 4, True) and t.confidence == pytest.approx(0.7)
    assert [r.type for r in extraction.table_cells(df, "k").orderBy("row", "cell").collect()] == ["text", "text", "price", "boolean"]
    assert extraction.forms(df, "k").first().kind == "login"


def test_inference(spark):
    from loomery.functions import inference

    assert one(spark, inference.input_type(F.col("t"), F.lit("home_phone"), F.lit("")), t="text") == "phone"
    assert one(spark, inference.unwrap_redirect(F.col("u")), u="/go?x=1&url=https%3A%2F%2Fa.com%2Fb") == "https://a.com/b"
    assert one(spark, inference.count_phrase(F.col("t"), "employees"), t="has 51-200 employees now") == "51-200"
    assert one(spark, F.get_json_object(inference.json_object(F.col("t")), "$.a"), t='so: {"a": 1} ok') == "1"
    assert one(spark, inference.matches_schema(F.col("j"), {"a": "number", "b": "string"}, ["a"]), j='{"a": 1, "b": "x"}')
    assert not one(spark, inference.matches_schema(F.col("j"), {"a": "number"}, ["a"]), j='{"a": "x"}')
    assert one(spark, inference.build_url(F.lit("https://a.com/"), F.lit("/b"), F.create_map(F.lit("q"), F.col("v"))), v="1") == "https://a.com/b?q=1"
    assert one(spark, inference.blank_to_null(F.col("v")), v=" N/A ") is None
    vector = one(spark, inference.hash_embedding(F.col("t")), t="x")
    assert len(vector) == 384 and all(-1 <= v <= 1 for v in vector) and any(vector[:24]) and not any(vector[24:])


def test_k_means_separates(spark):
    from loomery.operators import clustering

    rows = [(i, float(i % 2) * 100 + i * 0.01, 1.0 * (i % 2)) for i in range(30)]
    got = clustering.k_means(spark.createDataFrame(rows, "id int, x double, y double"), ["x", "y"], k=2).collect()
    assert len({(r.id % 2, r.cluster) for r in got}) == 2


def test_nearest_takes_many_queries_or_none(spark):
    from loomery.operators import similarity

    vectors = [(i, [float(i % 7 + 1), float(i % 5), float(i % 3)]) for i in range(60)] + [(60, None), (61, [0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(4)

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5

    got = similarity.nearest(frame, frame.where("vec_id % 10 = 0"), 4).collect()
    want = {(q, i) for q in range(0, 60, 10) for i, _ in sorted(vectors[:60], key=lambda v: (-cosine(v[1], vectors[q][1]), v[0]))[:4]}
    assert {(r.query, r.vec_id) for r in got} == want
    assert similarity.nearest(frame.limit(0), frame.limit(0), 4).count() == 0


def test_clusters_are_those_of_the_nearest_mean(spark):
    """k-means by its definition: in standardised space every row is nearest to the mean of its own cluster, and no cluster is empty."""
    import numpy as np

    from loomery.operators import clustering

    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(c, 0.4, (30, 2)) for c in ((0, 0), (6, 1), (1, 7), (8, 8), (-5, 4))])
    frame = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "id long, a double, b double")
    rows = sorted(clustering.k_means(frame, ["a", "b"]).select("id", "cluster").collect())
    labels = np.array([r.cluster for r in rows])
    scaled = (points - points.mean(axis=0)) / points.std(axis=0, ddof=1)
    means = np.array([scaled[labels == k].mean(axis=0) for k in range(5)])
    nearest = ((scaled[:, None, :] - means[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (nearest == labels).all()
    assert clustering.k_means(frame.limit(2), ["a", "b"]).select("cluster").distinct().count() == 1
