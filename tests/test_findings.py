"""Cases that a review found: each query on a small table of its own, against its oracle."""

import random
import tracemalloc

import duckdb
import pytest
from pyspark.sql import functions as F

from loomery.functions.markup import stream_markup
from loomery.operators import discovery, markup, matching, page_patterns, similarity
from loomery.plans import registry


def differences(spark, folder, name, tables):
    """Rows that only the query or only its SQL gives, over ``tables`` (name: (columns, rows))."""
    con = duckdb.connect()
    for t, (columns, data) in tables.items():
        spark.createDataFrame(data, columns).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = registry.QUERIES[name](spark, str(folder))
    got.write.parquet(f"{folder}/got")
    con.execute(f"CREATE TABLE want AS {registry.ORACLES[name]}")
    names = ", ".join(f'"{c}"' for c in got.columns)
    one, other = f"SELECT {names} FROM '{folder}/got/*.parquet'", f"SELECT {names} FROM want"
    assert con.execute("SELECT count(*) FROM want").fetchall()[0][0] > 0
    return con.execute(f"({one} EXCEPT ALL {other}) UNION ALL ({other} EXCEPT ALL {one})").fetchall()


def cut_pages():
    """Stored pages whose heading is cut inside a reference."""
    page = '<html><head><title>x</title></head><body><nav><ul><li><a href="/a">b</a></ul></nav><article><h1>{}</h1><p><b>{}<p>some words</article></body></html>'
    heads = ("one &amp; two &amp", "one &quot", "&amp;&am", "&amp;quot; &amp;&quot;&quot", "plain")
    return {"pages": ("page_id long, url string, html string", [(k, f"https://a.org/{k}", page.format(heads[k % 5], heads[k // 5])) for k in range(25)])}


@pytest.mark.parametrize("name", ["page_article_patterns", "page_headlines", "page_hybrid_fields", "page_path_articles"])
def test_headings_cut_inside_a_reference(spark, tmp_path, name):
    assert differences(spark, tmp_path, name, cut_pages()) == []


def test_a_year_to_come_is_not_recent(spark, tmp_path):
    urls = ["https://blog.a.com/fr/2015/", "http://a.net/en/2003/", "https://a.org/news/2024/05/x", "https://a.edu/1999/", "https://a.org/2000/1"]
    assert differences(spark, tmp_path, "score_comprehensive", {"pages": ("page_id long, url string", list(enumerate(urls)))}) == []


def test_urls_of_a_larger_table_score_as_in_sql(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url").collect()
    assert differences(spark, tmp_path, "score_comprehensive", {"pages": ("page_id long, url string", rows)}) == []


def test_null_urls_and_line_breaks_after_hosts_score_as_in_sql(spark, tmp_path):
    urls = [None, "http://a.org\n", "http://a.edu\n/x", "http://a.gov", "x", "", "//H.org/a"]
    assert differences(spark, tmp_path, "score_comprehensive", {"pages": ("page_id long, url string", list(enumerate(urls)))}) == []


def test_letters_that_lower_case_to_ascii_score_as_in_sql(spark, tmp_path):
    urls = ["http://a.org/serv\u0130ce/x", "http://a.org/SERVICE/x", "\u212a:about", "K:About", "http://a.org/\u212a/about"]
    assert differences(spark, tmp_path, "score_comprehensive", {"pages": ("page_id long, url string", list(enumerate(urls)))}) == []


def test_a_large_page_needs_little_memory():
    html = "<ul>" + '<li class="price">x</li>' * 100_000 + "</ul>"
    tracemalloc.start()
    n = sum(1 for _ in stream_markup(html))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 100_002 and peak < 5 * len(html)


def test_chunks_split_and_share_pages(spark):
    rows = [(1, "<b>x</b>"), (2, "<i>y</i>" * (2 * markup.CHUNK)), (3, None), (4, "<b>z")]
    nodes = markup.element_table(spark.createDataFrame(rows, "k long, html string").coalesce(1), "k")
    got = {r.k: (r.n, r.last) for r in nodes.groupBy("k").agg(F.count("*").alias("n"), F.max("last").alias("last")).collect()}
    assert got == {1: (2, 1), 2: (2 * markup.CHUNK + 1, 2 * markup.CHUNK), 3: (1, 0), 4: (2, 1)}
    assert {r.k: r.text for r in nodes.where("pre = 0 AND k <> 2").collect()} == {1: "x", 3: "", 4: "z"}


def test_elements_and_walks_are_not_broadcast_on_a_guess(spark):
    # An exploded row looks as small as its source to Spark.
    pages = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(50))).alias("i")).select(F.concat(F.lit("/"), "i").alias("url"), F.concat(F.lit("<a>"), "i").alias("html"), F.concat(F.lit("/"), F.col("i") + 1).alias("next_url"))
    nodes = markup.element_table(pages, "url")
    for df in (markup.select(nodes, "url", "//a"), markup.with_text(nodes, nodes, "url"), discovery.paginated(pages, pages.where("i = 0"), most=8)):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().sparkPlan().toString()
    assert df.count() == 8


def test_long_lists_keep_four_similar_siblings_and_count_the_rest(spark):
    rng = random.Random(3)
    sizes = [rng.choice([5, 6, 300, 310]) for _ in range(400)] + [2000] + [5] * 150 + [2100, 6, 1900] + [5] * 90
    page = "<ul>" + "".join(f'<li class="c{n > 1000}{rng.randrange(2)}">{"x" * n}</li>' for n in sizes) + "</ul>"
    nodes = markup.element_table(spark.createDataFrame([(1, page)], "k long, html string"), "k")
    items = sorted((r.pre, tuple(r.classes), r.length) for r in nodes.where("tag = 'li'").selectExpr("pre", "classes", "solid_to - solid_from AS length").collect())
    want = {}
    for i, (pre, classes, length) in enumerate(items):
        later = [p for p, c, n in items[i + 1 :] if (1 + (c == classes) + 1 - abs(n - length) / max(n, length)) / 3 > page_patterns.ALIKE]
        if later:
            want[pre] = (len(later), later[:4])
    found = page_patterns.later_similar(nodes, nodes.where("tag = 'li'"), "k").collect()
    assert {r.c_pre: (r.n, [x.pre for x in r.firsts]) for r in found} == want


def test_relations_are_dealt_by_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(page_patterns, "PAIRS", 1000)
    rows = [(1, n, "name" if n % 2 else "price", 5) for n in range(4000)]
    found = page_patterns.element_relations(spark.createDataFrame(rows, "k long, pos int, kind string, length int"), "k")
    held = sorted(r["n"] for r in found.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())
    assert sum(held) == 2000 * 1999 // 2 and found.rdd.getNumPartitions() > 1000 and len(held) >= 4


def test_only_tools_that_may_place_are_written(spark, monkeypatch):
    written = []

    def durable(df):
        kept = df.cache()
        written.append((set(df.columns), kept.count()))
        return kept

    monkeypatch.setattr(matching, "durable", durable)
    tools = spark.createDataFrame([(n, f"common word{n} " + f"word{n + 1} " * (n % 3)) for n in range(60)], "tool int, text string")
    asks = spark.createDataFrame([(n, f"common word{n} word{n + 1}") for n in range(20)], "request int, text string")
    rows = matching.text_matches(asks, "request", tools, "tool", 2).collect()
    assert len(rows) == 40 and {r.touched for r in rows} != {2}
    able = [n for columns, n in written if {"request", "tool"} <= columns]
    assert len(able) == 1 and able[0] < sum({r.request: r.touched for r in rows}.values())


def test_reader_forgets_ended_elements():
    elements = stream_markup("<i>x</i>" * 3)
    assert [next(elements)[0] for _ in range(3)] == [1, 2, 3] and next(elements)[-2:] == ["xxx", "xxx"]


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_block_pairs_need_one_python_worker(spark, tmp_path, broadcast):
    rng = random.Random(3)
    rows = [(n, [rng.gauss(0, 1) for _ in range(4)], n % 3) for n in range(400)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5).write.parquet(f"{tmp_path}/v")
    frame = spark.read.parquet(f"{tmp_path}/v")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        found = similarity.nearest(frame, frame.where("vec_id % 100 = 0"), 5, group="label")
        plan = found._jdf.queryExecution().sparkPlan().toString()
        rows = found.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("MapInArrow") == 1 and ("CartesianProduct" in plan) == (broadcast == "-1")
    assert len(rows) == 20 and {r["query"] for r in rows if r["query"] == r["vec_id"]} == {0, 100, 200, 300}


def test_best_of_equally_consistent_lists_is_the_one_of_the_sql(spark, tmp_path):
    # Lengths of labels: the first and second (or third) item have groups of equal mean similarity.
    lists = [
        (2, 2, 6, 3, 2, 2), (5, 6, 7, 4, 3, 5), (2, 4, 8, 7, 2, 2), (6, 7, 9, 2, 2, 6), (3, 3, 7, 2, 6, 3), (2, 3, 2, 5, 6, 2), (2, 9, 10, 6, 7, 2),
        (3, 4, 7, 6, 2, 3), (6, 3, 2, 6, 9, 3), (2, 4, 9, 5, 4, 2), (7, 6, 3, 2, 4, 7), (3, 6, 6, 6, 2, 3), (4, 6, 8, 3, 6), (2, 7, 7, 11, 4, 2),
    ]
    page = "<html><head><meta><title>x</title><style></style><script></script></head><body><nav><ul>{}</ul></nav></body></html>"
    rows = [(k, page.format("".join(f'<li><a href="/{"x" * n}">{"x" * n}</a></li>' for n in x))) for k, x in enumerate(lists)]
    assert differences(spark, tmp_path, "page_repeating_structures", {"pages": ("page_id long, html string", rows)}) == []
