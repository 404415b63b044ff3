"""Text matches, vector lookup, pagination and best-first discovery, against plain Python."""

import heapq
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomery.operators import discovery, matching, vector_index


@pytest.mark.parametrize(("k", "least"), [(1, 0.1), (3, 0.1), (5, 0.4)])
def test_text_matches_equal_all_pairs(spark, k, least):
    rng = random.Random(k)
    words = [f"w{i}" for i in range(40)]
    draw = lambda n: " ".join(words[min(39, int(rng.expovariate(0.12)))] for _ in range(n))
    tools = [(f"t{i:02}", draw(rng.randrange(1, 12))) for i in range(30)] + [("empty", ""), ("null", None), ("twin", "w1 w2 w3"), ("twin2", "w1 w2 w3")]
    asked = [(i, draw(rng.randrange(0, 15)).upper()) for i in range(60)] + [(100, None), (101, "nothing known"), (102, "w1 w2 w3")]
    split = lambda t: [w for w in re.split(r"\W+", (t or "").lower()) if len(w) > 1]
    df = Counter(w for _, t in tools for w in set(split(t)))
    idf = {w: math.log((1 + len(tools)) / (1 + n)) + 1 for w, n in df.items()}

    def vector(text):
        raw = {w: n * idf[w] for w, n in Counter(split(text)).items() if w in idf}
        size = math.sqrt(sum(x * x for x in raw.values())) or 1
        return {w: x / size for w, x in raw.items()}

    held = {t: vector(x) for t, x in tools}
    want = {}
    for i, text in asked:
        v = vector(text)
        scored = sorted(((-round(sum(x * h.get(w, 0) for w, x in v.items()), 12), t) for t, h in held.items()))
        want[i] = [(t, -s) for s, t in scored if -s > least][:k]
    rows = matching.text_matches(spark.createDataFrame(asked, "r long, text string"), "r", spark.createDataFrame(tools, "tool string, text string"), "tool", k, least).collect()
    got = {i: [(r.tool, r.score) for r in sorted((r for r in rows if r.r == i), key=lambda r: r.place)] for i, _ in asked}
    for i in want:
        assert [t for t, _ in got[i]] == [t for t, _ in want[i]], i
        assert [s for _, s in got[i]] == pytest.approx([s for _, s in want[i]])
    pairs = sum(bool(set(vector(t)) & set(h)) for _, t in asked for h in held.values())
    touched = sum({r.r: r.touched for r in rows}.values())
    assert touched <= pairs if least < 0.4 else touched < pairs


def vectors(spark, n=600, size=12, seed=3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(8)]
    rows = [(i, [c + rng.gauss(0, 0.4) for c in centres[i % 8]], i % 3, rng.random(), [f"s{i % 5}", f"s{i % 7}"]) for i in range(n)]
    rows += [(n, [0.0] * size, 0, 0.9, []), (n + 1, None, 0, 0.9, None)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, site int, rate double, selectors array<string>")


def exact(rows, query, k, test):
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    q = unit(query[1])
    scored = [(-round(sum(a * b for a, b in zip(q, unit(r[1]), strict=True)), 12), r[0]) for r in rows if r[1] and any(r[1]) and test(r)]
    return [i for _, i in sorted(scored)[:k]]


def test_vector_lookup(spark):
    rows, frame = vectors(spark)
    index = vector_index.build_index(frame, cells=8)
    assert index.rows.count() == 600
    queries = frame.where("vec_id % 20 = 0 AND vec_id < 600")
    for where, test in ((None, lambda r: True), (F.col("rate") >= 0.7, lambda r: r[3] >= 0.7)):
        hits = total = 0
        for mode in (True, False):
            found = vector_index.search(index, queries, 5, where, ["site"], probes=2, exact=mode).collect()
            for q in [r for r in rows[:600] if r[0] % 20 == 0]:
                want = exact(rows, q, 5, lambda r, q=q: test(r) and r[2] == q[2])
                got = [r.vec_id for r in sorted((r for r in found if r.query == q[0]), key=lambda r: r.place)]
                if mode:
                    assert got == want
                else:
                    hits, total = hits + len(set(got) & set(want)), total + len(want)
        assert hits / total >= 0.9
    # Few rows pass: the other cells are looked into, and the answer is exact.
    rare = vector_index.search(index, queries, 5, F.col("rate") >= 0.995, probes=1).collect()
    for q in [r for r in rows[:600] if r[0] % 20 == 0]:
        want = exact(rows, q, 5, lambda r: r[3] >= 0.995)
        got = [r.vec_id for r in sorted((r for r in rare if r.query == q[0]), key=lambda r: r.place)]
        if len(want) < 5:
            assert got == want
    chosen = {r.query: r.selectors for r in vector_index.learned_selectors(vector_index.search(index, queries, 2, exact=True), index, "selectors", 3).collect()}
    for q in [r for r in rows[:600] if r[0] % 20 == 0]:
        want = list(dict.fromkeys(s for i in exact(rows, q, 2, lambda r: True) for s in rows[i][4]))[:3]
        assert chosen[q[0]] == want


def test_similar_patterns(spark):
    patterns = spark.createDataFrame([("a", 0.9, 0.5, 9, 1), ("b", 0.9, 0.6, 9, 1), ("c", 1.0, 0.1, 2, 1), ("d", 1.0, 0.1, 9, 99)], "p string, success_rate double, avg_confidence double, sample_count int, age_days int")
    near = spark.createDataFrame([(1, "a", 0.8), (1, "d", 0.71), (1, "b", 0.7)], "query int, p string, similarity double")
    alike = spark.createDataFrame([(1, "a", 0.7), (1, "b", 0.61), (1, "c", 0.9), (1, "d", 0.9)], "query int, p string, similarity double")
    got = [(r.p, r.by) for r in vector_index.similar_patterns(near, alike, patterns, "p").orderBy("place").collect()]
    assert got == [("d", "vector"), ("b", "features"), ("a", "vector"), ("a", "features")]


@pytest.mark.parametrize("most", [1, 2, 5, 8, 40])
def test_pagination_equals_a_walk(spark, most):
    rng = random.Random(most)
    chains = {f"c{i}": f"c{i + 1}" for i in range(30)} | {"c30": None, "x0": "x1", "x1": "x2", "x2": "x0", "lost": "nowhere", "self": "self"}
    chains |= {f"r{i}": rng.choice(["c3", "x1", "lost", None, "r0"]) for i in range(10)}
    starts = ["c0", "c20", "x0", "x1", "lost", "self", "absent", *(f"r{i}" for i in range(10))]
    want = {}
    for start in starts:
        seen, at, stop = [], start, None
        if start not in chains:
            continue
        while True:
            seen.append(at)
            nxt = chains[at]
            stop = "no_next" if nxt is None else "missing" if nxt not in chains else "cycle" if nxt in seen else "max_pages"
            if stop != "max_pages" or len(seen) == most:
                break
            at = nxt
        want |= {(start, n): (u, stop if n == len(seen) - 1 else None) for n, u in enumerate(seen)}
    pages = spark.createDataFrame(list(chains.items()), "url string, next_url string")
    got = discovery.paginated(pages, spark.createDataFrame([(s,) for s in starts], "url string"), most=most).collect()
    assert {(r.start, r.page_no): (r.url, r.stop) for r in got} == want


def heap_walk(links, scores, starts, most, max_depth, batch, kinds, trend=2.0):
    content = {u: c for u, _, c in scores}
    value = {u: s for u, s, _ in scores}
    queue = [(-value[u], u, 0, None) for u in starts]
    heapq.heapify(queue)
    seen, out, found, recent = set(starts), [], set(), []
    while queue and len(out) < most:
        chosen = [heapq.heappop(queue) for _ in range(min(batch, most - len(out), len(queue)))]
        for s, u, d, p in chosen:
            out.append((u, d, p, -s))
            recent.append(content[u])
            found |= {k for k, words in kinds.items() if any(w in u for w in words)}
        boosts = [1.15] * (sum(recent[-5:]) / len(recent[-5:]) / 1000 > trend) + [1.1] * (len(found) < 3)
        for s, u, d, _ in chosen:
            for v in sorted(set(links.get(u, ()))) if d < max_depth else ():
                if v in value and v not in seen:
                    raised = value[v] * (1.2 if -s > 0.8 else 1.1 if -s > 0.6 else 1.0)
                    for b in boosts:
                        raised *= b
                    heapq.heappush(queue, (-min(raised, 1.0), v, d + 1, u))
                    seen.add(v)
        queue = heapq.nsmallest(most, queue)
        heapq.heapify(queue)
    return out


@pytest.mark.parametrize("batch", [1, 7])
def test_best_first_equals_a_heap(spark, batch):
    rng = random.Random(4)
    urls = [f"/{rng.choice(('contact', 'news', 'product', 'page'))}/{i}" for i in range(70)]
    scores = [(u, round(rng.random(), 3), rng.randrange(0, 5000)) for u in urls]
    links = {u: [rng.choice(urls) for _ in range(3)] + ["/unknown"] for u in urls}
    kinds = {"contact": ["contact"], "product": ["product"], "news": ["news"]}
    want = heap_walk(links, scores, urls[:2], 12 if batch == 1 else 25, 3, batch, kinds)
    edges = spark.createDataFrame([(a, b) for a, bs in links.items() for b in bs], "src string, dst string")
    walk = discovery.best_first(edges, spark.createDataFrame(scores, "url string, score double, content int"), spark.createDataFrame([(u,) for u in urls[:2]], "url string"), 12 if batch == 1 else 25, 3, batch, kinds)
    got = [(r.url, r.depth, r.parent, r.score) for r in walk.orderBy("visit").collect()]
    assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want])
    assert [r.place for r in discovery.goal_pages(walk, "news_content").orderBy("place").collect()] == list(range(sum("/news" in w[0] or w[1] == 0 for w in want)))
