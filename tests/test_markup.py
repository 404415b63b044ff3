"""The element table, paths on it, and patterns of layout, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from loomery.functions.markup import FIELDS, read_markup
from loomery.operators import hybrid, markup, page_fields, page_patterns, paragraphs

CLASSES = ("card", "price", "name now", "", "x y")


def random_page(rng, n=60):
    out, opened = [], []
    for k in range(n):
        roll = rng.random()
        if roll < 0.5 or not opened:
            tag = rng.choice(("div", "ul", "li", "p", "b", "article", "section", "span"))
            cls, ident = rng.choice(CLASSES), rng.random() < 0.1
            out.append(f"<{tag}" + (f" class='{cls}'" if cls else "") + (f' id="i{k}"' if ident else "") + ">")
            opened.append(tag)
        elif roll < 0.75:
            out.append(rng.choice(("word ", " two words", "&amp;", "  ", "<!-- <b class='price'>1</b> -->", "<br>", "<img src=a>")))
        else:
            out.append(f"</{opened.pop(rng.randrange(len(opened)) if rng.random() < 0.1 else -1)}>")
    return "".join(out)


def tree(html):
    nodes, text, solid = read_markup(html)
    return [dict(zip(FIELDS, x, strict=True)) for x in nodes], text, solid


PAGES = [random_page(random.Random(seed)) for seed in range(25)]


@pytest.fixture(scope="module")
def nodes(spark):
    pages = spark.createDataFrame([*enumerate(PAGES), (100, None), (101, "")], "k long, html string")
    return markup.element_table(pages, "k").cache()


def test_intervals_nest():
    for html in PAGES:
        found, text, _ = tree(html)
        for x in found[1:]:
            up = found[x["parent"]]
            assert up["pre"] < x["pre"] <= x["last"] <= up["last"] and x["depth"] == up["depth"] + 1
            assert up["text_from"] <= x["text_from"] <= x["text_to"] <= up["text_to"]
            assert up["source_from"] <= x["source_from"] <= x["source_to"] <= up["source_to"]
            assert html[x["source_from"] :].lower().startswith("<" + x["tag"])


def test_unclosed_and_hidden_markup():
    html = '<div class="address"><p>Main St<p>12 <b>Two</div><!-- <b class="phone">1</b> --><ul><li>a<li>b<ul><li>c</ul><li>d</ul><script>x="</p><i>"</script><table><tr><td>1<td>2<tr><td>3</table><title>a &amp; <b></title><i a=1 A=2 c>&lt;</i></p>t'
    found, text, solid = tree(html)
    assert [(x["tag"], x["depth"]) for x in found] == [
        ("#page", 0), ("div", 1), ("p", 2), ("p", 2), ("b", 3), ("ul", 1), ("li", 2), ("li", 2), ("ul", 3), ("li", 4), ("li", 2), ("script", 1),
        ("table", 1), ("tr", 2), ("td", 3), ("td", 3), ("tr", 2), ("td", 3), ("title", 1), ("i", 1),
    ]
    assert text == "Main St12 Twoabcd123a & <b><t" and solid == "Main St12Twoabcd123a & <b><t"
    assert found[-1]["attributes"] == [("a", "1"), ("c", "")]
    assert read_markup("")[0] == [[0, 0, 0, None, "#page", 1, 1, [], 0, 0, 0, 0, 0, 0]]
    assert len(read_markup("<a" * 50_000 + "'")[0]) <= 2 and len(read_markup("<b>" * 5000)[0]) == 5001


def walk(found, steps, at):
    here = [at]
    for s in steps:
        nxt = set()
        for c in (found[h] for h in here):
            axis = {
                "child": [x for x in found if x["parent"] == c["pre"]],
                "descendant": [x for x in found if c["pre"] < x["pre"] <= c["last"]],
                "parent": [] if c["parent"] is None else [found[c["parent"]]],
                "ancestor": [x for x in found if x["pre"] < c["pre"] <= x["last"]],
                "following": [x for x in found if x["parent"] == c["parent"] and x["pos"] > c["pos"]],
            }[s.axis]
            for x in axis:
                a = dict(x["attributes"])
                if x["tag"] == "#page" or (s.tag != "*" and x["tag"] != s.tag):
                    continue
                if any(n not in a or not {"=": v is None or a[n] == v, "contains": v is not None and v in a[n], "starts-with": v is not None and a[n].startswith(v)}[k] for k, n, v in s.tests):
                    continue
                same = [y for y in found if y["parent"] == x["parent"] and y["tag"] != "#page" and (s.tag == "*" or y["tag"] == s.tag)]
                if s.place is not None and (same[-1:] if s.place == 0 else same[s.place - 1 : s.place]) != [x]:
                    continue
                nxt.add(x["pre"])
        here = sorted(nxt)
    return set(here)


WAYS = ("//div", "//li/b", "//ul//li", "/*", "//*[@class]", "//div[@class='card']//span", "//p[contains(@class, 'now')]", "//b[2]", "//li[last()]", "//*[1]/..", "//span/following-sibling::b", "//b/ancestor::div", "//*[@id]/parent::ul", "//div[starts-with(@class, \"x\")]")


@pytest.mark.parametrize("way", WAYS)
def test_paths_equal_a_walk(nodes, way):
    got = {(r.k, r.pre) for r in markup.select(nodes, "k", way).collect()}
    want = set()
    for k, html in enumerate(PAGES):
        found = tree(html)[0]
        want |= {(k, p) for p in walk(found, markup.path(way), 0)}
    assert got == want


def test_paths_from_elements_and_wide_pages(spark, nodes, monkeypatch):
    monkeypatch.setattr(markup, "BLOCK", 7)
    origins = nodes.where("tag = 'div'")
    got = {(r.k, r.origin, r.pre) for r in markup.select(nodes, "k", ".//li", origins).collect()}
    want = set()
    for k, html in enumerate(PAGES):
        found = tree(html)[0]
        want |= {(k, d["pre"], x["pre"]) for d in found if d["tag"] == "div" for x in found if x["tag"] == "li" and d["pre"] < x["pre"] <= d["last"]}
    assert got == want


@pytest.mark.parametrize("bad", ["//a[", "//a[@b='c'][2]", "a//following-sibling::b", "//a[position()<2]", "///a"])
def test_unknown_paths_are_refused(bad):
    with pytest.raises(ValueError):
        markup.path(bad)


def test_extraction_by_paths(spark):
    html = '<div class="shop"><div class="p"><h3><i>Big</i> lamp of glass</h3><b class="price"><i>$</i>5</b><a href="/1">x</a></div><!-- <div class="p"><h3>No</h3></div> --><div class="p"><h3>Pen<div class="p"></div></div>'
    rows = spark.createDataFrame([(1, html), (2, "<h3>Alone</h3>"), (3, None), (4, '<div class="p"></div>')], "k long, html string")
    fields = [markup.PathField("name", ".//h3"), markup.PathField("price", ".//b[contains(@class, 'price')]"), markup.PathField("link", "a", "attribute", "href"), markup.PathField("raw", ".//b", "html")]
    got = markup.extract_by_paths(rows, "k", "//div[@class='p']", fields).orderBy("k", "item").collect()
    assert [tuple(r)[:6] for r in got] == [(1, 0, "Big lamp of glass", "$5", "/1", '<b class="price"><i>$</i>5</b>'), (1, 1, "Pen", None, None, None), (2, 0, "Alone", None, None, None)]
    assert [round(r.confidence, 6) for r in got] == [0.5, 0.5, 0.45]
    ready = {r.k: round(r.confidence, 6) for r in markup.path_readiness(rows, "k", "//div[@class='p']", fields).collect()}
    assert ready == {1: 1.0, 2: 0.2, 3: 0.2, 4: 0.4}


def test_selectors_and_absolute_paths(spark):
    html = '<html><body><ul><li>a<li class="x y">b</ul><p id="z">c</p></body></html>'
    nodes = markup.element_table(spark.createDataFrame([(1, html)], "k long, html string"), "k")
    got = {r.pre: r.path for r in markup.absolute_paths(nodes, nodes, "k").collect()}
    assert got == {1: "/html", 2: "/html/body", 3: "/html/body/ul", 4: "/html/body/ul/li[1]", 5: "/html/body/ul/li[2]", 6: "/html/body/p"}
    css = {r.pre: r.css for r in nodes.select("pre", markup.css_selector().alias("css")).collect()}
    assert css[5] == "li.x.y" and css[6] == "p#z" and css[3] == "ul"


def test_texts_of_classes_are_whole(spark):
    html = '<div class="address box"><p>Main St</p> 5</div><b class="price"><i>$</i>5</b><!-- <b class="phone">123</b> --><script>"<b class=\'phone\'>9</b>"</script>'
    nodes = markup.element_table(spark.createDataFrame([(1, html)], "k long, html string"), "k")
    got = markup.class_texts(nodes, "k", {"address": ["address"], "price": ["price"], "phone": ["phone"]}).orderBy("pre").collect()
    assert [(r.field, r.text) for r in got] == [("address", "Main St 5"), ("price", "$5")]


def shape_of(x, found):
    cls = set((dict(x["attributes"]).get("class") or "").split())
    return x["tag"], cls, x["last"] - x["pre"], x["solid_to"] - x["solid_from"]


def similarity(a, b):
    if a[0] != b[0]:
        return 0.0
    parts = [1.0]
    if a[1] | b[1]:
        parts.append(len(a[1] & b[1]) / len(a[1] | b[1]))
    parts += [1 - abs(a[k] - b[k]) / max(a[k], b[k]) for k in (2, 3) if max(a[k], b[k])]
    return sum(parts) / len(parts)


def consistency(shapes):
    five = shapes[:5]
    pairs = [similarity(five[i], five[j]) for i in range(len(five)) for j in range(i + 1, len(five))]
    return sum(pairs) / len(pairs) if pairs else 1.0


def css(x):
    a = dict(x["attributes"])
    return f"{x['tag']}#{a['id']}" if a.get("id") else x["tag"] + "".join("." + c for c in (a.get("class") or "").split())


def later_siblings(x, found):
    return [y for y in found if y["parent"] == x["parent"] and y["pos"] > x["pos"]] if x["pre"] else []


LISTS = [
    "<ul>" + "".join(f"<li class='{random.Random(s * 50 + k).choice(('card', 'card', 'item', 'ad x'))}'><h3 class='title'>{'n' * (k % 7)}</h3>" + ("<p><b class='price'>$1</b></p>" if (k + s) % 3 else "<img>") + "</li>" for k in range(4 + 3 * s)) + "</ul>"
    + "<div data-product=1><div class='card'>z<b class='cost'>2</b></div><li class='card'><h3 class='name'>q</h3><p><b class='price'>3</b></p></li></div>"
    for s in range(8)
]


@pytest.fixture(scope="module")
def lists(spark):
    pages = spark.createDataFrame(list(enumerate(PAGES + LISTS)), "k long, html string")
    return markup.element_table(pages, "k").cache()


def test_repeating_structures_equal_brute_force(lists):
    want = {}
    for k, html in enumerate(PAGES + LISTS):
        found = tree(html)[0]
        best = {}
        for x in found[1:]:
            later = later_siblings(x, found)
            if x["tag"] not in page_patterns.CONTAINERS or len(later) < 3:
                continue
            group = [x] + [y for y in later if similarity(shape_of(x, found), shape_of(y, found)) > 0.7]
            if len(group) < 3:
                continue
            c = consistency([shape_of(y, found) for y in group])
            row = (min(1.0, 0.5 + c * 0.3 + min(len(group) / 10, 0.2)), x["pre"], len(group), c)
            if css(x) not in best or round(row[0], 9) > round(best[css(x)][0], 9):
                best[css(x)] = row
        want |= {(k, s): r for s, r in best.items()}
    got = {(r.k, r.selector): (r.confidence, r.pre, r.repeats, r.consistency) for r in page_patterns.repeating_structures(lists, "k").collect()}
    assert got.keys() == want.keys() and len(want) > 10
    for key, row in got.items():
        assert row == pytest.approx(want[key], abs=1e-9), key


def has(x, pattern):
    import re

    return any(re.search(pattern, c) for c in (dict(x["attributes"]).get("class") or "").split())


def inside(x, found):
    return found[x["pre"] + 1 : x["last"] + 1]


def test_price_containers_equal_a_climb(lists):
    want = set()
    for k, html in enumerate(PAGES + LISTS):
        found = tree(html)[0]
        for x in found:
            if x["pre"] and has(x, page_patterns.PRICED):
                at = found[x["parent"]]
                while at["pre"]:
                    if sum(any(has(z, page_patterns.PRICED) for z in inside(y, found)) for y in later_siblings(at, found)[:10]) >= 2:
                        want.add((k, x["pre"], at["pre"]))
                        break
                    at = found[at["parent"]]
    got = {(r.k, r.price, r.container) for r in page_patterns.price_containers(lists, "k").collect()}
    assert got == want and len(want) > 10


def test_product_patterns_equal_brute_force(lists):
    want = {}
    climbed = {(r.k, r.container) for r in page_patterns.price_containers(lists, "k").collect()}
    for k, html in enumerate(PAGES + LISTS):
        found = tree(html)[0]
        best = {}
        for x in found[1:]:
            cls = (dict(x["attributes"]).get("class") or "").split()
            if not (set(cls) & set(page_patterns.CARDS) or "data-product" in dict(x["attributes"]) or (k, x["pre"]) in climbed):
                continue
            own = shape_of(x, found)
            group = [x] + [y for y in later_siblings(x, found) if similarity(own, shape_of(y, found)) > 0.7]
            if cls:
                for y in found:
                    if cls[0] in (dict(y["attributes"]).get("class") or "").split() and y["pre"] not in [z["pre"] for z in group] and similarity(own, shape_of(y, found)) > 0.7:
                        group.append(y)
                        if len(group) >= 10:
                            break
            if len(group) < 3:
                continue
            n = [sum(any(has(z, p) for z in inside(y, found)) for y in group[:5]) for p in (page_patterns.PRICED, page_patterns.NAMED)]
            images = sum(any(z["tag"] == "img" for z in inside(y, found)) for y in group[:5])
            if not sum(n):
                continue
            row = (min(1.0, 0.6 + 0.1 * sum(n)), x["pre"], len(group), *n, images, consistency([shape_of(y, found) for y in group]))
            if css(x) not in best or round(row[0], 9) > round(best[css(x)][0], 9):
                best[css(x)] = row
        want |= {(k, s): r for s, r in best.items()}
    got = {(r.k, r.selector): (r.confidence, r.pre, r.repeats, r.prices, r.names, r.images, r.consistency) for r in page_patterns.product_patterns(lists, "k").collect()}
    assert got.keys() == want.keys() and len(want) > 5
    for key, row in got.items():
        assert row == pytest.approx(want[key], abs=1e-9), key


def test_article_contact_and_pricing(spark):
    article = '<div class="post"><p>x</p></div><article><h1>T</h1><span class="byline">B</span><div class="entry-content">c</div></article>'
    contact = '<a href="mailto:a@b.c">m</a><div class="info"><p><a href="mailto:a@b.c">m</a><a href="tel:1">t</a></p><i class="address">A</i></div>'
    pricing = '<div class="plan"><h2 class="title">Pro</h2><b class="amount">5</b></div><div class="plan x"><ul class="features"><li>a</ul></div><div class="tier"></div>'
    nodes = markup.element_table(spark.createDataFrame([(1, article), (2, contact), (3, pricing), (4, "")], "k long, html string"), "k")
    (a,) = page_patterns.article_pattern(nodes, "k").collect()
    assert (a.k, a.selector, a.title is not None, a.author is not None, a.date, a.confidence) == (1, "article", True, True, None, 0.9)
    (c,) = page_patterns.contact_pattern(nodes, "k").collect()
    assert (c.k, c.selector, c.emails, c.phones, c.confidence, c.score) == (2, "div.info", 1, 1, 0.9, 2.7)
    p = {r.selector: (r.k, r.confidence) for r in page_patterns.pricing_patterns(nodes, "k").collect()}
    assert p == {"div.plan": (3, 0.8), "div.plan.x": (3, 0.6)}


def test_relations_equal_all_pairs(spark):
    rng = random.Random(2)
    rows = [(k, n, rng.choice(("text", "name", "price", "image")), rng.randrange(400)) for k in range(3) for n in range(60)]
    got = {tuple(r) for r in page_patterns.element_relations(spark.createDataFrame(rows, "k long, pos int, kind string, length int"), "k", 0.5).collect()}
    want = set()
    for k, n, kind, length in rows:
        for j, m, other, size in rows:
            if j != k or m <= n:
                continue
            if kind in ("text", "name") and other == "price":
                want.add((k, n, m, "product_to_price", 0.8))
            elif kind == "text" and other == "name" and abs(length - size) < 100:
                want.add((k, n, m, "article_to_author", 0.7))
            elif kind == "image" and other == "text":
                want.add((k, n, m, "image_to_description", 0.6))
    assert got == want


def test_consensus(spark):
    rows = [("g", 0, "div", "text", ["a", "b"]), ("g", 1, "div", "price", ["a"]), ("g", 2, "p", "text", ["a", "b"]), ("h", 0, "li", "text", [])]
    frame = spark.createDataFrame(rows, "g string, pos int, tag string, kind string, classes array<string>")
    got = {r.g: r for r in page_patterns.element_consensus(frame, ["g"]).collect()}
    assert (got["g"].common_classes, got["g"].tags, got["g"].kinds) == (["a", "b"], ["div", "p"], ["text", "price"])
    assert got["g"].selectors == [".a", ".b", "div", "p", "div.a"] and got["g"].consistency == pytest.approx((2 / 3 + 0.5) / 2)
    assert got["h"].consistency == 1.0 and got["h"].confidence == pytest.approx(0.9) and got["h"].common_classes == []


def test_contacts_cards_and_rdfa_read_whole_elements(spark):
    html = (
        '<div class="address"><p>Main <b>St</b> 5</p></div><!-- <b class="phone">123-456-7890</b> --><b class="phone"><i>+49</i> 30</b><a href="mailto:a@b.org?s=1">m</a>'
        '<ul><li class="card"><h3 class="name">Big <i>lamp</i></h3><b class="price"><i>$</i>5</b><a href="">e</a><a href="/1">x</a><li class="card"><time datetime="2024"></time></ul>'
        '<div typeof="http://s.org/Person"><p property="name">Ada <b>L</b></p><div typeof="Place"><i property="city" content="Rome">no</i></div></div><form id="contact-us"></form>'
    )
    rows = spark.createDataFrame([(1, html), (2, None)], "k long, html string")
    got = {r.k: r for r in page_fields.contacts(rows, "k").collect()}
    assert (got[1].emails, got[1].phones, got[1].addresses, got[1].contact_forms) == (["a@b.org"], ["+49 30"], ["Main St 5"], 1)
    assert (got[2].emails, got[2].phones, got[2].contact_forms) == ([], [], 0)
    cards = page_fields.cards(rows, "k", ["card"], {"name": ["name"], "price": ["price"]}).orderBy("pos").collect()
    assert [(r.pos, r.link, r.shown_at, r["name"], r.price) for r in cards] == [(0, "/1", None, "Big lamp", "$5"), (1, None, "2024", None, None)]
    facts = {(r.pos, r.type, r.property, r.value) for r in page_fields.rdfa(rows, "k").collect()}
    assert facts == {(0, "Person", "name", "AdaL"), (0, "Person", "city", "Rome"), (1, "Place", "city", "Rome")}
    assert [tuple(r) for r in page_fields.headline_contacts(rows, "k").where("k = 1").collect()] == [(1, None, None, "a@b.org?s=1")]


def test_paragraphs_keep_inline_elements(spark):
    html = "<p>one two <b>three</b> four five six <i>seven</i> eight nine ten eleven</p><!-- <p>a b c d e f g h i j k l</p> --><p>short</p>"
    (row,) = paragraphs.clusters(spark.createDataFrame([(1, html)], "k long, html string"), "k").collect()
    assert row.text == "one two three four five six seven eight nine ten eleven"


def test_hybrid_fields_fall_back_by_source(spark):
    ld = '<script type="application/ld+json">{"@type": "Product", "name": "L", "price": 5, "brand": " "}</script>'
    micro = '<div itemscope itemtype="http://schema.org/Product"><b itemprop="name">M</b><meta itemprop="sku" content="s1"></div>'
    rows = [(1, ld + micro + '<h1>H</h1><b class="brand">B <i>c</i></b>'), (2, micro + '<b class="price"></b><b class="cost"><i>$</i>7</b>'), (3, '<script type="application/ld+json">{"@type": "Article", "name": "A"}</script><h1>H</h1>'), (4, None)]
    got = {(r.k, r.field): (r.value, r.source) for r in hybrid.hybrid_fields(spark.createDataFrame(rows, "k long, html string"), "k", "Product").collect()}
    assert got == {
        (1, "name"): ("L", "json_ld"), (1, "price"): ("5", "json_ld"), (1, "brand"): ("B c", "elements"), (1, "sku"): ("s1", "microdata"),
        (2, "name"): ("M", "microdata"), (2, "sku"): ("s1", "microdata"), (2, "price"): ("$7", "elements"), (3, "name"): ("H", "elements"),
    }
