"""License scans, importance resampling and the filter audit, against brute force, and their edges."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from loomery.llm import filter_audit, importance_resampling, license_scans
from loomery.llm.license_scans import Template

TEMPLATES = (
    Template("p", "b a b", threshold=1.0, phrase=True),
    Template("q", "c d", threshold=1.0, phrase=True),
    Template("x", "a c e f g", "a c"),
    Template("y", "d e f g h i j k l m n o p q r s t", threshold=0.5),
    Template("z", "k l m n o", threshold=0.6),
)


def brute_licenses(text):
    words = license_scans.split_words(text or "")
    places, labels, base, score = [], set(), set(), 0.0
    for t in TEMPLATES:
        if t.phrase:
            found = [s for s in range(len(words)) if words[s : s + len(t.words)] == t.words]
            places += found
            if found:
                base.add(t.label)
                score = 1.0
            continue
        for b in range(0, len(words), t.size):
            block = words[b : b + 2 * t.size]
            share = len(set(block) & set(t.words)) / len(set(t.words))
            if share >= t.threshold - 1e-9 and f" {t.needs} ".replace("  ", " ") in f" {' '.join(block)} ":
                labels.add(t.label)
                score = max(score, share)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels | base)), score)


@pytest.mark.parametrize("seed", [1, 2])
def test_licenses_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [rng.choice([" ", "-", "\n"]).join(rng.choice(letters) for _ in range(rng.choice((0, 1, 5, 20, 31, 32, 33, 90, 300)))).upper() for _ in range(150)]
    texts += [None, "", "É c", texts[0], texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in license_scans.scan_licenses(docs, TEMPLATES).collect()}
    for i, text in enumerate(texts):
        want = brute_licenses(text)
        assert got[i][:-1] == want[:-1] and abs(got[i][-1] - want[-1]) < 1e-12, (i, text)


def test_license_notices(spark):
    filler = "nothing of interest stands here at all " * 30
    cases = {
        "Released under the MIT License.": ("mit", "mit"),
        "Licensed under the Apache License, Version 2.0.": ("apache-2", "apache-2"),
        "Licensed under CC BY-NC 4.0.": ("cc-by-nc", "cc-by-nc"),
        "This work is licensed under the GNU General Public License, version 3.": ("", "gpl-3"),
        "This work is licensed under the GNU General Public License, version 2.": ("", "gpl-2"),
        license_scans.NOTICES[6].text.replace("can redistribute", "may redistribute"): ("", "gpl-3"),
        "You need no license, and no version of this text is public or free software under any terms.": ("", ""),
    }
    docs = spark.createDataFrame([(i, filler + t + filler) for i, t in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: (r.base_labels, r.labels) for r in license_scans.scan_licenses(docs).collect()}
    assert got == dict(enumerate(cases.values()))


def test_license_edges(spark):
    schema = "doc_id long, text string, row int, words string, Score string, `a.b` int, n_base int"
    long = "under the mit license " * 20_000
    rows = [(None, long, 1, "w", "s", 2, 3), (1, None, 1, None, None, None, None), (1, "x", 5, "v", None, 4, None), (1, "x", 5, "v", None, 4, None)]
    got = license_scans.scan_licenses(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 4 and [r for r in got if r.doc_id is None][0].n_base == 20_000
    assert {r["a.b"] for r in got} == {2, 4, None} and {r.words for r in got} == {"w", "v", None}
    assert [r.n_words for r in got if r.doc_id == 1] == [0, 1, 1]
    assert license_scans.scan_licenses(spark.createDataFrame([], schema)).count() == 0


def brute_features(text, depth):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or "")) if w]
    return words, [crc32(" ".join(words[i : i + n]).encode()) % 50 for n in range(1, depth + 1) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("depth", [1, 2, 3, 5])
def test_runs_of_the_suffix_array_equal_brute_force(depth):
    rng = random.Random(depth)
    texts = [" ".join(rng.choice("aabcÉ") for _ in range(rng.choice((0, 1, 2, 9, 40)))) for _ in range(40)] + [None, ""]
    bounds, found = importance_resampling.feature_runs(pa.array(texts), depth, 50)
    placed = [[] for _ in texts]
    for hashed, runs, at in found:
        for run, p in zip(runs, at, strict=True):
            placed[int(np.searchsorted(bounds, p, side="right")) - 1].append(int(hashed[run]))
    for text, got in zip(texts, placed, strict=True):
        assert Counter(got) == Counter(brute_features(text, depth)[1])
    # One hash for each different n-gram.
    words = [brute_features(t, 1)[0] for t in texts]
    for n, (hashed, _, _) in enumerate(found, 1):
        assert len(hashed) == len({tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1)})


def test_suffix_order_and_prefixes():
    rng = random.Random(5)
    ids = np.array([rng.randrange(1, 4) for _ in range(200)])
    order = importance_resampling.suffix_order(ids, 4)
    key = lambda p: tuple(ids[p : p + 4])
    assert [key(p) for p in order] == sorted(key(p) for p in range(200))
    prefixes = importance_resampling.common_prefixes(ids, order, 4)
    for k in range(1, 200):
        a, b = key(order[k - 1]), key(order[k])
        if len(a) == len(b) == 4:
            assert prefixes[k] == next((n for n in range(4) if a[n] != b[n]), 4)


def test_resampling_equals_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.choice((0, 5, 19, 20, 21, 80)))) for _ in range(120)] + [None, ""]
    texts += [texts[3]] * 3
    target = [" ".join(rng.choices(words[:20], k=30)) for _ in range(10)] + [None]
    ids = [*range(len(texts) - 2), 7, 7]
    docs = spark.createDataFrame(list(zip(ids, texts, ["t"] * len(ids), [1] * len(ids), strict=True)), "doc_id long, text string, `x.y` string, weight int")
    got = importance_resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), depth=2, buckets=50, percent=30)
    s = Counter(b for t in texts for b in brute_features(t, 2)[1])
    t = Counter(b for x in target for b in brute_features(x, 2)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + 50) / ((s[b] + 1.0) * (t.total() + 50)))) for b in range(50)}
    want, able = [], []
    for i, text in zip(ids, texts, strict=True):
        seen = brute_features(text, 2)
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in seen[1])
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        want.append((i, len(seen[1]), weight, score))
        if len(seen[0]) >= 20:
            able.append((-score, i))
    rows = got.collect()
    assert got.columns == ["doc_id", "x.y", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted((r.doc_id, r.n_features, r.weight, r.score) for r in rows) == sorted(want)
    drawn = sorted((r["rank"], r.doc_id, -r.score) for r in rows if r["rank"] is not None)
    assert drawn == [(n, i, s) for n, (s, i) in enumerate(sorted(able)[: 30 * len(able) // 100], 1)]


def test_resampling_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert importance_resampling.resample(empty, empty).count() == 0
    one = spark.createDataFrame([(None, "many words here " * 100_000), (None, None), (2, "")], "doc_id long, text string")
    rows = importance_resampling.resample(one, empty, percent=100).collect()
    assert sorted((r.n_features, r["rank"]) for r in rows if r.n_features) == [(300_000, 1)]
    assert [(r.weight, r["rank"]) for r in rows if not r.n_features] == [(0, None)] * 2


def brute_audit(docs, labels):
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    rows = []
    for i, text, part in docs:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > least[text],
        }
        rows.append((part or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out, share = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            before = set()
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                mine = [r for r in rows if r[0] == part]
                share[part, f] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f in r[1] and bool(r[1] & before) for r in mine), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                before.add(f)
    return {k: (*v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("hot", [False, True])
def test_audit_equals_brute_force(spark, hot, monkeypatch):
    # With the bound lowered every group of copies comes by a shuffle, with it raised by broadcast.
    monkeypatch.setattr(filter_audit, "HEAVY", 0.0 if hot else 1.0)
    rng = random.Random(4)
    plain = [" ".join(f"w{rng.randrange(400)}" for _ in range(n)) for n in (10, 199, 200, 201, 300)]
    pool = [*plain, *(p.title() for p in plain), plain[2] + " #", plain[3] + "|", "one two " * 150, "A" * 40 + " b" * 300, "", " \t", None, "É é" * 100]
    docs = [(rng.choice([None, *range(40)]), rng.choice(pool), rng.choice(["s", "t", "", None])) for _ in range(300)]
    docs += [(5, plain[0], "s")] * 20
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 40, 2)] + [(4, 1, 0), (None, 1, 1)]
    got = filter_audit.audit_filters(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got.collect()} == brute_audit(docs, labels)


def test_audit_edges(spark):
    kinds = "doc_id long, text string, source string, row int, `all` int, word string, `a.b` int"
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(spark.createDataFrame([], kinds), labels).count() == 0
    rows = [(1, "word " * 300_000, "s", 1, 2, "w", 3), (2, None, None, None, None, None, None)]
    got = filter_audit.audit_filters(spark.createDataFrame(rows, kinds), labels).where("filter_order = 'ABCDE'").collect()
    assert {(r.part, r.step): r.removed for r in got if r.removed} == {("s", 2): 1, ("", 1): 1}
    assert len(got) == 10
