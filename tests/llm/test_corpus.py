"""Line dedup, near dedup, decontamination and the pipeline, against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomery.llm import components, decontamination, line_dedup, near_dedup

DOC = "doc_id long, text string, lang string"


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def brute_lines(docs, min_words):
    """docs in order: (doc_id, text); removes every line inside a run of min_words words seen earlier."""
    solid = []
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        solid.append((doc_id, lines, [i for i, x in enumerate(lines) if x.strip()]))
    first = {}
    for d, (_, lines, at) in enumerate(solid):
        for i in range(len(at)):
            for j in range(i + 1, len(at) + 1):
                run = tuple(lines[k] for k in at[i:j])
                first.setdefault(run, (d, i))
    out = {}
    for d, (doc_id, lines, at) in enumerate(solid):
        gone = set()
        for i in range(len(at)):
            for j in range(i + 1, len(at) + 1):
                run = tuple(lines[k] for k in at[i:j])
                if sum(len(x.split()) for x in run) >= min_words and first[run] < (d, i):
                    gone.update(at[i:j])
        out[doc_id] = "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else None
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [prose(rng, rng.choice((1, 2, 3, 5))) for _ in range(12)]
    docs = [(i, "\n".join(rng.choice([*pool, "", " "]) for _ in range(rng.randrange(0, 14)))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, docs[5][1])]
    frame = spark.createDataFrame([(*d, "en") for d in docs], DOC)
    want = brute_lines(docs, 8)
    for r in line_dedup.dedup_lines(frame, min_words=8).collect():
        text = dict(docs)[r.doc_id]
        assert r.text == (want[r.doc_id] if want[r.doc_id] is not None else text), r.doc_id


def test_line_dedup_edges(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOC)).count() == 0
    long = "\n".join(f"line number {i} of one long text" for i in range(3000))
    rows = [(1, long, "en"), (1, long, "en"), (2, "head\n" + long + "\ntail", "de"), (None, "short\nlines", None), (3, "same again\n" * 50, "en")]
    got = sorted(line_dedup.dedup_lines(spark.createDataFrame(rows, DOC)).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [r.text == long for r in got[:2]] == [True, True]
    assert got[2].text == "head\ntail" and got[4].text == "short\nlines"
    # Runs of 20 lines repeat at every later line; the earliest occurrence starts at line 0.
    assert got[3].n_removed > 0


def test_suffix_ranks_are_suffix_array_positions(spark):
    pairs = spark.createDataFrame([(5, 1, 2), (3, 9, 4), (3, 2, 3), (8, 0, 2)], "r long, s long, n long")
    got = {(r.r, r.s): r["rank"] for r in line_dedup.suffix_ranks(pairs, "r", "s").collect()}
    assert got == {(3, 2): 0, (3, 9): 3, (5, 1): 7, (8, 0): 9}


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 150)] + [(300, x) for x in range(301, 340)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[150] == got[200] == 100 and all(got[x] == 300 for x in range(300, 340))


def shingle_set(text):
    words = [w for w in (re.sub(r"^\W+|\W+$", "", c).lower() for c in (text or "").split()) if w]
    k = min(5, len(words))
    out, seen = set(), {}
    for i in range(len(words) - k + 1 if words else 0):
        g = tuple(words[i : i + k])
        seen[g] = seen.get(g, 0) + 1
        out.add((g, seen[g]))
    return out


def test_near_classes_equal_brute_force(spark):
    rng = random.Random(3)
    docs = []
    for family in range(25):
        base = prose(rng, rng.randrange(30, 200)).split()
        for copy in range(rng.randrange(1, 6)):
            words = list(base)
            for _ in range(copy * len(words) // 120):
                words[rng.randrange(len(words))] = f"x{rng.randrange(99)}"
            docs.append((len(docs), " ".join(words), "en"))
    docs += [(len(docs) + i, t, None) for i, t in enumerate([None, "", "  ", "!!", "two words", "Two words.", "one", docs[0][1], docs[0][1].upper()])]
    sets = {d: shingle_set(t) for d, t, _ in docs}
    parent = {d: d for d, _, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(spark.createDataFrame(docs, DOC)).collect()}
    assert got == {d: root(d) for d in parent}
    kept = near_dedup.drop_near_duplicates(spark.createDataFrame(docs, DOC))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d in parent if root(d) == d)
    assert kept.columns == ["doc_id", "text", "lang"]


def test_near_hot_group(spark):
    rng = random.Random(9)
    base = prose(rng, 80).split()
    rows = []
    for i in range(300):
        words = list(base)
        words[rng.randrange(80)] = f"y{i}"
        rows.append((i, " ".join(words), "en"))
    got = near_dedup.near_classes(spark.createDataFrame(rows, DOC)).select("class_id").distinct().collect()
    assert [r.class_id for r in got] == [0]


def brute_classes(docs):
    """The least doc_id of each doc_id's class, by comparing all pairs."""
    sets, of = {d: shingle_set(t) for d, t, _ in docs}, {d: d for d, _, _ in docs}
    for a in sets:
        for b in sets:
            if a < b and of[a] != of[b] and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((of[a], of[b]))
                of = {d: low if c == high else c for d, c in of.items()}
    return of


def test_near_pairs_in_mixed_buckets(spark):
    """Texts at 0.6 to 0.79 to each other share buckets; pairs at 0.85 among them must all be found."""
    rng = random.Random(17)
    base = prose(rng, 170)
    docs = [(i, f"{base} {' '.join(f'u{i}x{k}' for k in range(rng.randrange(24, 42)))}", "en") for i in range(360)]
    for i in range(0, 240, 6):
        words = docs[i][1].split()
        words[-14:] = [f"v{i}x{k}" for k in range(14 + i % 5)]
        docs.append((len(docs), " ".join(words), "en"))
    # A large class beside single texts that are under 0.8 to it.
    docs += [(len(docs) + i, f"{base} {' '.join(f'z{k}' for k in range(29))} t{i}", "en") for i in range(60)]
    want = brute_classes(docs)
    assert sum(d != c for d, c in want.items()) == 40 + 59
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(spark.createDataFrame(docs, DOC)).collect()}
    assert got == want


def test_near_edges(spark):
    assert near_dedup.near_classes(spark.createDataFrame([], DOC)).count() == 0
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "a b c d e f", None), (2, None, "x"), (2, None, "x")]
    kept = near_dedup.drop_near_duplicates(spark.createDataFrame(rows, DOC)).collect()
    assert sorted((r.doc_id for r in kept)) == [1, 2, 2]


def test_dart_signature_estimates_weighted_jaccard():
    import numpy as np

    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(1, 2**63, n, dtype=np.uint64) for n in (600, 100, 100))
    units, owner = np.concatenate([common, a, common, b]), np.repeat([0, 1], 700)
    sig = near_dedup.dart_signatures(units, owner, 2, 2000)
    assert abs((sig[0] == sig[1]).mean() - 600 / 800) < 0.05
    one = near_dedup.dart_signatures(units[:1], owner[:1], 1, 80)
    assert (one != 0).all()


def leak_words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(4)
    items = [(i, prose(rng, rng.choice((3, 8, 15, 40, 60)))) for i in range(20)] + [(90, ""), (91, None)]
    docs = []
    for i in range(120):
        words = prose(rng, rng.randrange(0, 150)).split()
        if i % 3 == 0:
            leak = items[rng.randrange(20)][1].split()
            if i % 6 == 0 and len(leak) > 30:
                leak[0] = "edited"
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() if i % 2 else w + "," for w in leak]
        docs.append((i, " ".join(words), "en"))
    docs += [(500, None, "en"), (501, "", "en")]

    def grams(words):
        k = min(5, len(words))
        return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)] if words else []

    want = set()
    for item, text in items:
        own = leak_words(text)
        if not own:
            continue
        goal = set(grams(own))
        for doc, body, _ in docs:
            words = leak_words(body)
            for at in range(max(1, len(words) - len(own) + 1)):
                part = words[at : at + len(own)]
                if len(own) < 5 and len(part) < len(own):
                    continue
                have = set(grams(part)) if len(part) >= min(5, len(own)) else set()
                if have and len(goal & have) >= 0.8 * len(goal | have):
                    want.add((doc, item))
    leaks = decontamination.find_leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in leaks.collect()} == want and want
    kept = decontamination.decontaminate(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {d for d, _, _ in docs} - {d for d, _ in want} and kept.columns == ["doc_id", "text", "lang"]


def test_decontamination_edges(spark):
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    empty = spark.createDataFrame([], DOC)
    assert decontamination.decontaminate(empty, items).count() == 0
    docs = spark.createDataFrame([(None, "A b, c d e f g!", "x"), (1, "other", "x")], DOC)
    assert [r.doc_id for r in decontamination.decontaminate(docs, items).collect()] == [1]
    assert decontamination.decontaminate(docs, items.where(F.lit(False))).count() == 2


def test_simhash_blocks_find_all_within_radius(spark):
    row = spark.range(1).select(decontamination.blocks(F.lit(-1).cast("long"), 21).alias("b")).first()
    assert len(row.b) == 21 and sum(x.bits.bit_length() for x in row.b) == 64


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert 0 < out.select("doc_id").distinct().count() <= docs.count()
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, score string, runs int, text_hash int, items string, node int, `a b` string, spans int"


def extra_docs(spark):
    base = "Some plain words that stand here for the sake of a text with lines\nand a second line of words too"
    rows = [(1, base, None, None, None, "s", 1, 2, "i", 3, "x", 4), (None, None, "en", "a", 0, None, None, None, None, None, None, None), (2, "", "en", "a", 0, "t", 1, 1, "i", 1, "y", 1), (2, "", "en", "a", 0, "t", 1, 1, "i", 1, "y", 1), (3, "word " * 30000, "xx", "a", 1, "u", 1, 1, "i", 1, "z", 1)]
    return spark.createDataFrame(rows, EXTRA)


def test_stages_take_clashing_columns_and_nulls(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = extra_docs(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        rows = {r.doc_id: r for r in out.collect()}
        assert rows.keys() == {1, None, 2, 3}, name
        assert rows[1].score == "s" and rows[1]["a b"] == "x" and rows[3].text == "word " * 30000, name
        assert stage(spark, docs.where(F.lit(False)), sf).count() == 0, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert sum(r.length for r in packed if r.doc_id == 3) == 30001 and len([r for r in packed if r.doc_id == 2]) == 2


def test_operators_take_clashing_columns_and_nulls(spark, sf):
    from loomery.llm import quality_rules, queries, secret_scans, token_counts

    docs = extra_docs(spark)
    assert secret_scans.scan_secrets(docs).count() == 5
    judged = quality_rules.judge_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert judged.count() == 5 and judged.where("doc_id = 1").first().score == "s"
    assert quality_rules.judge_quality(docs.where(F.lit(False)), spark.read.parquet(f"{sf}/labels.parquet")).count() == 0
    counted = token_counts.count_tokens(docs, queries.PIECES)
    assert counted.where("doc_id IS NULL").first().n_tokens == 0 and counted.count() == 5
    assert token_counts.count_tokens(docs.where(F.lit(False)), queries.PIECES).count() == 0
