"""The pipeline over a planted corpus, stage by stage against plain Python."""

import random
import zlib

import pytest
from test_corpus import brute_classes, brute_lines, leak_words, prose

from loomery.llm import queries, tokens, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def planted(rng):
    passage = [prose(rng, 45) for _ in range(3)]
    block = "\n".join(prose(rng, 9) for _ in range(7))
    texts = [prose(rng, rng.randrange(30, 140)) for _ in range(40)]
    texts += [f"{prose(rng, 20)}. You are a worthless idiot. You are all scum. {prose(rng, 20)}" for _ in range(6)]
    texts += [f"{prose(rng, 12)}\n{block}\n{prose(rng, 12)}" for _ in range(5)]
    for i in range(8):
        words = texts[i].split()
        words[len(words) // 2] = f"changed{i}"
        texts.append(" ".join(words) if i % 2 else texts[i])
    base = prose(rng, 120)
    texts += [f"{base} {prose(rng, 24)}" for _ in range(12)]
    texts += [f"{prose(rng, 15)} {p} {prose(rng, 15)}" for p in passage]
    texts += [None, "", " \n", "one", prose(rng, 3000)]
    return texts, passage


def contaminated(text, items):
    words = leak_words(text)
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for item in items:
        goal = grams(leak_words(item))
        size = len(leak_words(item))
        if any(len(goal & have) >= 0.8 * len(goal | have) for at in range(max(1, len(words) - size + 1)) if (have := grams(words[at : at + size]))):
            return True
    return False


def test_pipeline_equals_brute_force(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(21)
    texts, passages = planted(rng)
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    sf = str(tmp_path)
    frame = spark.createDataFrame(docs, COLUMNS)
    frame.write.parquet(f"{sf}/documents.parquet")
    labels = spark.createDataFrame([(i, int("idiot" in (t or "")), 1) for i, t in enumerate(texts) if i % 3], "doc_id long, toxic int, quality int")
    labels.write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    read = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()))
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]

    model = toxicity.fit_toxicity(frame, labels)
    tagger = toxicity.Tagger(model.lexicon)
    step = stages["toxicity"](spark, frame, sf)
    want = [(i, t) for i, t in enumerate(texts) if model.score(toxicity.text_profile(tagger, t)) < 0.5]
    assert read(step) == want and not any("idiot" in (t or "") for _, t in want) and len(want) == len(texts) - 6

    cut = brute_lines(want, 40)
    after = [(i, t if cut[i] is None else cut[i]) for i, t in want]
    solid = lambda t: [x for x in (t or "").split("\n") if x.strip()]
    kept = [(i, t) for i, t in after if solid(t) or not solid(dict(want)[i])]
    step = stages["line_dedup"](spark, step, sf)
    assert read(step) == kept and any(cut.values())

    classes = brute_classes([(i, t, "") for i, t in kept])
    kept = [(i, t) for i, t in kept if classes[i] == i]
    step = stages["near_dedup"](spark, step, sf)
    assert read(step) == kept and len(set(classes.values())) < len(classes)

    kept = [(i, t) for i, t in kept if not contaminated(t, passages)]
    step = stages["decontamination"](spark, step, sf)
    assert read(step) == kept

    bpe = tokens.word_bpe(queries.WORD_BPE)
    rows = pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == {i for i, _ in kept}
    for i, t in kept:
        ids = bpe.ids(t or "") + (1).to_bytes(4, "little")
        pieces = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in pieces] == [sum(p.length for p in pieces[:n]) for n in range(len(pieces))] and sum(r.length for r in pieces) * 4 == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) for r in pieces)
