"""The toxicity grammar against a plain reading of its rules, and what context does to predictions."""

import random

import pytest
from pyspark.sql import functions as F

from loomery.llm import toxicity as tox

HITS = {tox.INSULT: "insult", tox.SLUR: "slur", tox.DOUBTFUL: "doubtful", tox.THREAT: "threat"}


def brute_patterns(tags):
    """Marks of each hit by looking around it; distances count words, breaks are none."""
    at = [i for i, t in enumerate(tags) if t != tox.BREAK]
    words = [tags[i] for i in at]
    broken = [tox.BREAK in tags[a:b] for a, b in zip(at, [*at[1:], len(tags)], strict=bool(at))]  # after each word
    marks = {}
    for w, tag in enumerate(words):
        if tag not in HITS:
            continue
        before = range(w - 1, -1, -1)
        if any(words[j] == tox.NEGATION and w - j <= 3 and not any(broken[j:w]) for j in before):
            marks[w] = "negated"
        elif tox.REPORT in words[:w]:
            marks[w] = "reported"
        else:
            marks[w] = ""
    for w in [w for w in marks if not marks[w]]:
        stop = next((j for j in range(w + 1, len(words)) if words[j] in HITS), len(words))
        ahead = [words[j] for j in range(w + 1, min(stop, w + 4))]
        if tox.REPORT in ahead:
            marks[w] = "late"
    for w in [w for w in marks if marks[w] in ("", "late")]:
        early = words[w] != tox.THREAT and tox.TARGET in words[max(0, w - 6) : w]
        stop = next((j for j in range(w + 1, len(words)) if words[j] in HITS), len(words))
        late = tox.TARGET in words[w + 1 : min(stop, w + 3)]
        marks[w] = "reported" if marks[w] == "late" else "target" if early or late else ""
    found = [HITS[words[w]] + (f"+{m}" if m else "") for w, m in sorted(marks.items())]
    return [p for p in found if p in tox.PRIOR]


def test_composed_grammar_equals_brute_force():
    rng = random.Random(11)
    kinds = [tox.NEUTRAL] * 5 + list(tox.TAGS)
    for _ in range(20_000):
        tags = [rng.choice(kinds) for _ in range(rng.randrange(1, 12))]
        assert tox.clause_patterns(tags) == brute_patterns(tags), tags


def test_every_machine_decides():
    """Leaving any of the five out of the composition changes what some clause means."""
    machines = [tox.insult_machine(), tox.threat_machine(), tox.negation_machine(), tox.report_machine(), tox.target_machine()]
    clauses = [[tox.TARGET, tox.NEUTRAL, tox.INSULT], [tox.THREAT, tox.TARGET], [tox.NEGATION, tox.INSULT], [tox.REPORT, tox.BREAK, tox.INSULT]]
    for left_out in range(5):
        rest = [m for i, m in enumerate(machines) if i != left_out]
        grammar = rest[0]
        for m in rest[1:]:
            grammar = tox.compose(grammar, m)
        assert any(tox.clause_patterns(c, grammar) != tox.clause_patterns(c) for c in clauses), machines[left_out].name


@pytest.fixture(scope="module")
def model():
    return tox.ToxicityModel(tox.seed_lexicon(), *tox.fit_weights([]))


def predicted(model, text):
    return int(model.score(tox.text_profile(tox.Tagger(model.lexicon), text)) >= 0.5)


@pytest.mark.parametrize(
    ("text", "pattern", "flag"),
    [
        ("You are an idiot.", "insult+target", 1), ("An idiot walked in.", "insult", 0), ("They are not stupid, friend", "insult+negated", 0), ("He said: what an idiot", "insult+reported", 0),
        ('He said, "you are an idiot"', "insult+reported", 0), ("She said: you are an idiot", "insult+reported", 0), ("What an idiot, he said", "insult+reported", 0), ("He said so. You are an idiot", "insult+target", 1),
        ("You, my friend, are an idiot", "insult+target", 1), ("Kill the process you started", "threat", 0), ("I will kill you", "threat+target", 1), ("I will not kill you", "threat+negated", 0), ("", None, 0), (None, None, 0),
    ],
)
def test_context_decides(model, text, pattern, flag):
    profile = tox.text_profile(tox.Tagger(model.lexicon), text)
    assert {p for p, n in zip(tox.PATTERNS, profile, strict=True) if n} == ({pattern} if pattern else set())
    assert predicted(model, text) == flag


def test_order_of_words_changes_predictions(model):
    """The same words in another order: a bag of words could not tell them apart."""
    pairs = [("I will kill you now", "you now will I kill"), ("You are an idiot", "idiot is what an awful lot of you are"), ("She said you are an idiot", "You are an idiot and then some more words passed before she said")]
    for a, b in pairs:
        assert predicted(model, a) != predicted(model, b), (a, b)
    rng, changed = random.Random(2), 0
    clauses = ["you are all such an utter idiot to me in every way", "we will hurt you some day soon and then be gone for good", "nobody here is not a moron but the man over there who left"]
    for text in clauses * 10:
        words = text.split()
        rng.shuffle(words)
        changed += predicted(model, text) != predicted(model, " ".join(words))
    assert changed >= 5


def test_lone_hits_stay_below_even_odds_whatever_the_labels_say():
    profile = lambda p, n: tuple(n if q == p else 0 for q in tox.PATTERNS)
    cells = [(profile("insult", 1), 500.0, 0.0), (profile("insult", 2), 500.0, 0.0), (profile("insult", 0), 0.0, 5000.0)]
    fitted = tox.ToxicityModel({}, *tox.fit_weights(cells))
    assert fitted.score(profile("insult", 1)) < 0.5 < fitted.score(profile("insult", 2))
    assert fitted.score(profile("insult+target", 1)) > 0.5


def test_repeated_rows_ties_and_clashing_names(spark):
    rows = [(1, "You are an idiot.", "a", 1), (1, "You are an idiot.", "a", 1), (2, None, "b", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Score string, PREDICTED int")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 1)], "doc_id long, toxic int, quality int")
    assert tox.training_rows(docs, labels).groupBy("text").count().where("count > 1").count() == 0
    out = tox.score_toxicity(docs, tox.fit_toxicity(docs, labels))
    assert out.columns == ["doc_id", "score", "predicted"] and out.count() == 3
    even = tox.ToxicityModel({}, 0.0, tuple((0.0, 0.0, 0.0) for _ in tox.PATTERNS))
    assert {r.predicted for r in tox.score_toxicity(docs, even).collect()} == {1}
    assert tox.score_toxicity(docs.where(F.lit(False)), even).count() == 0


def test_words_that_only_the_sample_holds_to_be_slurs_do_not_stand(spark):
    """A word of clean texts that the sample leaves out; copies and repeats count as in the sample."""
    labels = spark.createDataFrame([(i, int(i % 10 == 0), 1) for i in range(3000)], "doc_id long, toxic int, quality int")
    frame = lambda texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    texts = [f"plain a{i} words b{i}" for i in range(3000)]
    taken = {int(r.text.split()[1][1:]) for r in tox.training_rows(frame(texts), labels, sample=60).collect()}
    assert 40 < len([i for i in taken if i % 10]) < 90
    texts = [f"{t} blargen c{i} zorkel d{i}" if i % 10 == 0 else f"{t} zorkel d{i}" if i not in taken and i % 7 == 0 else t for i, t in enumerate(texts)]
    docs = frame(texts)
    assert {"blargen", "zorkel"} <= set(tox.induce_words(tox.training_rows(docs, labels, sample=60)))
    fitted = tox.fit_toxicity(docs, labels, sample=60)
    assert fitted.lexicon["blargen"] == tox.SLUR and "zorkel" not in fitted.lexicon
    assert {(r.doc_id % 10 == 0, r.predicted) for r in tox.score_toxicity(docs, fitted).collect()} <= {(True, 1), (False, 0)}
    whole = tox.training_rows(docs, labels, sample=10_000)
    assert tox.confirm_words(docs, labels, ["blargen", "zorkel", "plain", "absent"]) == {w: t for w, t in tox.induce_words(whole).items() if w in ("blargen", "zorkel", "plain")}
