"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become tags (insult, slur, doubtful insult, threat, target, negation, report);
commas and colons are soft breaks inside a clause, other punctuation and line ends
close it. Five transducers are composed into one: insult and threat turn tags into
hits, negation marks hits in the three words after it, reported speech marks hits
after its verb (across soft breaks) or just before it, and target marks insults that
follow an addressee within six words or precede one within two, and threats that
precede one within two. An arc that emits a hit carries a weight by hit and mark, less
for each further one of a text; a text's log-odds are the sum along its clauses'
paths. A single unaimed insult or threat never reaches 0.5: the pattern decides, not
the word.

The seed lexicons and prior weights are English; labelled rows extend the lexicon
(slurs: words seen in many different contexts of toxic texts and nowhere else;
doubtful ones where other texts have them at times) and correct the weights.
About ``sample`` labelled documents of each class at most, chosen by a hash of their
id, propose words and fit the weights; which of the words stand, and as what, all
labelled texts decide, since a sample with as many toxic texts as clean ones shows
hundreds of rare words in toxic texts only. No score sees an id, label, language or
source.

Defined cases: null and empty texts score by the intercept alone; texts are read
whole; repeated rows score alike and a doc_id that repeats is learned from once; a
score of exactly 0.5 predicts 1; an empty table gives an empty result; without labels
the seed grammar and prior weights decide; extra columns pass through and ``score``
and ``predicted`` are replaced if present, in any case of letters.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.llm.columns import bind, map_texts, named
from loomery.session import durable

NEUTRAL, INSULT, SLUR, DOUBTFUL, THREAT, TARGET, NEGATION, REPORT, BREAK = TAGS = range(9)
#: Added to a tag whose word a comma or colon follows, and to one that ends its clause.
SOFT, HARD = 16, 32
SEEDS = {
    INSULT: "idiot moron stupid loser pathetic scum trash worthless disgusting clown dumb imbecile filthy".split(),
    THREAT: "kill hurt destroy stab shoot strangle murder beat burn".split(),
    TARGET: "you your yours you're they them those these people he she".split(),
    NEGATION: "not no never isn't aren't wasn't don't doesn't didn't nobody neither without".split(),
    REPORT: "said says say wrote writes claimed claims called calls quoted quote reported reports told".split(),
}
#: By pattern: prior log-odds of a text with one such hit, what a second and further ones add, and log-odds of a text without hits.
PRIOR = {
    "insult": (-1.3, 1.2, 1.0), "insult+target": (0.6, 1.5, 1.0), "insult+negated": (-2.0, 0.2, 0.1), "insult+reported": (-2.0, 0.2, 0.1),
    "slur": (-0.6, 1.4, 1.0), "slur+target": (0.8, 1.5, 1.0), "slur+negated": (-1.8, 0.3, 0.2), "slur+reported": (-1.8, 0.3, 0.2),
    "doubtful": (-1.5, 0.9, 0.8), "doubtful+target": (-1.2, 0.9, 0.8),
    "threat": (-1.8, 0.4, 0.3), "threat+target": (0.8, 1.5, 1.0), "threat+negated": (-2.1, 0.1, 0.1), "threat+reported": (-2.1, 0.1, 0.1),
}
PATTERNS = tuple(PRIOR)
INTERCEPT = -2.2
#: A text with one hit of such a pattern and nothing else stays this far below even odds.
LONE = ("insult", "threat", "insult+negated", "insult+reported", "threat+negated", "threat+reported")
LONE_MARGIN = 0.2
_CAP = 3
_WORD = re.compile(r"^\W+|\W+$")
_HARD = re.compile(r"[.;!?]\W*$|[\"\u201d\u00bb)]$")
_SOFT = re.compile(r"[,:\u2013\u2014]$")


@dataclass(frozen=True)
class Transducer:
    """Deterministic, letter to letter: ``arcs[state][symbol] = (next state, output)``; the arc ``None`` stands for all others and passes them on."""

    name: str
    arcs: tuple[dict, ...]

    def step(self, state: int, symbol) -> tuple[int, object]:
        own = self.arcs[state]
        return own[symbol] if symbol in own else (own[None][0], symbol)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """One transducer over tags: ``second`` reads what ``first`` writes; only reachable state pairs are built."""
    number, pairs, arcs = {(0, 0): 0}, [(0, 0)], []
    for a, b in pairs:  # grows while it is read
        row = {}
        for tag in TAGS:
            to_a, written = first.step(a, tag)
            to_b, out = second.step(b, written)
            if (to_a, to_b) not in number:
                number[to_a, to_b] = len(pairs)
                pairs.append((to_a, to_b))
            row[tag] = (number[to_a, to_b], out)
        arcs.append(row)
    return Transducer(f"{first.name} o {second.name}", tuple(arcs))


_HITS = ("insult", "slur", "doubtful", "threat")
_MARKED = tuple(f"{h}+{m}" for h in _HITS for m in ("negated", "reported"))


def insult_machine() -> Transducer:
    return Transducer("insult", ({INSULT: (0, "insult"), SLUR: (0, "slur"), DOUBTFUL: (0, "doubtful"), None: (0, None)},))


def threat_machine() -> Transducer:
    return Transducer("threat", ({THREAT: (0, "threat"), None: (0, None)},))


def negation_machine(scope: int = 3) -> Transducer:
    """State: words of the scope that are left; a break closes it."""
    rows = []
    for left in range(scope + 1):
        after = max(0, left - 1)
        row = {NEGATION: (scope, NEGATION), BREAK: (0, BREAK), None: (after, None)}
        rows.append(row | ({h: (after, f"{h}+negated") for h in _HITS} if left else {}))
    return Transducer("negation", tuple(rows))


def report_machine(late: int = 3) -> Transducer:
    """State 0, 1 within reported speech, 1 + n while n more words may still report the last hit."""
    reporting = {h: (1, f"{h}+reported") for h in _HITS} | {None: (1, None)}
    rows = []
    for left in range(late + 1):
        after = left if left > 1 else 0  # state 1 + left - 1, or 0
        row = {h: (1 + late, h) for h in _HITS} | {m: (0, m) for m in _MARKED}
        row |= {REPORT: (1, "late+reported" if left else REPORT), BREAK: (1 + left if left else 0, BREAK), None: (after, None)}
        rows.append(row)
    return Transducer("report", (rows[0], reporting, *rows[1:]))


def target_machine(early: int = 6, late: int = 2) -> Transducer:
    """State: (words for which an addressee still counts, words in which one may still follow the last hit)."""
    at = lambda a, p: max(a, 0) * (late + 1) + max(p, 0)
    rows = []
    for a in range(early + 1):
        for p in range(late + 1):
            row = {h: (at(a - 1, 0), f"{h}+target") if a else (at(0, late), h) for h in _HITS[:3]}
            row |= {"threat": (at(a - 1, late), "threat"), TARGET: (at(early, 0), "late+target" if p else TARGET), BREAK: (at(a, p), BREAK)}
            row |= {m: (at(a - 1, 0), m) for m in (*_MARKED, "late+reported")} | {None: (at(a - 1, p - 1), None)}
            rows.append(row)
    return Transducer("target", tuple(rows))


GRAMMAR = reduce(compose, (insult_machine(), threat_machine(), negation_machine(), report_machine(), target_machine()))


def clause_patterns(tags: Iterable[int], grammar: Transducer = GRAMMAR) -> list[str]:
    """Patterns on the grammar's path over one clause; a late mark goes to the hit before it, and doubtful hits need no clearing."""
    state, found = 0, []
    for tag in tags:
        state, out = grammar.arcs[state][tag]
        if isinstance(out, str):
            if out.startswith("late+"):
                found[-1] = f"{found[-1].partition('+')[0]}+{out[5:]}"
            else:
                found.append(out)
    return [p for p in found if p in PRIOR]


class Tagger(dict):
    """Maps a white-space chunk to its tag; bounded memory."""

    def __init__(self, lexicon: dict[str, int]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, chunk: str) -> int:
        if len(self) >= 400_000:
            self.clear()
        tag = self.lexicon.get(_WORD.sub("", chunk).lower(), NEUTRAL) + (HARD if _HARD.search(chunk) else SOFT if _SOFT.search(chunk) else 0)
        if len(chunk) < 64:
            self[chunk] = tag
        return tag


_HIT = re.compile(b"[" + bytes(t + b for b in (0, SOFT, HARD) for t in (INSULT, SLUR, DOUBTFUL, THREAT)) + b"]")
_LAST = re.compile(b"[" + bytes(range(HARD, 2 * HARD)) + b"]")


def _symbols(clause: bytes) -> list[int]:
    """Tags with a break after those that a comma or colon follows."""
    return [x for t in clause for x in ((t % SOFT, BREAK) if t & SOFT else (t % SOFT,))]


def text_profile(tagger: Tagger, text: str | None) -> tuple[int, ...]:
    """Hits of each pattern in all clauses, at most ``_CAP``."""
    counts = dict.fromkeys(PATTERNS, 0)
    for line in (text or "").split("\n"):
        tags = bytes(map(tagger.__getitem__, line.split()))
        if not _HIT.search(tags):
            continue
        at = 0
        for stop in [*(m.end() for m in _LAST.finditer(tags)), len(tags)]:
            clause, at = tags[at:stop], stop
            if _HIT.search(clause):
                for pattern in clause_patterns(_symbols(clause)):
                    counts[pattern] += 1
    return tuple(min(_CAP, counts[p]) for p in PATTERNS)


@dataclass(frozen=True)
class ToxicityModel:
    """``weights[pattern]``: what the arcs that emit it add at its first, second and further hits in a text."""

    lexicon: dict[str, int]
    intercept: float
    weights: tuple[tuple[float, ...], ...]

    def score(self, profile: tuple[int, ...]) -> float:
        z = self.intercept + sum(sum(w[:n]) for w, n in zip(self.weights, profile, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def seed_lexicon() -> dict[str, int]:
    return {word: tag for tag, words in SEEDS.items() for word in words}


def _profiles(docs: DataFrame, lexicon: dict[str, int], keep: list[str]) -> DataFrame:
    """Columns ``keep`` of docs with each text's profile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(lexicon)
        for batch in batches:
            found = [list(text_profile(tagger, t)) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, pa.list_(pa.int32()))], names=[*batch.schema.names[: len(keep)], "new_0"])

    return map_texts(docs, keep, "text", {"profile": "array<int>"}, run)


def fit_weights(cells: list[tuple[tuple[int, ...], float, float]], rounds: int = 40, prior_strength: float = 0.5) -> tuple[float, tuple[tuple[float, ...], ...]]:
    """MAP logistic regression by Newton steps on counted cells (profile, toxic weight, clean weight), projected so that lone hits stay below even odds."""
    width = len(PATTERNS) * _CAP
    prior = np.array([INTERCEPT, *(w for p in PATTERNS for w in PRIOR[p])])
    reach = prior[1::_CAP].copy()
    prior[1::_CAP] -= INTERCEPT
    x = np.zeros((len(cells), width + 1))
    x[:, 0] = 1
    for row, (profile, _, _) in enumerate(cells):
        for n, count in enumerate(profile):
            x[row, 1 + n * _CAP : 1 + n * _CAP + count] = 1
    pos, neg = np.array([c[1] for c in cells]), np.array([c[2] for c in cells])
    lone, tied = [1 + PATTERNS.index(p) * _CAP for p in LONE], []
    w = prior.copy()
    for _ in range(rounds if cells else 0):
        # First hits are believed to lead to certain log-odds, wherever the intercept has moved.
        prior[1::_CAP] = reach - w[0]
        # Lone hits that press against their limit follow the intercept, and the others are solved beside them.
        free = x.copy()
        free[:, 0] -= x[:, tied].sum(axis=1)
        free[:, tied] = 0
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        back = prior_strength * (w - prior)
        back[tied] = 0
        grad = free.T @ (pos - (pos + neg) * p) - back
        hess = (free * ((pos + neg) * p * (1 - p))[:, None]).T @ free + prior_strength * np.eye(width + 1)
        step = np.clip(np.linalg.solve(hess, grad), -2, 2)
        # A further hit never speaks for a text.
        after = np.concatenate([[w[0] + step[0]], np.maximum(w[1:] + step[1:], 0.0)])
        limit = max(0.0, -after[0] - LONE_MARGIN)
        tied = [j for j in lone if j in tied or after[j] >= limit]
        after[tied] = limit
        moved, w = np.abs(after - w).max(), after
        if moved < 1e-4:
            break
    return float(w[0]), tuple(tuple(float(v) for v in w[1 + n * _CAP : 1 + (n + 1) * _CAP]) for n in range(len(PATTERNS)))


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the labels to learn from; a repeated doc_id counts once."""
    own = labels.where(F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    return own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> DataFrame:
    """(text, toxic, weight) of labelled documents whose crc32(doc_id) mod 5 is not 0, about ``sample`` of each class at most; a repeated doc_id counts once."""
    own = known_labels(labels)
    sizes = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
    rates = {c: min(1.0, sample / max(1, sizes.get(c, 0))) for c in (0, 1)}
    rate = F.when(F.col("toxic") == 1, rates[1]).otherwise(rates[0])
    chosen = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < rate * 1_000_000)
    # The sample bounds what is broadcast: some 24 bytes for each chosen row.
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic", (1 / rate).alias("weight"))


def _words() -> Column:
    return F.array_remove(F.split(F.lower("text"), r"[^\p{L}\p{N}']+"), "")


def _placed(w: Column, names: list[str] | None = None) -> Column:
    """Words (of ``names`` only, where given) with a checksum of their neighbours, the context."""
    near = lambda i: F.coalesce(F.get(w, i), F.lit(""))
    place = lambda x, i: F.struct(x.alias("word"), F.xxhash64(near(i + 1), near(i - 1)).alias("context"))
    if names is None:
        return F.transform(w, place)
    return F.filter(F.transform(w, lambda x, i: F.when(x.isin(names), place(x, i))), lambda x: x.isNotNull())


def _marking(seen: DataFrame, support: int, ratio: float) -> dict[str, int]:
    """Tags of words from (doc, word, context, toxic, weight)."""
    seen = seen.groupBy("word", "doc", "toxic", "weight").agg(F.min("context").alias("context"))
    seen = seen.groupBy("word", "context", "toxic").agg(F.max("weight").alias("weight"))
    scored = seen.groupBy("word").agg(F.sum("toxic").alias("n"), F.sum(F.col("toxic") * F.col("weight")).alias("bad"), F.sum((1 - F.col("toxic")) * F.col("weight")).alias("fine"))
    found = scored.where((F.col("n") >= support) & (F.col("bad") >= ratio * F.col("fine")))
    return {r["word"]: SLUR if r["sure"] else DOUBTFUL for r in found.select("word", (F.col("fine") == 0).alias("sure")).collect()}


def induce_words(rows: DataFrame, support: int = 6, ratio: float = 2.0) -> dict[str, int]:
    """Words found in at least ``support`` toxic texts and contexts: slurs if no clean text has them, doubtful if toxic ones weigh ``ratio`` times the clean.

    A text counts once for a word, with one context (the neighbouring words), and
    equal contexts count once, so neither repetition within a text nor copies of a
    text support a word twice. The sample bounds the words that the driver receives.
    """
    seen = rows.select("toxic", "weight", F.xxhash64("text").alias("doc"), F.explode_outer(bind(_words(), lambda w: _placed(w))).alias("x")).where(F.length("x.word").between(3, 40))
    return _marking(seen.select("doc", "x.*", "toxic", "weight"), support, ratio)


def confirm_words(docs: DataFrame, labels: DataFrame, proposed: Iterable[str], support: int = 6, ratio: float = 2.0) -> dict[str, int]:
    """``induce_words`` over every labelled text, for the proposed words only.

    Texts stay where they lie; what is shuffled are the places of these words.
    """
    names = sorted(proposed)
    if not names:
        return {}
    texts = docs.select(F.col("doc_id").alias("doc"), F.col("text").cast("string").alias("text")).where(F.crc32(F.col("doc").cast("string")) % 5 != 0)
    seen = texts.select("doc", F.explode_outer(bind(_words(), lambda w: _placed(w, names))).alias("x")).where(F.col("x").isNotNull()).select("doc", "x.*")
    known = known_labels(labels).select(F.col("doc_id").alias("doc"), "toxic", F.lit(1.0).alias("weight"))
    return _marking(seen.groupBy("doc", "word").agg(F.min("context").alias("context")).join(known, "doc"), support, ratio)


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> ToxicityModel:
    """Extend the lexicon (seeds keep their tags) and fit the pattern weights."""
    rows = durable(training_rows(docs, labels, sample))
    lexicon = confirm_words(docs, labels, induce_words(rows)) | seed_lexicon()
    counted = _profiles(rows, lexicon, ["toxic", "weight"]).groupBy("profile").agg(F.sum(F.col("toxic") * F.col("weight")).alias("bad"), F.sum((1 - F.col("toxic")) * F.col("weight")).alias("fine"))
    cells = sorted((tuple(r["profile"]), r["bad"], r["fine"]) for r in counted.collect())
    return ToxicityModel(lexicon, *fit_weights(cells))


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep_text: bool = False, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Add the score and the prediction under ``names``; the text stays only if asked for."""
    keep = [c for c in docs.columns if not named(c, *names) and (keep_text or not named(c, "text"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger, memory = Tagger(model.lexicon), {}
        for batch in batches:
            scores = []
            for text in batch.column(len(keep)).to_pylist():
                profile = text_profile(tagger, text)
                if profile not in memory:
                    memory[profile] = model.score(profile)
                scores.append(memory[profile])
            new = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *new], names=[*batch.schema.names[: len(keep)], "new_0", "new_1"])

    return map_texts(docs, keep, "text", {names[0]: "double", names[1]: "int"}, run)
