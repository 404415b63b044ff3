"""Secret scans: fixed credential patterns plus a randomness test battery, in SQL functions only.

Base patterns give the spans of three kinds (assign, access, hex). Beyond them,
tokens of 20 characters or more face a battery under the null of their inferred
encoding (hexadecimal, base 32, base 36, base 64, letters of one case): chi-squared
uniformity of the alphabet, two runs tests (character classes; vowels against
consonants) and lag-one serial correlation. Each gives a standard score whose high
values speak against randomness. They depend on each other, so only their sum is
judged, against two simulated references of the token's encoding and length class:
uniformly random tokens, which it must not be rejected from, and ordinary tokens
(joined words, CamelCase, paths, names with numbers and dates), whose lower tail gives
the chance that written words look that random. Benjamini and Hochberg's procedure on
these chances, within each length and encoding stratum, keeps the false-discovery rate
among added spans under ``fdr``. Sums are counted in fixed bins, so one small table
decides however large the corpus is; the references are simulated on the driver from a
fixed seed for the strata that occur.

Defined cases: null and empty texts have no spans; every text is read whole;
repeated rows give repeated results; tokens of digits alone, UUIDs and tokens of high
serial correlation are ordinary; an empty table gives an empty result; columns besides doc_id and text are not used.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
import random
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.session import durable

#: The base patterns, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
TOKEN = r"[A-Za-z0-9+/=_-]{20,}"
#: Sums are counted in bins of this width between these bounds.
BIN_WIDTH, LOWEST, HIGHEST = 0.1, -20.0, 100.0
#: Least length of each length class; the references are simulated at it, where words and random tokens differ least.
LENGTHS = (20, 22, 24, 28, 32, 40, 48, 64, 96, 160)
#: Serial correlation alone rejects a token as random beyond this score (1 of 1,000 random tokens): alphabets and counters are as even as random text.
SERIAL_LIMIT = 3.29
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
_LOWER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
_UPPER = _LOWER.upper()
#: Encodings in the order in which they are tried: pattern, alphabet, chance of a class change and of a change between vowel and consonant.
ENCODINGS = {
    "hex": ("^(?:[0-9a-f]+|[0-9A-F]+)$", _DIGITS + "ABCDEF", 0.46875, 4 / 9),
    "lower": ("^[a-z]+$", _LOWER, 0.0, 210 / 676),
    "upper": ("^[A-Z]+$", _UPPER, 0.0, 210 / 676),
    "base32": ("^[A-Z2-7]+=*$", _UPPER + "234567", 0.3046875, 210 / 676),
    "base36": ("^[a-z0-9]+$", _LOWER + _DIGITS, 0.401234568, 210 / 676),
    "base64": ("", _UPPER + _LOWER + _DIGITS + "+/", 0.64453125, 210 / 676),
}
#: Ordinary words of names, for the reference of written tokens.
WORDS = (
    "the and for with from this that user account settings controller test service manager handler request response error default value index table column row data file path name list string number "
    "create update delete insert select remove change load save open close start stop begin end first last next previous parent child node tree graph edge point line image video audio text page link "
    "home about contact search result report summary detail config option server client socket port host local remote network security access permission group member order item product price customer "
    "invoice payment history version release build debug info warning critical internal external public private static final abstract interface module package library framework application window "
    "button label menu dialog style color width height size position international transformation straightforward environment development"
).split()
_HEX_WORDS = "dead beef face cafe feed fade decade facade added bad deed babe cede ace bed dad ebb fee fab abba".split()
_SIMULATED = 4000


def _spans(text: Column, pattern: str, least: int, group: int = 0) -> Column:
    """array<struct<start,end,s>> of all leftmost matches whose ``group`` has ``least`` characters.

    Splitting on a pattern yields the gaps between its matches, so running sums of
    gap and match lengths are the offsets.
    """
    empty = F.array().cast("array<struct<start:int,end:int,s:string>>")
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    pieces = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"), values.alias("value"))
    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("s")))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= least, F.concat(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    found = F.aggregate(pieces, start, step, lambda acc: acc["found"])
    return F.when(text.rlike(pattern), found).otherwise(empty)


def _shaped(spans: Column, number: int) -> Column:
    """Spans with their kind, in a form that sorts by start, then kind as listed."""
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(number).alias("kind_no"), x["end"].alias("end"), F.lit(KINDS[number]).alias("kind")))


def _battery(s: Column) -> Column:
    """struct(stratum, bin) of one token's summed scores; the stratum is null for tokens without an encoding to test."""
    n = F.length(s).cast("double")

    def by_encoding(place: int) -> Column:
        out = F.lit(float(len(ENCODINGS["base64"][1]) if place == 1 else ENCODINGS["base64"][place]))
        for name in reversed(list(ENCODINGS)[:-1]):
            value = ENCODINGS[name][place]
            out = F.when(s.rlike(ENCODINGS[name][0]), float(len(value) if place == 1 else value)).otherwise(out)
        return out

    name = F.lit("base64")
    for other in reversed(list(ENCODINGS)[:-1]):
        name = F.when(s.rlike(ENCODINGS[other][0]), other).otherwise(name)
    size, change, voiced = by_encoding(1), by_encoding(2), by_encoding(3)
    chars = F.array_remove(F.split(s, ""), "")
    squares = F.aggregate(F.transform(F.array_distinct(chars), lambda c: F.pow(n - F.length(F.replace(s, c, F.lit(""))), F.lit(2))), F.lit(0.0), lambda a, x: a + x)
    chi = (size / n * squares - n - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)
    # Runs of one character class: written names change class at word borders only.
    classes = F.translate(s, _UPPER + _LOWER + _DIGITS + "+/=_-", "A" * 26 + "a" * 26 + "0" * 10 + "." * 5)
    runs = F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) - 1
    class_score = F.when(change > 0, ((n - 1) * change - runs) / F.sqrt((n - 1) * change * (1 - change))).otherwise(0.0)
    # Vowels and consonants alternate in words.
    sounds = F.translate(s, "".join(c + c.upper() for c in _LOWER) + _DIGITS + "+/=_-", "".join(("V" if c in "aeiou" else "C") * 2 for c in _LOWER) + "." * 15)
    parts = F.length(F.regexp_replace(F.regexp_replace(sounds, "[VC]+", "x"), r"\.", ""))
    collapsed = F.regexp_replace(F.regexp_replace(F.regexp_replace(sounds, r"\.+", "."), "V+", "V"), "C+", "C")
    turns = F.length(F.replace(collapsed, F.lit("."), F.lit(""))) - parts
    pairs_of_letters = F.length(F.replace(sounds, F.lit("."), F.lit(""))) - parts
    sound_score = (turns - pairs_of_letters * voiced) / F.sqrt(pairs_of_letters * voiced * (1 - voiced) + 0.25)
    codes = F.transform(chars, lambda c: F.ascii(c).cast("double"))
    added = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    mean = added(codes) / n
    spread = added(F.transform(codes, lambda c: c * c)) - n * mean * mean
    products = added(F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda x, y: x * y))
    ends = F.get(codes, 0) + F.get(codes, F.size(codes) - 1)
    together = products - mean * (2 * n * mean - ends) + (n - 1) * mean * mean
    serial = F.when(spread > 1e-6, F.abs(together / spread)).otherwise(0.0) * F.sqrt(n)
    total = F.least(F.lit(HIGHEST), F.greatest(F.lit(LOWEST), chi + class_score + sound_score + serial))
    least = F.lit(LENGTHS[0])
    for edge in LENGTHS[1:]:
        least = F.when(n >= edge, edge).otherwise(least)
    ordinary = s.rlike("^[0-9]+$") | s.rlike(UUID) | (serial > SERIAL_LIMIT)
    return F.struct(F.when(~ordinary, F.concat(name, F.lit("/"), least.cast("string"))).alias("stratum"), F.floor(total / BIN_WIDTH).cast("int").alias("bin"))


def scores(tokens: np.ndarray, encoding: str) -> np.ndarray:
    """The battery's sums of equally long tokens, given as rows of character codes."""
    _, alphabet, change, voiced = ENCODINGS[encoding]
    size, (count, n) = len(alphabet), tokens.shape
    kinds, sounds = np.full(128, 3), np.full(128, 2)
    for kind, letters in enumerate((_UPPER, _LOWER, _DIGITS)):
        kinds[[ord(c) for c in letters]] = kind
    for c in _LOWER + _UPPER:
        sounds[ord(c)] = int(c.lower() in "aeiou")
    counted = np.zeros((count, 128))
    np.add.at(counted, (np.arange(count)[:, None], tokens), 1)
    chi = (size / n * (counted**2).sum(axis=1) - n - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n)
    runs = (np.diff(kinds[tokens], axis=1) != 0).sum(axis=1)
    class_score = ((n - 1) * change - runs) / math.sqrt((n - 1) * change * (1 - change)) if change else 0.0
    sound = sounds[tokens]
    letters = (sound[:, 1:] < 2) & (sound[:, :-1] < 2)
    pairs, turns = letters.sum(axis=1), (letters & (sound[:, 1:] != sound[:, :-1])).sum(axis=1)
    sound_score = (turns - pairs * voiced) / np.sqrt(pairs * voiced * (1 - voiced) + 0.25)
    centred = tokens - tokens.mean(axis=1, keepdims=True)
    serial = np.abs((centred[:, 1:] * centred[:, :-1]).sum(axis=1) / np.maximum((centred**2).sum(axis=1), 1e-9)) * math.sqrt(n)
    return np.clip(chi + class_score + sound_score + serial, LOWEST, HIGHEST)


def ordinary_token(rng: random.Random, encoding: str, n: int) -> str:
    """A token of ``n`` characters as people write them, in the encoding's alphabet."""
    out, style = "", rng.randrange(4)
    mark = rng.choice("/-_")
    while len(out) < n:
        word = rng.choice(WORDS)
        number = str(rng.choice((rng.randrange(10), rng.randrange(100), 2000 + rng.randrange(30), rng.randrange(10**6))))
        if encoding == "hex":
            out += rng.choice(_HEX_WORDS).upper() if rng.random() < 0.5 else number.zfill(rng.choice((1, 2, 4, 8)))
        elif encoding in ("lower", "upper"):
            out += word if encoding == "lower" else word.upper()
        elif encoding in ("base32", "base36"):
            digits = "".join(c for c in number if encoding == "base36" or c in "234567")
            out += (word.upper() if encoding == "base32" else word) + (digits if rng.random() < 0.3 else "")
        elif style < 2:
            out += (word.capitalize() if out or style else word) + (number if rng.random() < 0.15 else "")
        else:
            out += (mark if out else "") + (number if rng.random() < 0.25 else word.capitalize() if style == 2 and rng.random() < 0.3 else word)
    return out[:n]


@cache
def reference(stratum: str) -> tuple[float, float, float, tuple[float, ...]]:
    """Simulated nulls of a stratum: the sum that 1 of 200 random tokens exceeds, then the ordinary tokens' lower tail (bound, mean excess) and their sorted sums."""
    encoding, n = stratum.split("/")[0], int(stratum.split("/")[1])
    rng = random.Random(f"ordinary {stratum}")
    draw = np.random.default_rng(n * 100 + list(ENCODINGS).index(encoding))
    alphabet = np.array([ord(c) for c in ENCODINGS[encoding][1]])
    chance = scores(alphabet[draw.integers(0, len(alphabet), (_SIMULATED, n))], encoding)
    written = np.sort(scores(np.array([[ord(c) for c in ordinary_token(rng, encoding, n)] for _ in range(_SIMULATED)]), encoding))
    bound = float(written[_SIMULATED // 50])
    excess = float(np.mean(bound - written[: _SIMULATED // 50]))
    return float(np.quantile(chance, 0.995)), bound, max(excess, 0.05), tuple(written.tolist())


def ordinary_chance(stratum: str, total: float) -> float:
    """Chance that an ordinary token of the stratum's least length scores ``total`` or less; below the 2 % point by an exponential tail, which lies above a normal one."""
    _, bound, excess, written = reference(stratum)
    if total < bound:
        return 0.02 * math.exp((total - bound) / excess)
    return float(np.searchsorted(written, total, "right") + 1) / (_SIMULATED + 1)


def discovery_bins(counts: list[tuple[str, int, int]], fdr: float) -> dict[str, int]:
    """Highest bin admitted in each stratum by Benjamini and Hochberg, never beyond what random tokens reach; a bin counts as its upper edge."""
    chosen = {}
    for stratum in sorted({c[0] for c in counts if c[0]}):
        own = {b: k for s, b, k in counts if s == stratum}
        tests, rank, most = sum(own.values()), 0, reference(stratum)[0]
        for b in sorted(own):
            rank += own[b]
            if (b + 1) * BIN_WIDTH <= most and ordinary_chance(stratum, (b + 1) * BIN_WIDTH) <= fdr * rank / tests:
                chosen[stratum] = b
    return chosen


def scan_secrets(docs: DataFrame, fdr: float = 0.01, text: str = "text") -> DataFrame:
    """One row per document: doc_id and ``spans``, an array of struct(start, kind_no, end, kind) in order."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select("doc_id", body.alias("text"))
    rows = rows.select(
        "doc_id",
        _spans(F.col("text"), ASSIGN, 6, group=2).alias("assign"),
        _spans(F.col("text"), r"AKIA[A-Z0-9]{16,}", 20).alias("access"),
        _spans(F.col("text"), r"[0-9a-f]{24,}", 24).alias("hex"),
        _spans(F.col("text"), TOKEN, 20).alias("token"),
    )
    base = F.concat(*[_shaped(F.col(kind), number) for number, kind in enumerate(KINDS[:3])])
    rows = rows.select("doc_id", base.alias("base"), "token")
    free = F.filter(F.col("token"), lambda t: ~F.exists(F.col("base"), lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    rows = rows.select("doc_id", "base", free.alias("free"))
    tested = F.transform(F.col("free"), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), _battery(t["s"]).alias("test")))
    rows = durable(rows.select("doc_id", "base", tested.alias("tested")))
    # At most 60 strata of 1,200 bins reach the driver.
    counts = rows.select(F.explode("tested.test").alias("t")).groupBy("t.stratum", "t.bin").count().collect()
    admitted = discovery_bins([tuple(c) for c in counts], fdr)
    if admitted:
        most = F.create_map(*[y for s, b in sorted(admitted.items()) for y in (F.lit(s), F.lit(b))])
        found = F.filter(F.col("tested"), lambda t: F.coalesce(t["test"]["bin"] <= F.try_element_at(most, t["test"]["stratum"]), F.lit(False)))
        return rows.select("doc_id", F.sort_array(F.concat("base", _shaped(found, 3))).alias("spans"))
    return rows.select("doc_id", F.sort_array("base").alias("spans"))


def span_digest(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
