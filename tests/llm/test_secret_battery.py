"""The randomness battery: SQL against plain Python, its references, and what it finds and leaves alone."""

import math
import os
import pkgutil
import random
import string
import uuid

import pytest
from pyspark.sql import functions as F

from loomery.llm import secret_scans as scans

B64 = string.ascii_letters + string.digits + "+/"


def plain_score(s, encoding):
    """The battery by its definitions, one token at a time."""
    _, alphabet, change, voiced = scans.ENCODINGS[encoding]
    n, k = len(s), len(alphabet)
    chi = (k / n * sum(s.count(c) ** 2 for c in set(s)) - n - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    kind = lambda c: "A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else "."
    runs = sum(kind(a) != kind(b) for a, b in zip(s, s[1:]))
    classes = ((n - 1) * change - runs) / math.sqrt((n - 1) * change * (1 - change)) if change else 0
    near = [(a.lower() in "aeiou", b.lower() in "aeiou") for a, b in zip(s, s[1:]) if a.isalpha() and b.isalpha()]
    sound = (sum(a != b for a, b in near) - len(near) * voiced) / math.sqrt(len(near) * voiced * (1 - voiced) + 0.25)
    m = sum(map(ord, s)) / n
    serial = abs(sum((ord(a) - m) * (ord(b) - m) for a, b in zip(s, s[1:])) / max(sum((ord(a) - m) ** 2 for a in s), 1e-9)) * math.sqrt(n)
    return max(scans.LOWEST, min(scans.HIGHEST, chi + classes + sound + serial)), serial


def plain_encoding(s):
    import re

    return next(name for name, (pattern, *_) in scans.ENCODINGS.items() if re.search(pattern, s))


def keys(rng, n, count):
    draw = lambda letters: ["".join(rng.choice(letters) for _ in range(n)) for _ in range(count)]
    return {"HEX": draw("0123456789ABCDEF"), "base32": draw(string.ascii_uppercase + "234567"), "base64": draw(B64)}


def written_names():
    """Names of the standard library of 20 characters and more, paths, titles, dates and UUIDs: none is in the reference's lists."""
    found = set()
    for info in pkgutil.iter_modules([os.path.dirname(os.__file__)]):
        path = os.path.join(os.path.dirname(os.__file__), f"{info.name}.py")
        if os.path.exists(path):
            with open(path, errors="replace") as f:
                found.update(w for w in __import__("re").findall(r"[A-Za-z0-9_]{20,}", f.read()) if not w.isdigit())
    names = sorted(w for w in found if not __import__("re").search(r"[0-9a-f]{20}|[0-9A-F]{20}", w))[:3000]
    rng = random.Random(8)
    names += [str(uuid.UUID(int=rng.getrandbits(128))) for _ in range(200)]
    names += [f"https/path/to/some/file/20{i:02d}/05/report-v{i}" for i in range(40)] + [f"a-title-with-many-words-in-it-{i}" for i in range(40)] + ["UserAccountSettingsControllerTest2", "x" * 30, "-" * 24, "0123456789abcdefghij", "abcdefghijklmnopqrstuvwxyz"]
    return names


def test_sql_equals_plain_python(spark):
    rng = random.Random(1)
    tokens = [t for n in (20, 21, 27, 40, 100) for ts in keys(rng, n, 4).values() for t in ts] + written_names()[::40] + ["a" * 20, "=" * 25, "Ab" * 15, "z9" * 12, "a_b-c/d+e=" * 3]
    rows = spark.createDataFrame([(t,) for t in tokens], "s string").select("s", scans._battery(F.col("s")).alias("t")).collect()
    for r in rows:
        total, serial = plain_score(r.s, plain_encoding(r.s))
        ordinary = r.s.isdigit() or __import__("re").search(scans.UUID, r.s) or serial > scans.SERIAL_LIMIT
        edge = max(e for e in scans.LENGTHS if e <= len(r.s))
        assert r.t.stratum == (None if ordinary else f"{plain_encoding(r.s)}/{edge}"), r.s
        assert r.t.bin in {math.floor((total - 1e-7) / scans.BIN_WIDTH), math.floor((total + 1e-7) / scans.BIN_WIDTH)}, r.s


def test_vectorised_scores_equal_plain_python():
    import numpy as np

    rng = random.Random(3)
    for encoding in scans.ENCODINGS:
        for n in (20, 33):
            tokens = [scans.ordinary_token(rng, encoding, n) for _ in range(20)]
            got = scans.scores(np.array([[ord(c) for c in t] for t in tokens]), encoding)
            assert got == pytest.approx([plain_score(t, encoding)[0] for t in tokens])


def test_chances_hold_on_fresh_ordinary_tokens():
    """Of other ordinary tokens, no larger a share falls below a sum than its stated chance, simulation error aside."""
    import numpy as np

    for stratum in ("hex/20", "base32/20", "base36/24", "base64/20", "base64/40", "lower/20"):
        encoding, n = stratum.split("/")
        rng = random.Random(f"fresh {stratum}")
        fresh = np.sort(scans.scores(np.array([[ord(c) for c in scans.ordinary_token(rng, encoding, int(n))] for _ in range(20_000)]), encoding))
        for share in (0.001, 0.005, 0.02, 0.1):
            at = float(fresh[int(share * len(fresh))])
            assert scans.ordinary_chance(stratum, at) >= 0.6 * share, (stratum, share)


def run(spark, tokens):
    docs = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(tokens)], "doc_id long, text string")
    return {r.doc_id for r in scans.scan_secrets(docs).collect() if any(x.kind == "random" for x in r.spans)}


@pytest.mark.parametrize("n", [20, 22, 32, 44])
def test_recall_and_false_discovery(spark, n):
    rng = random.Random(n)
    groups, names = keys(rng, n, 150), written_names()
    tokens = [t for ts in groups.values() for t in ts] + names
    # Upper-case hexadecimal and base 32 are base patterns for no kind, so the battery alone must find them.
    flagged = run(spark, tokens)
    for k, kind in enumerate(groups):
        hits = len([i for i in flagged if k * 150 <= i < (k + 1) * 150])
        assert hits >= 0.9 * 150, (kind, hits)
    wrong = [tokens[i] for i in flagged if i >= 450]
    assert len(wrong) <= 0.01 * len(flagged), wrong


def test_ordinary_tokens_alone_give_nothing(spark):
    names = written_names()
    assert len(run(spark, names)) <= 0.001 * len(names)
