"""Types of JSON rows and entities in texts, against plain Python."""

import json
import random
import re

from loomery.operators import entities, json_types


def kind_of(v):
    return {type(None): "null", bool: "boolean", int: "integer", float: "number", str: "string", dict: "object", list: "array"}[type(v)]


def brute_tree(rows):
    found = {}

    def visit(path, v):
        found.setdefault(path, []).append(kind_of(v))
        for name, x in v.items() if isinstance(v, dict) else ():
            visit(f"{path}.{name}", x)
        for x in v if isinstance(v, list) else ():
            visit(f"{path}[]", x)

    for text in rows:
        try:
            visit("$", json.loads(text))
        except (TypeError, ValueError):
            found.setdefault("$", []).append("invalid")
    out = {}
    for path, kinds in found.items():
        known = set(kinds) - {"null", "invalid"}
        merged = "null" if not known else known.pop() if len(known) == 1 else "number" if known <= {"integer", "number"} else "any" if known & {"object", "array"} else "string"
        parent = path[:-2] if path.endswith("[]") else path.rpartition(".")[0]
        of = found.get(parent, []).count("array" if path.endswith("[]") else "object")
        out[path] = (merged, sorted(set(kinds)), len(kinds), kinds.count("null"), len(kinds) / of if of else None)
    return out


def random_value(rng, depth):
    roll = rng.random()
    if depth and roll < 0.3:
        return {rng.choice("abc"): random_value(rng, depth - 1) for _ in range(rng.randrange(3))}
    if depth and roll < 0.45:
        return [random_value(rng, depth - 1) for _ in range(rng.randrange(3))]
    return rng.choice([None, True, 3, 2.5, "s", ""])


def test_type_tree_equals_python_merge(spark):
    rng = random.Random(6)
    rows = [json.dumps({"a": random_value(rng, 3), "b": random_value(rng, 2)}) for _ in range(300)] + [None, "", "{", "[1, 2.5]", "7", "null"]
    tree = json_types.type_tree(spark.createDataFrame([(r,) for r in rows], "j string"), "j")
    got = {r.path: (r.type, r.kinds, r.n, r.nulls, r.share) for r in tree.collect()}
    assert got == brute_tree(rows)


def test_json_schema_and_empty_tables(spark):
    rows = ['{"a": 1, "b": {"c": "x"}, "d": [1, 2.5]}', '{"b": {}, "d": []}']
    schema = json.loads(json_types.json_schema(json_types.type_tree(spark.createDataFrame([(r,) for r in rows], "j string"), "j")))
    assert schema == {
        "type": "object", "required": ["b", "d"],
        "properties": {"a": {"type": "integer"}, "b": {"type": "object", "properties": {"c": {"type": "string"}}, "required": []}, "d": {"type": "array", "items": {"type": "number"}}},
    }
    empty = json_types.type_tree(spark.createDataFrame([], "j string"), "j")
    assert empty.count() == 0 and json_types.json_schema(empty) == "{}"


TEXTS = [
    "Call +1 555-123-4567 or (555) 123 4567. Price: 99.50 USD, once $1,200.00! Mail A@b.org, a@B.org", None, "", "Ada Lovelace met Acme Corp on Jan 5, 2024 and 2024-01-05; see https://x.org/a and www.y.com/b?c=d",
    "é" * 60 + " price €50 " + "ü" * 60 + " €50 costs", "12", "no entity here" * 40,
]


def test_entities_equal_finditer(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = entities.mentions(docs, "doc_id", disjoint=False).collect()
    want = set()
    for i, text in enumerate(TEXTS):
        for kind, patterns in entities.KINDS.items():
            for m in {m.span(): m for p in patterns for m in re.finditer(p, text or "", re.IGNORECASE)}.values():
                if len(m.group().strip()) > 2:
                    want.add((i, kind, m.group().strip(), m.start(), m.end(), text[max(0, m.start() - 50) : m.end() + 50].strip(), kind in text.lower()))
    assert {tuple(r) for r in rows} == want and len(want) > 20
    apart = entities.mentions(docs, "doc_id").collect()
    for r in apart:
        assert not any(o.doc_id == r.doc_id and o.kind == r.kind and o.start < r.start < o.end for o in apart)
    best = {(r.doc_id, r.kind, r.value): r for r in entities.entities(docs, "doc_id").collect()}
    assert best[0, "email", "A@b.org"].mentions == 2 and (0, "email", "a@B.org") not in best
    assert (best[4, "price", "€50"].mentions, best[4, "price", "€50"].start, round(best[4, "price", "€50"].confidence, 6)) == (2, 67, 1.0)
    assert best[0, "price", "$1,200.00"].confidence > best[0, "price", "Price: 99.50"].confidence
