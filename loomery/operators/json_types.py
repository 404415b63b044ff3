"""The structure of JSON rows: a tree of types, merged over all of them.

Values are variants, taken apart one level of nesting at a time; a level's values are
counted by path and kind with partial aggregation and never leave the cluster, only its
containers are kept for the next level. Kinds merge in a lattice: nothing is below
everything, numbers of both sorts make a number, other scalars together a string,
objects merge field by field and arrays by their elements, and containers beside others
make ``any``. Merging is a union of counts, so order and partitions don't matter.

Defined cases: null rows and text that is no JSON are counted as ``invalid`` at the
root; an empty array has no element path; a field that is null counts as present.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.session import durable

KINDS = ("null", "boolean", "integer", "number", "string", "object", "array", "invalid")


def _kind(value: Column) -> Column:
    named = F.schema_of_variant(value)
    out = F.when(value.isNull(), "invalid").when(named == "VOID", "null").when(named == "BOOLEAN", "boolean").when(named == "BIGINT", "integer")
    return out.when(named.startswith("DECIMAL") | named.isin("DOUBLE", "FLOAT"), "number").when(named.startswith("OBJECT"), "object").when(named.startswith("ARRAY"), "array").otherwise("string")


def merged(kinds: Column) -> Column:
    """The least type above all of an array of kinds."""
    known = F.array_distinct(F.filter(kinds, lambda k: ~k.isin("null", "invalid")))
    holds = lambda *names: F.forall(known, lambda k: k.isin(*names))
    out = F.when(F.size(known) == 0, "null").when(F.size(known) == 1, F.get(known, F.lit(0)))
    return out.when(holds("integer", "number"), "number").when(~F.exists(known, lambda k: k.isin("object", "array")), "string").otherwise("any")


def type_tree(rows: DataFrame, json: str, most_levels: int = 64) -> DataFrame:
    """(path, type, n, nulls, share): every path of the rows' JSON with its merged type, how often it occurs and is null, and in what share of its parents.

    ``$`` is the row, ``.name`` a field, whose parents are objects, and ``[]`` the
    elements of arrays, whose share is their number for each array. A name that holds a
    dot or brackets is written as it is.
    """
    spark = rows.sparkSession
    level = rows.select(F.lit("$").alias("path"), F.lit(None).cast("string").alias("parent"), F.try_parse_json(F.col(f"`{json}`").cast("string")).alias("value"))
    counts = []
    for _ in range(most_levels):
        kinds = durable(level.withColumn("kind", _kind(F.col("value"))))
        counts.append(kinds.groupBy("path", "parent", "kind").agg(F.count("*").alias("n")))
        held = kinds.where("kind IN ('object', 'array')")
        if held.isEmpty():
            break
        each = held.select(F.col("path").alias("above"), "kind", "value").lateralJoin(spark.tvf.variant_explode(F.col("value").outer()).toDF("at", "name", "inner"))
        step = F.when(F.col("kind") == "array", "[]").otherwise(F.concat(F.lit("."), F.col("name")))
        level = each.select(F.concat("above", step).alias("path"), F.col("above").alias("parent"), F.col("inner").alias("value"))
    else:
        raise ValueError(f"JSON nests deeper than {most_levels} levels")
    of = lambda *names: F.sum(F.when(F.col("kind").isin(*names), F.col("n")).otherwise(0))
    total = reduce(DataFrame.unionByName, counts).groupBy("path", "parent").agg(F.sort_array(F.collect_set("kind")).alias("kinds"), F.sum("n").alias("n"), of("null").alias("nulls"), of("object").alias("objects"), of("array").alias("arrays"))
    above = total.select(F.col("path").alias("parent"), F.col("objects").alias("of_objects"), F.col("arrays").alias("of_arrays"))
    share = F.col("n") / F.when(F.endswith("path", F.lit("[]")), F.col("of_arrays")).otherwise(F.col("of_objects"))
    return total.join(above, "parent", "left").select("path", merged(F.col("kinds")).alias("type"), "kinds", "n", "nulls", share.alias("share"))


def json_schema(tree: DataFrame) -> str:
    """The tree as a JSON schema. It comes to the driver: a tree has a row for each path, not for each value."""
    import json

    nodes = {r["path"]: r for r in tree.collect()}

    def build(path: str) -> dict:
        kind = nodes[path]["type"]
        out: dict = {} if kind == "any" else {"type": kind}
        if kind == "object":
            inner = {p[len(path) + 1 :]: p for p in sorted(nodes) if p.startswith(path + ".") and "." not in p[len(path) + 1 :] and "[]" not in p[len(path) + 1 :]}
            out["properties"] = {name: build(p) for name, p in inner.items()}
            out["required"] = [name for name, p in inner.items() if nodes[p]["share"] == 1]
        if kind == "array" and path + "[]" in nodes:
            out["items"] = build(path + "[]")
        return out

    return json.dumps(build("$"), sort_keys=True) if nodes else "{}"
