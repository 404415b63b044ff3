"""Stored pages as a table of elements, and selection by paths as joins on it.

``element_table`` reads each page once, where it lies, in Arrow batches. An element
is a row with its number in document order (``pre``) and that of the last element
inside it (``last``), so ancestors and descendants are intervals. The page's text is
kept once, in the page's own row; elements hold offsets into it. Everything else is
relational: a step of a path is an equi-join on the page and its axis, and descendants
meet their contexts in blocks of numbers, so that a large page is many groups.

Defined cases: a null or empty page has only its own row; rows that repeat a key are
read as pages of that key, so keys have to be unique; other columns are not kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.functions.markup import FIELDS, stream_markup
from loomery.session import durable, importable

#: Elements of a page that descendants are joined in at a time.
BLOCK = 1024
#: Elements that a worker holds at a time; a page may have millions.
CHUNK = 4096
_KINDS = {"tag": "string", "attributes": "map<string,string>"}
#: What a step needs to know of an element.
PLACE = ("pre", "last", "parent", "pos")


def element_table(pages: DataFrame, key: str, html: str = "html", keep: bool = True) -> DataFrame:
    """(key, the fields of ``FIELDS``, classes, text, solid): all elements of all pages.

    The table is kept in the cluster's folder, as selections read it many times; without
    ``keep`` every use reads the pages again.

    ``text`` and ``solid`` are set in a page's own row (pre 0, tag ``#page``); ``solid``
    has the white space around every run of characters taken off.
    """
    importable(pages.sparkSession)
    given = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{html}`").cast("string").alias("html"))
    kind = given.schema["key"].dataType.simpleString()
    schema = ", ".join([f"key {kind}", *(f"{f} {_KINDS.get(f, 'int')}" for f in FIELDS), "text string", "solid string"])
    types = {"tag": pa.string(), "attributes": pa.map_(pa.string(), pa.string()), "text": pa.string(), "solid": pa.string()}
    names = [*FIELDS, "text", "solid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Small pages share a chunk, a large one fills many.
            elements = ((n, *x) for n, source in enumerate(batch.column(1)) for x in stream_markup(source.as_py() or ""))
            while rows := list(islice(elements, CHUNK)):
                at, *values = zip(*rows, strict=True)
                columns = [pa.array(x, types.get(f, pa.int32())) for f, x in zip(names, values, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *columns], names=["key", *names])

    found = given.mapInArrow(run, schema)
    classes = F.filter(F.split(F.coalesce(F.col("attributes")["class"], F.lit("")), r"\s+"), lambda c: c != "")
    out = found.withColumn("classes", classes).withColumnRenamed("key", key)
    # Sizes are guessed from the files that pages come from, which may be a small part of
    # their elements: no join takes elements for a table to broadcast.
    return (durable(out) if keep else out).hint("merge")


@dataclass(frozen=True)
class Step:
    """One step of a path: an axis, a tag (``*`` for any), tests of attributes, and a place among siblings (0 for the last)."""

    axis: str
    tag: str = "*"
    tests: tuple[tuple[str, str, str | None], ...] = ()
    place: int | None = None


_AXES = {"": "child", "child::": "child", "descendant::": "descendant", "following-sibling::": "following", "parent::": "parent", "ancestor::": "ancestor"}
_STEP = re.compile(r"(//|/|^)\s*(?:(\.\.?)|(child::|descendant::|following-sibling::|parent::|ancestor::)?(\*|[a-zA-Z][\w-]*)((?:\[[^\]]*\])*))")
_TEST = re.compile(r"""@([\w:-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'))?$|(contains|starts-with)\(\s*@([\w:-]+)\s*,\s*(?:"([^"]*)"|'([^']*)')\s*\)$""")


def path(text: str) -> list[Step]:
    """The steps of a path such as ``//ul[@class='list']/li[2]//a[contains(@href, 'x')]``; ``.`` and ``..`` and five named axes are known."""
    steps, at = [], 0
    while at < len(text):
        found = _STEP.match(text, at) if at == 0 or text[at] == "/" else None
        if not found:
            raise ValueError(f"cannot read {text[at:]!r} of path {text!r}")
        at = found.end()
        deep, dots, axis, tag, tests = found.groups()
        if dots:
            if dots == "..":
                steps.append(Step("parent"))
            continue
        kind = _AXES[axis or ""]
        if deep == "//":
            if kind != "child":
                raise ValueError(f"no axis may follow // in {text!r}")
            kind = "descendant"
        known, place = [], None
        for test in re.findall(r"\[([^\]]*)\]", tests):
            if test.strip() == "last()" or test.strip().isdigit():
                if known or place is not None or kind not in ("child", "descendant"):
                    raise ValueError(f"a place has to come first, on a child, in {text!r}")
                place = 0 if test.strip() == "last()" else int(test)
                continue
            m = _TEST.match(test.strip())
            if not m:
                raise ValueError(f"cannot read test {test!r} of path {text!r}")
            known.append((m[4], m[5], m[6] or m[7] or "") if m[4] else ("=", m[1], next((v for v in (m[2], m[3]) if v is not None), None)))
        steps.append(Step(kind, tag.lower(), tuple(known), place))
    return steps


def _fits(step: Step) -> Column:
    out = F.col("tag") != "#page" if step.tag == "*" else F.col("tag") == step.tag
    for kind, name, value in step.tests:
        held = F.col("attributes")[name]
        if value is None:
            out &= held.isNotNull()
        else:
            out &= {"=": held == value, "contains": held.contains(value), "starts-with": held.startswith(value)}[kind]
    if step.place:
        out &= F.col("pos" if step.tag == "*" else "nth") == step.place
    return out


def _last_of_kind(nodes: DataFrame, key: str, tag: str) -> DataFrame:
    kinds = nodes.where("tag <> '#page'" if tag == "*" else F.col("tag") == tag)
    return kinds.groupBy(key, "parent").agg(F.max("pos").alias("pos"))


def descendants(contexts: DataFrame, nodes: DataFrame, key: str, first: str = "c_pre", last: str = "c_last") -> DataFrame:
    """Pairs of a context and an element inside it. Both meet in blocks of element numbers; a pair meets in one block."""
    inside = contexts.where(F.col(last) > F.col(first)).withColumn("block", F.explode(F.sequence(F.floor((F.col(first) + 1) / BLOCK), F.floor(F.col(last) / BLOCK))))
    met = inside.join(nodes.withColumn("block", F.floor(F.col("pre") / BLOCK)), [key, "block"])
    return met.where((F.col("pre") > F.col(first)) & (F.col("pre") <= F.col(last))).drop("block")


def select(nodes: DataFrame, key: str, steps: str | Sequence[Step], origins: DataFrame | None = None) -> DataFrame:
    """Elements that a path leads to, with ``origin``, the number of the element it starts from; each once for an origin.

    ``origins`` has the columns of ``nodes``; without it, or where the path begins with a
    slash, the path starts from the page.
    """
    if isinstance(steps, str):
        origins = None if steps.startswith("/") else origins
        steps = path(steps)
    start = nodes.where("pre = 0") if origins is None else origins
    here = start.select(key, F.col("pre").alias("origin"), *[F.col(c).alias(f"c_{c}") for c in PLACE])
    for step in steps:
        able = nodes.where(_fits(step))
        if step.place == 0:
            able = able.join(_last_of_kind(nodes, key, step.tag), [key, "parent", "pos"], "left_semi")
        able = able.select(key, *PLACE)
        # Equal names only in using-joins: both sides may stem from one table.
        if step.axis == "child":
            met = here.withColumn("parent", F.col("c_pre")).join(able, [key, "parent"])
        elif step.axis == "descendant":
            met = descendants(here, able, key)
        elif step.axis == "parent":
            met = here.withColumn("pre", F.col("c_parent")).join(able, [key, "pre"])
        elif step.axis == "following":
            met = here.withColumn("parent", F.col("c_parent")).join(able, [key, "parent"]).where("pos > c_pos")
        else:
            up = able.toDF(key, *(f"a_{c}" for c in PLACE))
            met = descendants(up, here.withColumnRenamed("c_pre", "pre"), key, "a_pre", "a_last").select(key, "origin", *[F.col(f"a_{c}").alias(c) for c in PLACE])
        here = met.select(key, "origin", *[F.col(c).alias(f"c_{c}") for c in PLACE])
        if step.axis != "child":
            here = here.distinct()
    found = here.select(F.col(key), "origin", F.col("c_pre").alias("pre"))
    return found.join(nodes, [key, "pre"])


def stripped(text: Column, first: Column, last: Column) -> Column:
    """A piece of a text without white space around it."""
    return F.regexp_replace(F.substr(text, first + 1, last - first), r"^\s+|\s+$", "")


def with_text(rows: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Add ``text`` (of the whole element, trimmed) and ``solid`` to elements."""
    whole = nodes.where("pre = 0").select(key, F.col("text").alias("page_text"), F.col("solid").alias("page_solid"))
    out = rows.drop("text", "solid").join(whole, key)
    out = out.withColumn("text", stripped(F.col("page_text"), F.col("text_from"), F.col("text_to")))
    return out.withColumn("solid", F.substr("page_solid", F.col("solid_from") + 1, F.col("solid_to") - F.col("solid_from"))).drop("page_text", "page_solid")


@dataclass(frozen=True)
class PathField:
    """A field of a schema: its path from the item, and what is taken: text, html or an attribute's value."""

    name: str
    path: str
    take: str = "text"
    attribute: str = ""


def extract_by_paths(pages: DataFrame, key: str, base: str, fields: Sequence[PathField], html: str = "html") -> DataFrame:
    """(key, item, one column for each field, confidence): the schema's records of every page.

    Items are the elements of the ``base`` path in document order, or the page where
    there are none; a field is the first element of its path that gives a value at all;
    items without any value are left out.
    """
    nodes = element_table(pages, key, html)
    items = select(nodes, key, base).drop("origin")
    bare = nodes.where("pre = 0").join(items.select(key).distinct(), key, "left_anti")
    origins = items.select(*nodes.columns).unionByName(bare)
    hits = []
    for number, f in enumerate(fields):
        first = select(nodes, key, f.path, origins).groupBy(key, "origin").agg(F.min_by(F.struct("text_from", "text_to", "source_from", "source_to", "attributes"), "pre").alias("x"))
        hits.append(first.select(key, "origin", F.lit(number).alias("field"), "x.*"))
    whole = nodes.where("pre = 0").select(key, F.col("text").alias("page_text"))
    sources = pages.select(key, F.col(f"`{html}`").alias("page_source"))
    found = reduce(DataFrame.unionByName, hits).join(whole, key).join(sources, key)
    value = F.lit(None).cast("string")
    for number, f in enumerate(fields):
        taken = {
            "text": stripped(F.col("page_text"), F.col("text_from"), F.col("text_to")),
            "html": F.substr("page_source", F.col("source_from") + 1, F.col("source_to") - F.col("source_from")),
            "attribute": F.col("attributes")[f.attribute],
        }[f.take]
        value = F.when(F.col("field") == number, taken).otherwise(value)
    known = found.withColumn("value", value).where("value <> ''")
    wide = known.groupBy(key, "origin").agg(*[F.max(F.when(F.col("field") == n, F.col("value"))).alias(f.name) for n, f in enumerate(fields)])
    page = Window.partitionBy(key)
    counted = wide.withColumn("item", F.row_number().over(page.orderBy("origin")) - 1)
    confidence = path_confidence([F.col(f"`{f.name}`") for f in fields], F.count("*").over(page))
    return counted.withColumn("confidence", confidence).select(key, "item", *[f"`{f.name}`" for f in fields], "confidence")


def path_confidence(values: Sequence[Column], items: Column) -> Column:
    """Of one item: the share of its fields and up to two rich ones; several items count as one rich field."""
    present = sum((v.isNotNull().cast("int") for v in values), F.lit(0))
    rich = sum((F.coalesce(F.length(v) > 10, F.lit(False)).cast("int") for v in values), F.lit(0))
    several = F.lit(0.3 + 0.6 / max(1, len(values)) + 0.05)
    one = 0.3 + 0.6 * present / max(1, len(values)) + F.least(0.05 * rich, F.lit(0.1))
    return F.least(F.when(items == 1, one).otherwise(several), F.lit(1.0))


def path_readiness(pages: DataFrame, key: str, base: str, fields: Sequence[PathField], html: str = "html") -> DataFrame:
    """(key, confidence): how far a schema fits a page, from its first item and first three fields."""
    nodes = element_table(pages, key, html)
    first = select(nodes, key, base).groupBy(key).agg(F.min("pre").alias("pre")).join(nodes, [key, "pre"]).select(*nodes.columns)
    works = [select(nodes, key, f.path, first).select(key, F.lit(n).alias("field")) for n, f in enumerate(fields[:3])]
    working = reduce(DataFrame.unionByName, works).groupBy(key).agg(F.countDistinct("field").alias("n"))
    known = first.select(key, F.lit(True).alias("based")).join(working, key, "left")
    score = F.when(F.col("n") > 0, 0.7 + F.col("n") * 0.1).when(F.col("based"), 0.4).otherwise(0.2)
    return pages.select(key).join(known, key, "left").select(key, score.alias("confidence"))


def css_selector() -> Column:
    """Tag with its id, else with its classes."""
    ident = F.col("attributes")["id"]
    return F.when(F.length(ident) > 0, F.concat("tag", F.lit("#"), ident)).otherwise(F.concat(F.col("tag"), F.array_join(F.transform("classes", lambda c: F.concat(F.lit("."), c)), "")))


def absolute_paths(rows: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """(key, pre, path): the path of tags from the page to each element, with a place where its parent holds several of its tag."""
    kinds = nodes.where("tag <> '#page'").groupBy(key, "parent", "tag").agg(F.count("*").alias("n"))
    ancestors = descendants(nodes.where("tag <> '#page'").select(key, F.col("pre").alias("a_pre"), F.col("last").alias("a_last"), "parent", "tag", "nth"), rows.select(key, "pre"), key, "a_pre", "a_last")
    own = nodes.join(rows.select(key, "pre"), [key, "pre"], "left_semi").where("tag <> '#page'").select(key, "pre", F.col("pre").alias("a_pre"), "parent", "tag", "nth")
    all_of = ancestors.select(key, "pre", "a_pre", "parent", "tag", "nth").unionByName(own).join(kinds, [key, "parent", "tag"])
    part = F.concat(F.lit("/"), F.col("tag"), F.when(F.col("n") > 1, F.concat(F.lit("["), F.col("nth"), F.lit("]"))).otherwise(""))
    steps = all_of.groupBy(key, "pre").agg(F.array_sort(F.collect_list(F.struct("a_pre", part.alias("part")))).alias("steps"))
    return steps.select(key, "pre", F.array_join(F.transform("steps", lambda s: s["part"]), "").alias("path"))


def class_texts(nodes: DataFrame, key: str, wanted: Mapping[str, Sequence[str]]) -> DataFrame:
    """(key, field, pre, text): whole texts of the elements that have a class of a field, in any nesting; empty ones are left out."""
    fields = F.array_compact(F.array(*[F.when(F.arrays_overlap("classes", F.array(*map(F.lit, names))), F.lit(field)) for field, names in wanted.items()]))
    rows = with_text(nodes.withColumn("fields", fields).where("size(fields) > 0"), nodes, key)
    return rows.where("text <> ''").select(key, F.explode("fields").alias("field"), "pre", "text")


def parts_inside(nodes: DataFrame, contexts: DataFrame, key: str, marks: Mapping[str, Column]) -> DataFrame:
    """(key, c_pre, and for each mark its first element's number and n_mark, how many there are): what lies inside each context."""
    flags = nodes.select(key, "pre", *[m.alias(name) for name, m in marks.items()])
    flags = flags.where(reduce(lambda a, b: a | b, (F.col(name) for name in marks)))
    met = descendants(contexts.select(key, F.col("pre").alias("c_pre"), F.col("last").alias("c_last")).distinct(), flags, key)
    sums = [x for name in marks for x in (F.min(F.when(F.col(name), F.col("pre"))).alias(name), F.count_if(name).alias(f"n_{name}"))]
    return met.groupBy(key, "c_pre").agg(*sums)
