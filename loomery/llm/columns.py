"""Column helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.session import importable


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    Filters that the optimizer moves below a projection carry copies of its
    expressions; inside a lambda such a copy would be computed for every element.
    """
    return F.get(F.transform(F.array(value), body), 0)


def named(column: str, *names: str) -> bool:
    """Whether ``column`` is one of ``names`` to Spark, which ignores the case of letters."""
    return column.lower() in {n.lower() for n in names}


def fresh(columns: Iterable[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that clash with none of ``columns``, whatever the case of letters."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def map_texts(docs: DataFrame, keep: list[str], text: str, new: dict[str, str], run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``docs`` by Arrow batches: ``run`` gets the kept columns and, last, the text, and returns the kept columns and the ``new`` ones.

    All columns travel under names by position (``kept_0``, ..., ``new_0``, ...), so that
    no name can clash or be read as a path to a field.
    """
    importable(docs.sparkSession)
    places = [f"kept_{n}" for n in range(len(keep))]
    given = docs.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(keep, places, strict=True)], F.col(f"`{text}`").cast("string").alias("kept_text"))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields[:-1]), *(f"new_{n} {kind}" for n, kind in enumerate(new.values()))])
    return given.mapInArrow(run, schema).toDF(*keep, *new)
