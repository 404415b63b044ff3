"""Ranks and running totals over a whole table, without one task that sees all of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.functions.names import fresh
from loomery.session import durable


def running_totals(df: DataFrame, order: Sequence[str], amount: str, into: str = "before") -> DataFrame:
    """Add ``into``: the sum of ``amount`` over all rows that sort before this one.

    ``order`` has to tell all rows apart. Sorted ranges are summed apart, and the sums
    before each range, one row for each, are added to the totals within it.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, start = fresh([*df.columns, into], "range", "start")
    ranged = durable(df.repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id()))
    sums = ranged.groupBy(part).agg(F.sum(amount).alias("sum"))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(part, F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias(start))
    within = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumn(into, F.coalesce(F.sum(amount).over(within), F.lit(0)))
    return own.join(F.broadcast(starts), part).withColumn(into, F.col(into) + F.col(start)).drop(part, start)


def positions(df: DataFrame, order: Sequence[str], into: str = "position") -> DataFrame:
    """Add ``into``: 0 for the first row by ``order``, which has to tell all rows apart, and so on."""
    (one,) = fresh([*df.columns, into], "one")
    return running_totals(df.withColumn(one, F.lit(1).cast("long")), order, one, into).drop(one)


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, median) of numeric columns, exact: values are counted first, then summed in sorted ranges.

    A column without values has no row.
    """
    values = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value")) for c in columns])
    counts = df.select(F.explode(values).alias("x")).select("x.*").where("value IS NOT NULL").groupBy("field", "value").agg(F.count("*").alias("n"))
    placed = running_totals(counts, ["field", "value"], "n")
    fields = placed.groupBy("field").agg(F.min("before").alias("first"), F.sum("n").alias("total"))
    middle = placed.join(F.broadcast(fields), "field").where("before <= first + total div 2 AND before + n > first + (total - 1) div 2")
    return middle.groupBy("field").agg(((F.min("value") + F.max("value")) / 2).alias("median"))
