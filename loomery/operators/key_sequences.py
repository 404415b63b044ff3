"""Running, trailing and exponential statistics of each key in order, without a task that holds a key's whole history.

Rows are sorted into ranges by key and order, so a key may span ranges, and only the
first key of a range continues an earlier one. Statistics are taken within (range, key)
and carried over range borders: at most one carry for each range, which is broadcast.
Trailing rows are taken in slices of positions, each with the few rows before it.
Null keys are a key of their own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.functions.names import fresh
from loomery.session import durable

#: Positions in a slice, in trailing rows: one row in so many is read twice.
SLICE = 16
_FIRST = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def _ranged(df: DataFrame, key: str, order: Sequence[str], part: str) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return durable(df.repartitionByRange(parts, key, *order).withColumn(part, F.spark_partition_id()))


def _both(kind: str, carry: Column, own: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(carry + own, own, carry)
    return F.least(carry, own) if kind == "min" else F.greatest(carry, own)


def running(df: DataFrame, key: str, order: Sequence[str], values: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Add each of ``values``: sum, count, min or max of a column over the key's rows up to and with this one. ``order`` tells a key's rows apart."""
    part, *inner = fresh([*df.columns, *values], "range", *(f"in_{n}" for n in range(len(values))))
    names = dict(zip(values, inner, strict=True))
    ranged = _ranged(df.withColumns({names[into]: value for into, (_, value) in values.items()}), key, order, part)
    sums = ranged.groupBy(F.col(key).alias("carry_key"), F.col(part).alias("carry_range")).agg(*[_FIRST[kind](names[into]).alias(f"part_{n}") for n, (into, (kind, _)) in enumerate(values.items())])
    # A key's ranges are few; those that continue an earlier one are at most as many as there are ranges.
    earlier = Window.partitionBy("carry_key").orderBy("carry_range").rowsBetween(Window.unboundedPreceding, -1)
    fold = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
    carries = sums.select("carry_key", "carry_range", F.row_number().over(Window.partitionBy("carry_key").orderBy("carry_range")).alias("carry_turn"), *[fold[kind](f"part_{n}").over(earlier).alias(f"carry_{n}") for n, (kind, _) in enumerate(values.values())]).where("carry_turn > 1")
    within = Window.partitionBy(part, key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.withColumns({into: _FIRST[kind](names[into]).over(within) for into, (kind, _) in values.items()})
    met = own.join(F.broadcast(carries), (F.col(part) == F.col("carry_range")) & F.col(key).eqNullSafe(F.col("carry_key")), "left")
    whole = {into: _both(kind, F.col(f"carry_{n}"), F.col(into)) for n, (into, (kind, _)) in enumerate(values.items())}
    return met.select(*[F.col(f"`{c}`") for c in df.columns if c not in values], *[c.alias(into) for into, c in whole.items()])


def trailing(df: DataFrame, key: str, order: Sequence[str], values: Mapping[str, tuple[str, Column]], rows: int) -> DataFrame:
    """Add each of ``values``: sum, count, min or max of a column over the key's last ``rows`` rows, this one included."""
    at, part = fresh([*df.columns, *values], "at", "slice")
    placed = running(df, key, order, {at: ("count", F.lit(1))})
    size = SLICE * rows
    own = F.floor((F.col(at) - 1) / size)
    near = F.when((F.col(at) - 1) % size >= size - (rows - 1), F.array(own, own + 1)).otherwise(F.array(own))
    cut = placed.withColumn(part, F.explode(near))
    window = Window.partitionBy(key, part).orderBy(at).rowsBetween(1 - rows, 0)
    out = cut.withColumns({into: _FIRST[kind](value).over(window) for into, (kind, value) in values.items()})
    return out.where(F.col(part) == own).drop(at, part)


def exponential(df: DataFrame, key: str, order: Sequence[str], value: str, rate: float) -> DataFrame:
    """(key, ema, n): the last exponential moving average of each key; its first row seeds it.

    Each (range, key) gives its rows' weighted sum and their number m; a later range
    weighs what came before by (1 - rate)^m.
    """
    (part,) = fresh(df.columns, "range")
    ranged = _ranged(df.select(key, *[c for c in order if c != key], *([value] if value not in (key, *order) else [])), key, order, part)
    within = Window.partitionBy(part, key).orderBy(*order)
    rows = F.count("*").over(Window.partitionBy(part, key))
    ranked = ranged.select(key, part, F.col(value).cast("double").alias("v"), F.row_number().over(within).alias("at"), rows.alias("m"))
    weighed = F.sum(F.col("v") * rate * F.pow(F.lit(1 - rate), F.col("m") - F.col("at")))
    sums = ranked.groupBy(key, part).agg(weighed.alias("x"), F.max("m").alias("m"), F.max(F.when(F.col("at") == 1, F.col("v"))).alias("first"))
    steps = sums.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(part, "x", "m", "first"))).alias("steps"), F.sum("m").alias("n"))
    # The seed counts with weight 1, not rate, in the first range.
    start = F.get("steps", F.lit(0))
    seed = start["x"] + start["first"] * (1 - rate) * F.pow(F.lit(1 - rate), start["m"] - 1)
    ema = F.aggregate(F.slice("steps", F.lit(2), F.size("steps")), seed, lambda a, s: a * F.pow(F.lit(1 - rate), s["m"]) + s["x"])
    return steps.select(key, ema.alias("ema"), "n")
