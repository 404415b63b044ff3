"""Vector lookup with conditions on metadata: an inverted file of cells, probed by query, with an exact way.

Centroids are fitted on a bounded sample; every vector is indexed, in the cell of its
nearest centroid. A query looks into its nearest cells, among rows that pass the
condition and agree with it on the given columns; both are part of the join and of the
scan, before any similarity. A query that finds fewer rows than it asked for looks into
all other cells as well, so conditions that few rows pass are answered exactly. The
exact way, by parameter, probes all cells.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.session import durable

#: Rows that one query compares with in a task at most share one of so many parts of a cell.
PARTS = 16


def _unit(vector: str) -> Column:
    values = F.transform(vector, lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(values, lambda x: x / size)


def _product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


@dataclass
class CellIndex:
    """``rows``: the vectors with ``cell`` and ``unit``; ``centroids``: unit vectors by cell."""

    rows: DataFrame
    centroids: list[list[float]]
    key: str

    def cells(self, unit: Column) -> Column:
        """Cells by falling similarity to a unit vector."""
        near = F.array(*[F.struct(_product(unit, F.array(*map(F.lit, c))).alias("near"), F.lit(-n).alias("cell")) for n, c in enumerate(self.centroids)])
        return F.transform(F.sort_array(near, asc=False), lambda x: -x["cell"])


def build_index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cells: int = 16, sample: int = 20_000, seed: int = 1) -> CellIndex:
    """Index all rows that have a direction. About ``sample`` rows fit the ``cells`` centroids; both bound what the driver holds."""
    units = vectors.where(F.exists(vector, lambda x: x != 0)).withColumn("unit", _unit(vector))
    rate = min(1.0, sample / max(1, units.count()))
    chosen = units.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < rate * 1_000_000).select(array_to_vector("unit").alias("features"))
    fitted = KMeans(k=cells, seed=seed, distanceMeasure="cosine").fit(chosen).clusterCenters() if not chosen.isEmpty() else []
    centroids = [[float(x) for x in c] for c in fitted]
    index = CellIndex(units, centroids, key)
    cell = F.get(index.cells(F.col("unit")), F.lit(0)) if centroids else F.lit(0)
    index.rows = durable(units.withColumn("cell", cell))
    return index


def _met(index: CellIndex, asked: DataFrame, where: Column, match: Sequence[str], k: int) -> DataFrame:
    """The k best of each (query, cell) in ``asked``; a cell's rows are dealt to parts, and each keeps its own best first."""
    rows = index.rows.where(where).select(F.col(index.key).alias("found"), "cell", "unit", *match).withColumn("part", F.pmod(F.xxhash64("found"), F.lit(PARTS)))
    sent = asked.withColumn("part", F.explode(F.array(*map(F.lit, range(PARTS)))))
    pairs = sent.join(rows, ["cell", "part", *match]).select("query", "part", "found", F.round(_product(F.col("q_unit"), F.col("unit")), 12).alias("similarity"))
    own = F.row_number().over(Window.partitionBy("query", "part").orderBy(F.desc("similarity"), "found"))
    return pairs.withColumn("at", own).where(F.col("at") <= k).drop("part", "at")


def search(index: CellIndex, queries: DataFrame, k: int, where: Column | None = None, match: Sequence[str] = (), vector: str = "embedding", probes: int = 4, exact: bool = False) -> DataFrame:
    """(query, key, similarity, place): the k rows nearest to each query by cosine, of those that pass ``where`` and agree with the query on ``match``; ties by key."""
    passes = F.lit(True) if where is None else where
    asked = queries.where(F.exists(vector, lambda x: x != 0)).select(F.col(index.key).alias("query"), _unit(vector).alias("q_unit"), *match)
    order = index.cells(F.col("q_unit")) if index.centroids else F.array(F.lit(0))
    ranked = asked.select("query", "q_unit", *match, F.posexplode(order).alias("turn", "cell"))
    first = ranked if exact else ranked.where(F.col("turn") < probes)
    found = _met(index, first.drop("turn"), passes, match, k)
    if not exact:
        found = durable(found)
        enough = found.groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") >= k)
        late = ranked.where(F.col("turn") >= probes).join(enough, "query", "left_anti").drop("turn")
        found = found.unionByName(_met(index, late, passes, match, k))
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "found"))
    return found.withColumn("place", best).where(F.col("place") <= k).select("query", F.col("found").alias(index.key), "similarity", "place")


def learned_selectors(found: DataFrame, index: CellIndex, selectors: str, most: int = 10) -> DataFrame:
    """(query, selectors): the different selectors of the rows that a lookup found, nearest rows first, ``most`` at most."""
    held = found.join(index.rows.select(index.key, F.posexplode(selectors).alias("at", "selector")), index.key)
    first = held.groupBy("query", "selector").agg(F.min(F.struct("place", "at")).alias("first"))
    return first.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("first", "selector"))), 1, most).alias("x")).select("query", F.transform("x", lambda s: s["selector"]).alias("selectors"))


def similar_patterns(near: DataFrame, alike: DataFrame, patterns: DataFrame, pattern: str, k: int = 5, near_least: float = 0.7, alike_least: float = 0.6, samples: int = 3, days: int = 30) -> DataFrame:
    """(query, pattern, by, place): patterns near by vector (query, pattern, similarity), and those alike by features (query, pattern, similarity) that are seen often and lately enough.

    Sorted by success rate, confidence and samples (``success_rate``, ``avg_confidence``,
    ``sample_count``, ``age_days`` of ``patterns``); one found both ways stands twice.
    """
    fresh = patterns.where((F.col("sample_count") >= samples) & (F.col("age_days") <= days)).select(pattern)
    both = near.where(F.col("similarity") > near_least).select("query", pattern, F.lit("vector").alias("by"))
    both = both.unionByName(alike.where(F.col("similarity") > alike_least).join(fresh, pattern, "left_semi").select("query", pattern, F.lit("features").alias("by")))
    ranked = both.join(patterns.select(pattern, "success_rate", "avg_confidence", "sample_count"), pattern)
    order = Window.partitionBy("query").orderBy(F.desc("success_rate"), F.desc("avg_confidence"), F.desc("sample_count"), pattern, F.desc("by"))
    return ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query", pattern, "by", "place")
