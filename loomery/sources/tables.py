"""Readers and writers: record tables in any Spark format, HTML pages, and fan-out sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.functions import text as tx
from loomery.functions import urls


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """A table in parquet, orc, json, csv or text; CSV and JSON need a schema, so nothing is inferred."""
    if kind in ("csv", "json") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def page_records(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """One record per stored page: url, title, text, absolute distinct links, success."""
    found = F.transform(F.array_distinct(tx.hrefs(F.col(html))), lambda h: urls.normalize_link(urls.resolve_link(F.col(url), h)))
    links = F.array_distinct(F.filter(found, lambda x: x.rlike("^https?://")))
    return pages.select(url, tx.title(F.col(html)).alias("title"), tx.without_scripts(F.col(html)).alias("text"), links.alias("links"), F.col(html).isNotNull().alias("success"))


def standardise(records: DataFrame, url: str, strategy: str, success: str, data: Sequence[str]) -> DataFrame:
    """Records in the common envelope: url, strategy, success, data (JSON)."""
    return records.select(F.col(url).alias("url"), F.col(strategy).alias("strategy"), F.col(success).alias("success"), F.to_json(F.struct(*data)).alias("data"))


def monthly(records: DataFrame, ts: str) -> DataFrame:
    """Add ``month`` as YYYY_MM, for a sink partitioned by month."""
    return records.withColumn("month", F.date_format(ts, "yyyy_MM"))


def write(records: DataFrame, path: str, kind: str = "parquet", by: Sequence[str] = (), mode: str = "append") -> None:
    writer = records.write.format(kind).mode(mode)
    (writer.partitionBy(*by) if by else writer).save(path)


def upsert(current: DataFrame, changes: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """``current`` with ``changes`` merged in: for each key the row with the latest ``order`` stays."""
    columns = current.columns
    both = current.unionByName(changes.select(*columns))
    value = F.struct(*[F.col(c) for c in columns])
    return both.groupBy(*key).agg(F.max_by(value, F.col(order)).alias("row")).select("row.*")


def insert_if_absent(current: DataFrame, changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """``current`` plus the changes whose key it lacks."""
    return current.unionByName(changes.join(current.select(*key), list(key), "left_anti").dropDuplicates(list(key)).select(*current.columns))


def fan_out(stream: DataFrame, sinks: Sequence[Callable[[DataFrame, int], None]], checkpoint: str):
    """Start a streaming query that hands every micro-batch to all sinks."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        for sink in sinks:
            sink(batch, epoch)
        batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
