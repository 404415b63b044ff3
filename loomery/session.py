"""Session helpers shared by every part of the library."""

from __future__ import annotations

import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("loomery")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


#: Bytes of an Arrow batch at most. A worker holds a batch several times over (Arrow, Python strings, results).
BATCH_BYTES = 4 << 20
#: Spark's own default for them, which counts as not set.
SPARK_BATCH_BYTES = f"{64 << 20}b"


def importable(spark: SparkSession) -> None:
    """Ready Python workers: they can import this package from where the driver has it, and get batches bounded in bytes.

    Rows alone don't bound a batch of texts; a bound that the user has set stays.
    """
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound) == SPARK_BATCH_BYTES:
        spark.conf.set(bound, f"{BATCH_BYTES}b")
    root, given = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    known = [given.get("PYTHONPATH", ""), os.environ.get("PYTHONPATH", "")]
    if root not in os.pathsep.join(known).split(os.pathsep):
        given["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known[0]]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate copies: ``spark.checkpoint.dir``, or a temporary one where that is unset and everything runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="loomery-")
    return folder.rstrip("/")


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a written copy that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner find shuffle files and checkpoints that nothing refers to any more.

    It acts when the driver collects garbage, which a driver that does little may not
    do for half an hour; jobs of many rounds call this between them.
    """
    spark._jvm.System.gc()


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's checkpoint folder and cut its lineage.

    The copy survives lost executors, and Spark's cleaner removes it once nothing
    refers to it.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
