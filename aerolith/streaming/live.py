"""Structured Streaming: messages decoded as they arrive, counts by day, and state folded batch by batch.

Each micro-batch is folded by key before it meets the older state, so the work of a
batch follows the batch. The state is a table of versions, one a batch id: a batch
that is run again after a failure rewrites its own version from the one before, so
counters never count twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from aerolith.operators import folds


def files(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 1000, fmt: str = "parquet") -> DataFrame:
    """An unbounded table over the files of a folder, each new file read once."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)


def windowed_counts(stream: DataFrame, at: str, keys: list[str], width: str = "1 day", late: str = "7 days") -> DataFrame:
    """Counts per window and key; rows later than the watermark are dropped by it."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def deduplicated(stream: DataFrame, id_col: str, at: str, late: str = "7 days") -> DataFrame:
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([id_col])


def _version(path: str, batch: int) -> str:
    return f"{path}/version={batch:012d}"


def latest_version(spark: SparkSession, path: str, before: int | None = None) -> int | None:
    """The newest finished version, below a batch if one is given."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(hadoop):
        return None
    found = []
    for status in system.listStatus(hadoop):
        folder = status.getPath()
        name = folder.getName()
        if name.startswith("version=") and system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")):
            found.append(int(name.partition("=")[2]))
    return max((v for v in found if before is None or v < before), default=None)


def folding(path: str, keys: list[str], order: list[str], **columns) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the folded state of all batches so far at `path`."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        made = folds.fold(batch, keys, order, **columns)
        before = latest_version(spark, path, batch_id)
        if before is not None:
            merged = {k: v for k, v in columns.items() if k != "seen"}
            made = folds.merge(spark.read.parquet(_version(path, before)), made, keys, **merged)
        made.write.mode("overwrite").parquet(_version(path, batch_id))

    return sink


def state(spark: SparkSession, path: str) -> DataFrame:
    """The folded state after the last batch."""
    return spark.read.parquet(_version(path, latest_version(spark, path)))
