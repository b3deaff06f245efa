"""Reading the parquet tables and small helpers on their columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def spread(rows: DataFrame) -> DataFrame:
    """The rows in as many partitions as there are cores, for work that is heavy beside its input; what is read in a partition a core anyhow stays as it is.

    Scans are cut into parts of at least spark.sql.files.openCostInBytes until there is one a core, so the size of what is read tells; nothing runs.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return rows.repartition(cores) if size < cores * spark._jsparkSession.sessionState().conf().filesOpenCostInBytes() else rows
