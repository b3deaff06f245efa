"""Rows in order within a key, cut into blocks of bounded size that know their neighbours.

A key may hold a large part of all rows. Ranks are found from counts of coarse
buckets of the order column and from row numbers inside a bucket, so no key comes
together in one task; only bucket counts are summed over a whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blocks(rows: DataFrame, key: str, order: list[str], bucket: Column, size: int, halo: int) -> DataFrame:
    """The rows with rank (from 0 within the key), block and is_core; halo rows of the next blocks on both sides are repeated in each block.

    `bucket` must not decrease along `order`; `size` is the number of own rows a block has at most.
    """
    marked = rows.withColumn("__bucket", bucket)
    counts = marked.groupBy(key, "__bucket").agg(F.count("*").alias("__n"))
    along = Window.partitionBy(key).orderBy("__bucket")
    offsets = counts.select(
        key,
        "__bucket",
        F.coalesce(F.sum("__n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__n").over(Window.partitionBy(key)).alias("__total"),
    )
    inside = Window.partitionBy(key, "__bucket").orderBy(*order)
    ranked = marked.join(offsets, [key, "__bucket"]).withColumn("rank", F.col("__before") + F.row_number().over(inside) - 1)
    n_blocks = F.ceil(F.col("__total") / F.lit(size))
    own = F.floor(F.col("rank") * n_blocks / F.col("__total")).cast("bigint")
    first = lambda b: F.ceil(b * F.col("__total") / n_blocks)
    near = F.array(
        F.col("__own"),
        F.when((F.col("__own") > 0) & (F.col("rank") < first(F.col("__own")) + halo), F.col("__own") - 1),
        F.when((F.col("__own") < n_blocks - 1) & (F.col("rank") >= first(F.col("__own") + 1) - halo), F.col("__own") + 1),
    )
    spread = ranked.withColumn("__own", own).withColumn("block", F.explode(F.array_compact(near)) if halo else F.col("__own"))
    return spread.withColumn("is_core", F.col("block") == F.col("__own")).drop("__bucket", "__before", "__total", "__own")
