"""Streaming queries: the tables are read as streams of files up to what is there, and compared with batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.session import checkpoint_dir
from aerolith.sources.tables import table
from aerolith.streaming import live


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    return live.files(spark, f"{d}/{name}.parquet*", table(spark, d, name).schema)


def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """Messages per day and label, from a stream with a watermark."""
    at = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    counted = live.windowed_counts(_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"])
    name = f"counts_{uuid.uuid4().hex}"
    query = counted.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", at).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def stream_fold_state(spark: SparkSession, d: str) -> DataFrame:
    """The state of each aircraft after a stream of its updates."""
    at = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    sink = live.folding(f"{at}/state", ["icao_hex"], ["update_id"], texts=["origin", "destination"], numbers=["altitude", "ground_speed"], seen="update_id")
    query = _stream(spark, d, "flight_updates").writeStream.foreachBatch(sink).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return live.state(spark, f"{at}/state")


QUERIES = {"stream_counts": stream_counts, "stream_fold_state": stream_fold_state}
LAST = "arg_max({0}, CASE WHEN {0} IS NOT NULL THEN update_id END) AS {0}"
SQL = {
    "stream_counts": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_fold_state": "SELECT icao_hex, " + ", ".join(LAST.format(c) for c in ("origin", "destination", "altitude", "ground_speed")) + ", count(*) AS msg_count, min(update_id) AS first_seen, max(update_id) AS last_seen FROM flight_updates WHERE icao_hex <> '' GROUP BY 1",
}
