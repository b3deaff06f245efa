"""The queries of the general data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.operators import drift, instants, once, shred, spikes, stays
from aerolith.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.flagged(table(spark, d, "flight_updates"), table(spark, d, "messages"), table(spark, d, "aircraft"))


def _nested(spark: SparkSession, d: str) -> DataFrame:
    wrappers = table(spark, d, "feed_records").where("record_kind = 'wrapper'").select(F.lit("feed_records").alias("owner"), F.col("record_id").alias("owner_id"), F.col("payload").alias("text"))
    parsed = table(spark, d, "messages").select(F.lit("messages").alias("owner"), F.col("delivery_id").alias("owner_id"), F.col("parsed_json").alias("text"))
    return wrappers.unionByName(parsed)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = shred.nodes(_nested(spark, d), "owner_id", "text", "owner", attributes=False)
    return found.where("NOT is_empty AND parent_label IS NOT NULL").select("owner", "owner_id", "node_path")


def p2_waypoints(spark: SparkSession, d: str) -> DataFrame:
    every = shred.nodes(_nested(spark, d), "owner_id", "text", "owner")
    return shred.table_of(every, "waypoints", {"name": "string", "latitude": "double", "longitude": "double"})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return once.repeats(table(spark, d, "messages"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(drift.profiles(table(spark, d, "feed_records"))).drop("file_seq")


def p4_unified(spark: SparkSession, d: str) -> DataFrame:
    return drift.unified(table(spark, d, "feed_records"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return instants.instants(table(spark, d, "inbound_messages"), table(spark, d, "stations"), table(spark, d, "airports"))


def p6_stays(spark: SparkSession, d: str) -> DataFrame:
    return stays.stays(table(spark, d, "flight_updates"), table(spark, d, "messages"), table(spark, d, "aircraft"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_stays(spark, d).select("icao_hex", "kind", "first_message_id", "last_message_id")


QUERIES = {"p5_found": p5_found, "p1_found": p1_found, "p6_found": p6_found, "p6_stays": p6_stays, "p2_found": p2_found, "p2_waypoints": p2_waypoints, "p3_found": p3_found, "p4_found": p4_found, "p4_unified": p4_unified}
SQL: dict[str, str] = {
    "p3_found": """
SELECT delivery_id FROM (SELECT delivery_id, row_number() OVER (
  PARTITION BY CASE WHEN id <> 0 THEN id END, CASE WHEN coalesce(id, 0) = 0 THEN "timestamp" END, CASE WHEN coalesce(id, 0) = 0 THEN raw_text END, coalesce(id, 0) = 0
  ORDER BY created_at NULLS LAST, delivery_id) AS n FROM messages) WHERE n > 1""",
}
