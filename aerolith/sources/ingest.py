"""Messages from JSON lines: flat ones and ones wrapped by the message bus, with one schema for both.

Ids may be numbers or texts; an id that is no number counts as 0, as does a missing
one. Lines that are no valid JSON, and wrappers without a message, give no message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PLANE = "struct<id: string, tail: string, icao: string, iata: string, manufacturer: string, manufacturer_model: string, military: boolean>"
_FLIGHT = "struct<id: string, flight: string, status: string, departing_airport: string, destination_airport: string, latitude: double, longitude: double, altitude: int>"
_STATION = "struct<id: string, ident: string, nearest_airport_icao: string, latitude: double, longitude: double>"
FLAT = f"id string, source string, timestamp string, tail string, text string, label string, frequency double, block_id string, link_direction string, airframe {_PLANE}, flight {_FLIGHT}, station {_STATION}"
_INNER = "struct<id: string, timestamp: string, label: string, text: string, tail: string, flight: string, frequency: double, from_hex: string, to_hex: string, block_id: string, link_direction: string>"
WRAPPED = f"source struct<name: string, application: string>, station {_STATION}, airframe {_PLANE}, flight {_FLIGHT}, message {_INNER}"
COLUMNS = ("id", "source", "timestamp", "tail", "text", "label", "frequency", "block_id", "link_direction")


def message_id(text: Column) -> Column:
    return F.coalesce(F.regexp_extract(text, r"\A([+-]?[0-9]{1,19})\z", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"))


def flat_messages(lines: DataFrame, column: str = "line", keep: tuple[str, ...] = ()) -> DataFrame:
    m = lines.where(F.try_parse_json(column).isNotNull()).select(*keep, F.from_json(column, FLAT).alias("m"))
    tail = F.coalesce(F.nullif("m.tail", F.lit("")), F.col("m.airframe.tail"))
    return m.select(*keep, message_id(F.col("m.id")).alias("id"), "m.source", "m.timestamp", tail.alias("tail"), *[f"m.{c}" for c in ("text", "label", "frequency", "block_id", "link_direction")])


def wrapped_messages(lines: DataFrame, column: str = "line", keep: tuple[str, ...] = ()) -> DataFrame:
    """The inner messages; an empty tail falls back to that of the airframe."""
    w = lines.where(F.try_parse_json(column).isNotNull()).select(*keep, F.from_json(column, WRAPPED).alias("w")).where("w.message IS NOT NULL")
    tail = F.coalesce(F.nullif("w.message.tail", F.lit("")), F.col("w.airframe.tail"))
    inner = {c: F.col(f"w.message.{c}") for c in ("timestamp", "text", "label", "frequency", "block_id", "link_direction")}
    return w.select(*keep, message_id(F.col("w.message.id")).alias("id"), F.col("w.source.name").alias("source"), inner["timestamp"], tail.alias("tail"), *[inner[c] for c in ("text", "label", "frequency", "block_id", "link_direction")])


def write_log(messages: DataFrame, path: str, at: str = "timestamp") -> None:
    """Appends to the message log: a folder a month, rows sorted so that row groups can be skipped; an empty batch writes nothing."""
    if messages.limit(1).count():
        keyed = messages.withColumn("yyyymm", F.date_format(at, "yyyyMM"))
        spread = keyed.repartition("yyyymm", F.pmod(F.xxhash64("delivery_id"), F.lit(16)))  # a month is written by up to 16 tasks
        spread.sortWithinPartitions("yyyymm", "parser_type", "label", at, "id").write.mode("append").partitionBy("yyyymm").parquet(path)


def read_log(spark: SparkSession, path: str, first_month: str | None = None, last_month: str | None = None) -> DataFrame:
    """The log, or some months of it, of which only the folders are read."""
    log = spark.read.option("recursiveFileLookup", "false").parquet(path)
    month = F.col("yyyymm").cast("string")
    if first_month:
        log = log.where(month >= first_month)
    return log.where(month <= last_month) if last_month else log


def reparse_diff(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("delivery_id", "result_type"), value: str = "result") -> DataFrame:
    """Two runs of parsing side by side: what was lost, what was gained, what changed."""
    a, b = old.select(*keys, F.col(value).alias("old")), new.select(*keys, F.col(value).alias("new"))
    change = F.when(F.col("new").isNull(), F.lit("regression")).when(F.col("old").isNull(), F.lit("improvement")).when(F.col("old") == F.col("new"), F.lit("same")).otherwise(F.lit("changed"))
    return a.join(b, list(keys), "full").withColumn("change", change)
