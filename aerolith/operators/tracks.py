"""Position reports with identity and time: one row a message."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.sources.tables import micros


def identified(updates: DataFrame, register: DataFrame) -> DataFrame:
    """The reports with `hex`: the hex code in upper case or, where it is missing, that of the registration; and `report`: message_id, or a number below 0 for a report without."""
    own = F.nullif(F.upper(F.trim("icao_hex")), F.lit(""))
    plain = F.upper(F.trim("registration"))
    known = register.where("registration IS NOT NULL AND icao_hex IS NOT NULL").groupBy(F.upper(F.trim("registration")).alias("__reg")).agg(F.min(F.upper(F.trim("icao_hex"))).alias("__hex"))
    picked = updates.select("update_id", "message_id", own.alias("__own"), F.nullif(plain, F.lit("")).alias("__reg"), F.col("latitude").cast("double"), F.col("longitude").cast("double"), F.col("altitude").cast("double"), F.col("ground_speed").cast("double"))
    return picked.join(known, "__reg", "left").select(
        "update_id", F.coalesce("message_id", -F.col("update_id") - 1).alias("report"), F.coalesce("__own", "__hex").alias("hex"), "latitude", "longitude", "altitude", "ground_speed"
    )


def message_times(messages: DataFrame) -> DataFrame:
    """(report, at): the time, in microseconds, of the copy of each message that was created first."""
    first = F.min(F.struct(F.col("created_at").isNull(), F.col("created_at"), F.col("delivery_id"), micros("timestamp").alias("at")))
    return messages.where("id <> 0").groupBy(F.col("id").alias("report")).agg(first["at"].alias("at"))


def tracks(reports: DataFrame, messages: DataFrame) -> DataFrame:
    """One row a report that has an identity and a time: report, hex, at and the readings of its first row."""
    least = F.min(F.struct(F.col("hex").isNull(), F.col("update_id"), F.col("hex").alias("hex"), *[F.col(c).alias(c) for c in ("latitude", "longitude", "altitude", "ground_speed")]))
    single = reports.groupBy("report").agg(least.alias("r")).select("report", "r.hex", "r.latitude", "r.longitude", "r.altitude", "r.ground_speed").where("hex IS NOT NULL AND report >= 0")
    return single.join(message_times(messages), "report").where("at IS NOT NULL")
