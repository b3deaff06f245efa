"""From decoded records to updates: positions and identity of a flight, named points, and daily enrichment.

A record is a JSON text whose keys differ by type; what a field means is decided by
which keys are there. A key of another JSON type than expected is passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.functions.codes import airport, valid
from aerolith.operators.folds import fold, normal_flight

def _value(v: Column, key: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", kind)


def _text(v: Column, *keys: str) -> Column:
    """The first non-empty text among the keys."""
    found = [F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "STRING", F.nullif(_value(v, k, "string"), F.lit(""))) for k in keys]
    return F.coalesce(*found)


def _number(v: Column, key: str) -> Column:
    given = F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant"))
    return F.when(given.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), _value(v, key, "double"))


def _whole(v: Column, key: str) -> Column:
    return F.nullif(_number(v, key).cast("bigint"), F.lit(0).cast("bigint"))


def flight_updates(records: DataFrame, json_col: str = "parsed_json", keep: tuple[str, ...] = ("delivery_id", "id")) -> DataFrame:
    """One update a record that names an aircraft: later keys of a list win over earlier ones where the older rule overwrites."""
    v = F.col("__v")
    rows = records.select(*keep, F.col("tail").alias("__tail"), F.try_parse_json(json_col).alias("__v")).where("__v IS NOT NULL")
    lat, lon = _number(v, "latitude"), _number(v, "longitude")
    placed = lat.isNotNull() & lon.isNotNull() & ((lat != 0) | (lon != 0))
    alone = lambda own, other: F.when(placed, own).when(other.isNull() & (own != 0), own)
    level = _whole(v, "flight_level")
    made = rows.select(
        *keep,
        F.coalesce(F.nullif(F.col("__tail"), F.lit("")), _text(v, "tail"), _text(v, "registration")).alias("registration"),
        normal_flight(F.coalesce(_text(v, "flight_num"), _text(v, "flight_number"), _text(v, "callsign"))).alias("flight_number"),
        F.coalesce(airport(_text(v, "origin_icao")), airport(_text(v, "origin"))).alias("origin"),
        F.coalesce(airport(_text(v, "dest_icao")), airport(_text(v, "destination"))).alias("destination"),
        alone(lat, lon).alias("latitude"),
        alone(lon, lat).alias("longitude"),
        F.coalesce(level * 100, _whole(v, "altitude")).alias("altitude"),
        _whole(v, "ground_speed").alias("ground_speed"),
        F.coalesce(_whole(v, "track"), _whole(v, "heading")).alias("track"),
        F.coalesce(_text(v, "aircraft_type"), _text(v, "aircraft_icao")).alias("type_code"),
    )
    return made.where("registration IS NOT NULL")


def waypoint_updates(records: DataFrame, json_col: str = "parsed_json", keep: tuple[str, ...] = ("delivery_id",)) -> DataFrame:
    """Named points with both coordinates, from a record's points (a list, one object, or a text that encodes either) and from its own `waypoint` with its coordinates."""
    v = F.col("__v")
    rows = records.select(*keep, F.try_parse_json(json_col).alias("__v")).where("__v IS NOT NULL")
    point = "array<struct<name: string, latitude: double, longitude: double>>"
    given = F.to_json(F.try_variant_get(v, "$.waypoints", "variant"))
    plain = F.when(given.startswith('"'), F.try_variant_get(v, "$.waypoints", "string")).otherwise(given)
    listed = F.from_json(F.when(F.ltrim(plain).startswith("{"), F.concat(F.lit("["), plain, F.lit("]"))).otherwise(plain), point)
    own = F.array(F.struct(_text(v, "waypoint").alias("name"), _number(v, "latitude").alias("latitude"), _number(v, "longitude").alias("longitude")))
    points = rows.select(*keep, F.explode(F.concat(F.coalesce(listed, F.array().cast(point)), own)).alias("w")).select(*keep, "w.name", "w.latitude", "w.longitude")
    return points.where("name <> '' AND latitude <> 0 AND longitude <> 0")


ATIS_TEXTS = ("atis_type", "atis_time", "wind", "visibility", "clouds", "temperature", "dew_point", "qnh")


def atis_updates(records: DataFrame, json_col: str = "parsed_json", keep: tuple[str, ...] = ("delivery_id", "timestamp")) -> DataFrame:
    """The airport's broadcast that a record tells of: a valid airport and one capital letter; its text is under one of three names; lists keep their texts only."""
    v = F.col("__v")
    rows = records.select(*keep, F.try_parse_json(json_col).alias("__v")).where("__v IS NOT NULL")
    texts = lambda key: F.filter(F.from_json(F.to_json(F.try_variant_get(v, f"$.{key}", "variant")), "array<string>"), lambda x: x.isNotNull())
    string = lambda key: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")) == "STRING", _value(v, key, "string"))
    made = rows.select(*keep, _text(v, "airport").alias("airport_icao"), _text(v, "atis_letter").alias("letter"), *[string(c).alias(c) for c in ATIS_TEXTS], F.coalesce(string("raw_text"), string("raw"), string("text")).alias("raw"), *[texts(c).alias(c) for c in ("runways", "approaches", "remarks")])
    return made.where(valid(F.col("airport_icao")) & F.col("letter").rlike(r"\A[A-Z]\z"))


# What each type of record adds to a flight; the time of arrival is not kept.
ADDED = {"pdc": ("runway", "sid", "squawk", "route_waypoints"), "flight_plan": ("waypoints",), "loadsheet": ("pax",), "eta": ()}


def enrichment_updates(records: DataFrame, json_col: str = "parsed_json", type_col: str = "parser_type", keep: tuple[str, ...] = ("delivery_id", "timestamp")) -> DataFrame:
    """What the records of some types add to the flight of an aircraft on a day: airports of all, and runway, departure, transponder code, route and passengers by type; rows without any are left out."""
    v = F.col("__v")
    rows = records.where(F.col(type_col).isin(*ADDED)).select(*keep, F.col("tail").alias("__tail"), F.col(type_col).alias("__type"), F.try_parse_json(json_col).alias("__v")).where("__v IS NOT NULL")
    of = lambda kind, c: F.when(F.col("__type") == kind, c)
    points = F.from_json(F.to_json(F.try_variant_get(v, "$.waypoints", "variant")), "array<struct<name: string>>")
    names = F.coalesce(of("pdc", F.from_json(F.to_json(F.try_variant_get(v, "$.route_waypoints", "variant")), "array<string>")), of("flight_plan", F.transform(points, lambda p: p["name"])))
    route = F.filter(names, lambda x: x != "")
    pax = _number(v, "pax").cast("bigint")
    made = rows.select(
        *keep, F.coalesce(F.nullif(F.col("__tail"), F.lit("")), _text(v, "tail"), _text(v, "registration")).alias("registration"), normal_flight(F.coalesce(_text(v, "flight_num"), _text(v, "flight_number"), _text(v, "callsign"), _text(v, "flight"))).alias("callsign"),
        F.to_date("timestamp").alias("flight_date"), _text(v, "origin").alias("origin"), _text(v, "destination").alias("destination"), of("pdc", _text(v, "runway")).alias("departure_runway"), of("pdc", _text(v, "sid")).alias("sid"), of("pdc", _text(v, "squawk")).alias("squawk"),
        F.when(F.size(route) > 0, route).alias("route"), of("loadsheet", F.when(pax > 0, pax)).alias("pax_count"),
    )
    return made.where("registration <> '' AND callsign <> '' AND flight_date IS NOT NULL AND coalesce(origin, destination, departure_runway, sid, squawk, array_join(route, ' '), CAST(pax_count AS STRING)) IS NOT NULL")


def merged_enrichment(updates: DataFrame) -> DataFrame:
    """One row an aircraft, day and trailing digits of the callsign: the last given value of each field, and the longest callsign (of equals, the latest)."""
    from aerolith.operators.folds import latest, numeric_latest, trailing_digits

    number = trailing_digits(F.col("callsign"))
    at = F.struct("timestamp", "delivery_id")
    keyed = updates.withColumn("flight", F.when(number != "", number).otherwise(F.col("callsign")))
    texts = [latest(c, at).alias(c) for c in ("origin", "destination", "departure_runway", "sid", "squawk")]
    rest = [numeric_latest(c, at).alias(c) for c in ("route", "pax_count")]
    return keyed.groupBy("registration", "flight_date", "flight").agg(F.max_by("callsign", F.struct(F.length("callsign"), at)).alias("callsign"), *texts, *rest, F.count("*").alias("observations"))


def enrichment(updates: DataFrame, at: DataFrame) -> DataFrame:
    """What is known of each aircraft, flight and day, from updates and the times (delivery_id, timestamp) of their messages."""
    rows = updates.join(at, "delivery_id").withColumn("flight_date", F.to_date("timestamp")).where("flight_number <> '' AND flight_date IS NOT NULL")
    return fold(rows, ["registration", "flight_number", "flight_date"], ["delivery_id"], texts=["origin", "destination"], count="observations")
