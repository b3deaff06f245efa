"""Queries of keyed state, enrichment, broadcasts, free text and review, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions import codes
from aerolith.operators import extract, folds, stats
from aerolith.plans import fixed
from aerolith.plans.log import LEGS, _J, _text_sql
from aerolith.sources.tables import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Free text. The patterns are written out here again, so that the SQL doesn't rest on those under test.

_AFTER = "[ \\t\\r\\n]*([^ \\t\\r\\n,/-]*)"


def _first(*patterns: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(u, '{p}', 1), '')" for p in patterns) + ")"


def _valid_or_null(code: str) -> str:
    return f"CASE WHEN {fixed.valid(code)} THEN {code} END"


def _next(*words: str) -> str:
    return "coalesce(" + ", ".join(_valid_or_null(f"CASE WHEN contains(u, '{w}') THEN regexp_extract(substr(u, strpos(u, '{w}') + {len(w)}), '^{_AFTER}', 1) END") for w in words) + ")"


def _pair(pattern: str, i: int) -> str:
    a, b = f"regexp_extract(u, '{pattern}', 1)", f"regexp_extract(u, '{pattern}', 2)"
    return f"CASE WHEN {fixed.valid(a)} AND {fixed.valid(b)} THEN {(a, b)[i]} END"


_DASH, _SLASH = r"\b([A-Z]{4})\s*-\s*([A-Z]{4})\b", r"\b([A-Z]{4})/([A-Z]{4})\b"


@query(
    f"""SELECT delivery_id, coalesce({_next('DEPART ', 'DEPARTING ', 'DEP ', 'FROM ', 'ORIGIN ', 'ORG ')}, {_pair(_DASH, 0)}, {_pair(_SLASH, 0)}) AS origin,
coalesce({_next('CLRD TO ', 'CLEARED TO ', 'CLRD ', 'DEST ', 'DEST:', 'DESTINATION ', 'ARR ', 'ARRIVING ')}, {_pair(_DASH, 1)}, {_pair(_SLASH, 1)}) AS destination,
{_first(r'\bOFF\s+(\d{1,2}[LRC]?)\b', r'\b(?:RWY|RUNWAY)\s+(\d{1,2}[LRC]?)\b', r'\bDEP[:\s]+[A-Z0-9]+.*?(\d{1,2}[LRC])\b')} AS runway,
{_first(r'\b(?:SQUAWK|XPNDR|XPDR|TRANSPONDER)[/:\s]+([0-7]{4})\b')} AS squawk, {_first(r'\b(?:DEP\s*FREQ|DPFRQ|NEXT\s*FREQ)[:\s]+(\d{3}\.\d{1,3})\b', r'\b(?:FREQ)[:\s]+(\d{3}\.\d{1,3})\b')} AS frequency,
{_first(r'\bCLIMB\s+(?:VIA\s+SID\s+)?TO[:\s]+(\d{3,5})\b', r'\bALT\s*(\d{3,5})\b', r'\bMAINT(?:AIN)?\s+(\d{3,5})\s*(?:FT)?\b', r'\bINITIAL\s+(?:ALT(?:ITUDE)?)\s+(\d{3,5})\s*(?:FT)?')} AS altitude,
'FL' || {_first(r'\bFL\s*(\d{2,3})\b', r'\bEXP\s+(\d{2,3})\s+(?:\d+\s+)?MIN\b', r'\bREQUESTED\s+FL\s*(\d{2,3})\b')} AS flight_level, {_first(r'\bATIS\s+([A-Z])\b')} AS atis
FROM (SELECT delivery_id, upper(raw_text) AS u FROM messages)"""
)
def extract_free_text(spark, d):
    made = codes.free_text(F.col("raw_text"))
    names = ("origin", "destination", "runway", "squawk", "frequency", "altitude", "flight_level", "atis")
    return spread(table(spark, d, "messages")).select("delivery_id", *[made[n].alias(n) for n in names])


@query()
def extract_free_text_flight(spark, d):
    made = codes.free_text(F.col("raw_text"))
    return spread(table(spark, d, "messages")).select("delivery_id", *[made[n].alias(n) for n in ("flight_number", "sid", "aircraft_type")])


@query(
    f"""SELECT delivery_id, list_filter(regexp_extract_all(raw_text, '\\b([KCELPYZRVOSWUABDFGHMNT][A-Z]{{3}})\\b', 1), lambda c: {fixed.valid('c')})[1] AS first_code,
len(list_filter(regexp_extract_all(raw_text, '\\b([KCELPYZRVOSWUABDFGHMNT][A-Z]{{3}})\\b', 1), lambda c: {fixed.valid('c')})) AS codes FROM messages WHERE raw_text IS NOT NULL"""
)
def extract_airport_codes(spark, d):
    return table(spark, d, "messages").where("raw_text IS NOT NULL").select("delivery_id", codes.first_airport(F.col("raw_text")).alias("first_code"), F.size(codes.all_airports(F.col("raw_text"))).cast("bigint").alias("codes"))


_HINTS = {"SFO": "KSFO", "LAX": "KLAX", "JFK": "KJFK", "ORD": "KORD", "DFW": "KDFW", "ATL": "KATL", "DEN": "KDEN", "SEA": "KSEA", "CLT": "KCLT", "PHX": "KPHX", "MIA": "KMIA", "BOS": "KBOS", "MSP": "KMSP", "DTW": "KDTW", "EWR": "KEWR", "LGA": "KLGA", "IAH": "KIAH", "ANC": "PANC", "HNL": "PHNL"}
_ASKED = "array('SFO', 'LAX', 'HNL', 'ANC', 'XYZ', 'LHR', 'IAH')"


@query("SELECT l_orderkey, l_linenumber, CASE c " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _HINTS.items()) + " ELSE c END AS code FROM (SELECT l_orderkey, l_linenumber, ['SFO', 'LAX', 'HNL', 'ANC', 'XYZ', 'LHR', 'IAH'][l_partkey % 7 + 1] AS c FROM lineitem)")
def iata_hint(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", codes.hinted(F.expr(f"element_at({_ASKED}, CAST(l_partkey % 7 + 1 AS INT))")).alias("code"))


# Broadcasts, written from the keys: one in five airports is none, one in seven letters is two.

_BROADCAST = """SELECT l_orderkey * 10 + l_linenumber AS delivery_id, l_shipdate AS "timestamp", CASE WHEN l_partkey % 5 = 0 THEN 'TIME' WHEN l_partkey % 5 = 1 THEN 'GJWO' ELSE 'KJF' || chr(CAST(65 + l_suppkey % 10 AS INT)) END AS airport,
CASE WHEN l_linenumber % 7 = 0 THEN 'AB' ELSE chr(CAST(65 + l_orderkey % 26 AS INT)) END AS letter, CAST(l_partkey % 360 AS VARCHAR) || '/10KT' AS wind FROM lineitem"""


def _broadcasts(spark, d) -> DataFrame:
    rows = table(spark, d, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS delivery_id", "l_shipdate AS timestamp", "CASE WHEN l_partkey % 5 = 0 THEN 'TIME' WHEN l_partkey % 5 = 1 THEN 'GJWO' ELSE 'KJF' || char(65 + l_suppkey % 10) END AS airport",
        "CASE WHEN l_linenumber % 7 = 0 THEN 'AB' ELSE char(65 + l_orderkey % 26) END AS atis_letter", "CAST(l_partkey % 360 AS STRING) || '/10KT' AS wind", "array('07L', '25R') AS runways", "'INFO' AS raw",
    )
    return extract.atis_updates(rows.select("delivery_id", "timestamp", F.to_json(F.struct("airport", "atis_letter", "wind", "runways", "raw")).alias("parsed_json")))


@query(f"SELECT delivery_id, \"timestamp\", airport AS airport_icao, letter, wind, '07L,25R' AS runways, 'INFO' AS raw FROM ({_BROADCAST}) WHERE airport LIKE 'KJF%' AND length(letter) = 1")
def extract_atis(spark, d):
    return _broadcasts(spark, d).select("delivery_id", "timestamp", "airport_icao", "letter", "wind", F.array_join("runways", ",").alias("runways"), "raw")


@query(f"SELECT airport AS airport_icao, arg_max(letter, (\"timestamp\", delivery_id)) AS letter, arg_max(wind, (\"timestamp\", delivery_id)) AS wind, count(*) AS updates FROM ({_BROADCAST}) WHERE airport LIKE 'KJF%' AND length(letter) = 1 GROUP BY 1")
def upsert_atis(spark, d):
    return folds.fold(_broadcasts(spark, d), ["airport_icao"], ["timestamp", "delivery_id"], whole=["letter", "wind"], count="updates")


# Enrichment by type of record

_ADDED = f"""SELECT delivery_id, "timestamp", coalesce(nullif(tail, ''), {_text_sql('tail')}, {_text_sql('registration')}) AS registration, {_text_sql('flight_num', 'flight_number', 'callsign', 'flight')} AS f, CAST("timestamp" AS DATE) AS flight_date,
{_text_sql('origin')} AS origin, {_text_sql('destination')} AS destination, CASE WHEN parser_type = 'pdc' THEN {_text_sql('runway')} END AS departure_runway, CASE WHEN parser_type = 'pdc' THEN {_text_sql('sid')} END AS sid, CASE WHEN parser_type = 'pdc' THEN {_text_sql('squawk')} END AS squawk,
CASE WHEN parser_type = 'loadsheet' AND json_type(j, '$.pax') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST(json_extract_string(j, '$.pax') AS DOUBLE) > 0 THEN CAST(trunc(CAST(json_extract_string(j, '$.pax') AS DOUBLE)) AS BIGINT) END AS pax_count
FROM (SELECT *, {_J} AS j FROM messages WHERE parser_type IN ('pdc', 'flight_plan', 'loadsheet', 'eta')) WHERE j IS NOT NULL"""
_CALL = "regexp_extract(trim(f), '^[^0-9]*') || CASE WHEN regexp_matches(trim(f), '[0-9]') THEN coalesce(nullif(ltrim(substr(trim(f), length(regexp_extract(trim(f), '^[^0-9]*')) + 1), '0'), ''), '0') ELSE '' END"
_UPDATES = f"SELECT *, {_CALL} AS callsign FROM ({_ADDED}) WHERE registration <> '' AND f <> '' AND flight_date IS NOT NULL AND coalesce(origin, destination, departure_runway, sid, squawk, CAST(pax_count AS VARCHAR)) IS NOT NULL"


def _added(spark, d) -> DataFrame:
    return extract.enrichment_updates(table(spark, d, "messages")).where("coalesce(origin, destination, departure_runway, sid, squawk, CAST(pax_count AS STRING)) IS NOT NULL")


@query(f"SELECT delivery_id, registration, callsign, flight_date, origin, destination, departure_runway, sid, squawk, pax_count FROM ({_UPDATES})")
def enrichment_by_type(spark, d):
    return _added(spark, d).select("delivery_id", "registration", "callsign", "flight_date", "origin", "destination", "departure_runway", "sid", "squawk", "pax_count")


_LATEST = "arg_max({0}, CASE WHEN {0} IS NOT NULL THEN (\"timestamp\", delivery_id) END) AS {0}"


@query(
    "SELECT registration, flight_date, coalesce(nullif(regexp_extract(callsign, '([0-9]+)$', 1), ''), callsign) AS flight, arg_max(callsign, (length(callsign), \"timestamp\", delivery_id)) AS callsign, "
    + ", ".join(_LATEST.format(c) for c in ("origin", "destination", "departure_runway", "sid", "squawk", "pax_count"))
    + f", count(*) AS observations FROM ({_UPDATES}) GROUP BY 1, 2, 3"
)
def upsert_enrichment(spark, d):
    return extract.merged_enrichment(_added(spark, d)).drop("route")


@query(
    "SELECT registration, strftime(flight_date, '%Y-%m-%d') AS date, max(callsign) AS callsign, strftime(max(\"timestamp\"), '%H:%M') AS latest, strftime(max(\"timestamp\"), '%Y-%m-%dT%H:%M:%SZ') AS updated_at "
    f"FROM ({_UPDATES}) GROUP BY 1, 2"
)
def enrichment_response(spark, d):
    """What a caller is shown of a flight: its date, the time of day, and the moment in full."""
    shown = _added(spark, d).groupBy("registration", F.date_format("flight_date", "yyyy-MM-dd").alias("date")).agg(F.max("callsign").alias("callsign"), F.max("timestamp").alias("at"))
    return shown.select("registration", "date", "callsign", F.date_format("at", "HH:mm").alias("latest"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_at"))


# Routes and callsigns


def _legs(spark, d) -> DataFrame:
    lines = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    along = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "s_nationkey")
    legs = lines.select(F.col("l_orderkey").alias("route"), F.row_number().over(along).alias("sequence"), F.col("s_nationkey").alias("o"), F.lead("s_nationkey").over(along).alias("de"))
    return legs.where("de IS NOT NULL").select((F.col("route") % 97).alias("route_id"), "sequence", "route", "o", "de")


@query(f"SELECT route % 97 AS route_id, CAST(sequence AS INTEGER) AS sequence, arg_max(o, route) AS o, arg_max(de, route) AS de, count(*) AS observation_count FROM ({LEGS}) WHERE de IS NOT NULL GROUP BY 1, 2")
def upsert_route_leg(spark, d):
    return folds.fold(_legs(spark, d), ["route_id", "sequence"], ["route"], whole=["o", "de"], count="observation_count")


_ROUTE = "SELECT *, length(flight_number) > 5 AS multi FROM flight_updates WHERE flight_number <> '' AND origin IS NOT NULL AND destination IS NOT NULL"


@query(f"SELECT flight_number, origin, destination, arg_max(multi, update_id) AS is_multi_stop, count(*) AS observation_count FROM ({_ROUTE}) GROUP BY 1, 2, 3 HAVING count(*) >= 5")
def list_routes(spark, d):
    """Routes seen often enough; each has a number that follows from its key alone."""
    rows = table(spark, d, "flight_updates").where("origin IS NOT NULL AND destination IS NOT NULL").withColumn("is_multi_stop", F.length("flight_number") > 5)
    made = folds.fold(rows, ["flight_number", "origin", "destination"], ["update_id"], whole=["is_multi_stop"], count="observation_count")
    return made.where("observation_count >= 5").withColumn("id", F.xxhash64("flight_number", "origin", "destination")).drop("id")


@query("SELECT flight_number, registration, count(*) AS observation_count, min(update_id) AS first_seen, max(update_id) AS last_seen FROM flight_updates WHERE flight_number <> '' AND registration IS NOT NULL GROUP BY 1, 2")
def upsert_route_aircraft(spark, d):
    return folds.fold(table(spark, d, "flight_updates"), ["flight_number", "registration"], ["update_id"], count="observation_count", seen="update_id")


@query(
    "SELECT registration, arg_max(substr(flight_number, 1, 2), update_id) AS iata_prefix, arg_max(CASE WHEN regexp_full_match(flight_number, '[A-Z]{3}[0-9]{1,4}') THEN substr(flight_number, 1, 3) ELSE '' END, update_id) AS icao_prefix, count(*) AS observation_count "
    "FROM flight_updates WHERE registration <> '' AND flight_number <> '' GROUP BY 1"
)
def upsert_aircraft_callsign(spark, d):
    """The callsign prefixes last used by each aircraft; one of three letters is that of an airline's radio name."""
    rows = table(spark, d, "flight_updates").where("flight_number <> ''")
    radio = F.when(F.col("flight_number").rlike(r"\A[A-Z]{3}[0-9]{1,4}\z"), F.substring("flight_number", 1, 3)).otherwise("")
    return folds.fold(rows.withColumns({"iata_prefix": F.substring("flight_number", 1, 2), "icao_prefix": radio}), ["registration"], ["update_id"], whole=["iata_prefix", "icao_prefix"], count="observation_count")


@query("SELECT waypoint, latitude, longitude, source_count FROM (SELECT waypoint, arg_max(latitude, update_id) AS latitude, arg_max(longitude, update_id) AS longitude, count(*) AS source_count FROM flight_updates WHERE waypoint <> '' AND latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY 1) WHERE source_count >= 3")
def list_waypoints(spark, d):
    placed = table(spark, d, "flight_updates").where("latitude IS NOT NULL AND longitude IS NOT NULL")
    return folds.fold(placed, ["waypoint"], ["update_id"], whole=["latitude", "longitude"], count="source_count").where("source_count >= 3")


# Review: annotations as a sequence of partial writes. Each event sets the flag, the note or the expected record of a message and leaves the rest.

_WRITES = "SELECT user_id AS message_id, event_id, CASE WHEN event_id % 3 = 0 THEN value > 50 END AS is_golden, CASE WHEN event_id % 3 = 1 THEN event_type END AS annotation, CASE WHEN event_id % 3 = 2 THEN props END AS expected_json FROM events"


@query(f"SELECT message_id, {', '.join(f'arg_max({c}, CASE WHEN {c} IS NOT NULL THEN event_id END) AS {c}' for c in ('is_golden', 'annotation', 'expected_json'))}, count(*) AS writes FROM ({_WRITES}) GROUP BY 1")
def upsert_golden(spark, d):
    writes = table(spark, d, "events").selectExpr("user_id AS message_id", "event_id", "CASE WHEN event_id % 3 = 0 THEN value > 50 END AS is_golden", "CASE WHEN event_id % 3 = 1 THEN event_type END AS annotation", "CASE WHEN event_id % 3 = 2 THEN props END AS expected_json")
    return folds.fold(writes, ["message_id"], ["event_id"], numbers=["is_golden", "annotation", "expected_json"], count="writes")


@query("SELECT delivery_id, missing_fields FROM messages WHERE missing_fields IS NOT NULL AND missing_fields LIKE '%origin%'")
def msg_missing_field(spark, d):
    return table(spark, d, "messages").where("missing_fields IS NOT NULL").where(F.col("missing_fields").like("%origin%")).select("delivery_id", "missing_fields")


@query("SELECT label, delivery_id, raw_text FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id, delivery_id) AS n FROM messages WHERE raw_text <> '') WHERE n <= 3")
def first_messages_by_label(spark, d):
    """The first three messages of each label; each task keeps its own first ones before they meet."""
    rows = table(spark, d, "messages").where("raw_text <> ''")
    first = Window.partitionBy("label").orderBy("id", "delivery_id")
    return rows.withColumn("n", F.row_number().over(first)).where("n <= 3").select("label", "delivery_id", "raw_text")


@query('SELECT parser_type, count(*) AS reports, min(delivery_id) AS first_report FROM messages WHERE parser_type <> \'\' GROUP BY 1')
def extract_output(spark, d):
    """The statistics of an extract: reports by type."""
    return table(spark, d, "messages").where("parser_type <> ''").groupBy("parser_type").agg(F.count("*").alias("reports"), F.min("delivery_id").alias("first_report"))


@query()
def template_clusters(spark, d):
    """Suggested formats: for each label its most frequent templates of ten messages and more, with the first three examples."""
    rows = table(spark, d, "messages").where("raw_text <> ''").select("label", "delivery_id", "raw_text", stats.template(F.col("raw_text")).alias("template"))
    along = Window.partitionBy("label", "template").orderBy("delivery_id")
    examples = rows.withColumn("n", F.row_number().over(along)).where("n <= 3").groupBy("label", "template").agg(F.array_sort(F.collect_list("delivery_id")).alias("examples"))
    sized = rows.groupBy("label", "template").agg(F.count("*").alias("size")).where("size >= 10")
    top = Window.partitionBy("label").orderBy(F.desc("size"), "template")
    return sized.withColumn("place", F.row_number().over(top)).where("place <= 10").join(examples, ["label", "template"])


@query()
def golden_tests(spark, d):
    """The text of a test a type of record: its messages with the fields expected of them."""
    rows = table(spark, d, "messages").where("parser_type <> '' AND raw_text <> '' AND id % 1000 = 0")
    case = F.concat(F.lit("    ("), F.to_json(F.array("label", "raw_text")), F.lit(", "), F.to_json(F.array("parsed_json")), F.lit("),"))
    made = rows.groupBy("parser_type").agg(F.array_join(F.array_sort(F.collect_set(case)), "\n").alias("cases"), F.count("*").alias("messages"))
    head = F.format_string('@pytest.mark.parametrize("message, expected", [\n%s\n])\ndef test_%s(message, expected):\n    assert decoded(*message) == expected[0]\n', "cases", "parser_type")
    return made.select("parser_type", "messages", head.alias("source"))
