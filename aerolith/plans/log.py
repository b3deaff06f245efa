"""Queries over the message log, its state tables and the relational tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolith.operators import extract, folds, routes, search, stats
from aerolith.plans import fixed
from aerolith.sources import ingest
from aerolith.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages")


@query("SELECT delivery_id, id, label, parser_type, flight, raw_text FROM messages WHERE parser_type = 'position' AND flight LIKE '%LZ%' AND raw_text LIKE '%POSRPT%' ORDER BY \"timestamp\" DESC, id, delivery_id LIMIT 50 OFFSET 10")
def msg_filter_page(spark, d):
    found = search.page(_log(spark, d), search.Search(parser_type="position", flight="LZ", text="POSRPT", order="timestamp", descending=True, limit=50, offset=10))
    return found.select("delivery_id", "id", "label", "parser_type", "flight", "raw_text")


@query("SELECT delivery_id, id, label, raw_text FROM messages WHERE id = 1000601")
def msg_point_lookup(spark, d):
    return search.matching(_log(spark, d), search.Search(id=1000601)).select("delivery_id", "id", "label", "raw_text")


@query("SELECT delivery_id, id FROM messages WHERE CASE WHEN json_valid(parsed_json) THEN json_extract_string(parsed_json, '$.message_id') = CAST(id AS VARCHAR) ELSE false END")
def msg_json_path_lookup(spark, d):
    own = F.when(search.valid_json("parsed_json"), F.get_json_object("parsed_json", "$.message_id")) == F.col("id").cast("string")
    return _log(spark, d).where(own).select("delivery_id", "id")


@query("SELECT delivery_id FROM messages WHERE list_contains(regexp_split_to_array(lower(raw_text), '[^a-z0-9_]+'), 'runway')")
def msg_fulltext_match(spark, d):
    return search.with_term(_log(spark, d), "RUNWAY").select("delivery_id")


@query("SELECT DISTINCT label AS value FROM messages WHERE label <> ''")
def msg_distinct_labels(spark, d):
    return search.distinct_values(_log(spark, d), "label")


@query("SELECT delivery_id, strftime(\"timestamp\", '%Y-%m-%dT%H:%M:%S') AS at, len(string_split(missing_fields, ',')) AS missing_parts FROM messages WHERE missing_fields <> ''")
def msg_projection(spark, d):
    return search.matching(_log(spark, d), search.Search(has_missing=True)).select("delivery_id", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.size(F.split("missing_fields", ",")).cast("long").alias("missing_parts"))


@query("SELECT coalesce(nullif(parser_type, ''), 'unparsed') AS parser_type, count(*) AS n FROM messages GROUP BY 1")
def stats_by_type(spark, d):
    return _log(spark, d).groupBy(stats.type_name().alias("parser_type")).agg(F.count("*").alias("n"))


@query("SELECT label, count(*) AS n FROM messages GROUP BY label ORDER BY n DESC, label LIMIT 20")
def stats_by_label_top20(spark, d):
    return _log(spark, d).groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(20)


@query("SELECT count(*) AS total, max(id) AS max_id, count(*) FILTER (missing_fields <> '') AS with_missing FROM messages")
def stats_total(spark, d):
    return _log(spark, d).agg(F.count("*").alias("total"), F.max("id").alias("max_id"), F.count_if(F.expr("missing_fields <> ''")).alias("with_missing"))


@query("SELECT field, count(*) AS n FROM (SELECT trim(unnest(string_split(missing_fields, ','))) AS field FROM messages) WHERE field <> '' GROUP BY field")
def stats_missing_top(spark, d):
    return stats.missing_counts(_log(spark, d))


PARSED = "coalesce(parser_type NOT IN ('', 'unparsed'), false)"


@query(
    f"SELECT count(*) AS total_messages, count(*) FILTER ({PARSED}) AS parsed_messages, count(*) FILTER (NOT {PARSED}) AS unparsed_messages, round(100.0 * count(*) FILTER ({PARSED}) / count(*)::DOUBLE, 6) AS parse_rate, "
    f"count(DISTINCT label) AS unique_labels, count(DISTINCT CASE WHEN {PARSED} THEN parser_type END) AS unique_parser_types FROM messages"
)
def corpus_summary(spark, d):
    return stats.summary(_log(spark, d))


@query("SELECT label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS percentage FROM messages GROUP BY label")
def label_distribution_pct(spark, d):
    return stats.distribution(_log(spark, d), F.col("label"), "label")


@query("SELECT parser_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS percentage FROM (SELECT coalesce(nullif(parser_type, ''), 'unparsed') AS parser_type FROM messages) GROUP BY 1")
def parser_coverage_pct(spark, d):
    return stats.distribution(_log(spark, d), stats.type_name(), "parser_type")


@query(
    """WITH t AS (SELECT label, coalesce(nullif(parser_type, ''), 'unparsed') AS kind, count(*) AS n FROM messages GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, kind) AS place FROM t WHERE kind <> 'unparsed'),
b AS (SELECT label, string_agg(kind || '(' || n || ')', ', ' ORDER BY place) AS top_parsers FROM r WHERE place <= 3 GROUP BY label)
SELECT t.label, CAST(sum(n) AS BIGINT) AS total, CAST(sum(CASE WHEN kind <> 'unparsed' THEN n ELSE 0 END) AS BIGINT) AS parsed, CAST(sum(CASE WHEN kind = 'unparsed' THEN n ELSE 0 END) AS BIGINT) AS unparsed,
round(100.0 * sum(CASE WHEN kind <> 'unparsed' THEN n ELSE 0 END) / sum(n)::DOUBLE, 6) AS parse_rate, coalesce(any_value(b.top_parsers), '') AS top_parsers FROM t LEFT JOIN b ON t.label = b.label GROUP BY t.label"""
)
def label_parse_rate_top_parsers(spark, d):
    return stats.label_parse_rates(_log(spark, d))


@query(
    "WITH k AS (SELECT unnest([" + ", ".join(f"'{w}'" for w in stats.KEYWORDS) + "]) AS keyword), t AS (SELECT label, count(*) AS total FROM messages WHERE raw_text IS NOT NULL GROUP BY label) "
    "SELECT m.label, keyword, count(*) AS n, round(100.0 * count(*) / any_value(total)::DOUBLE, 6) AS percentage FROM messages m JOIN t ON m.label = t.label, k WHERE contains(upper(raw_text), keyword) GROUP BY m.label, keyword"
)
def keyword_presence(spark, d):
    return stats.keyword_presence(_log(spark, d))


@query(
    f"""WITH v AS (SELECT parser_type, parsed_json FROM messages WHERE {PARSED} AND json_valid(parsed_json)), t AS (SELECT parser_type, count(*) AS total FROM v GROUP BY 1),
f AS (SELECT parser_type, key AS field, json_extract_string(parsed_json, '$."' || key || '"') AS value, json_type(json_extract(parsed_json, '$."' || key || '"')) AS kind FROM (SELECT *, unnest(json_keys(parsed_json)) AS key FROM v)),
e AS (SELECT *, coalesce(value IS NULL OR kind = 'NULL' OR value IN ('', '[]') OR try_cast(value AS DOUBLE) = 0, false) AS empty FROM f WHERE field NOT IN ('message_id', 'timestamp', 'raw_text', 'parse_confidence'))
SELECT e.parser_type, field, count(*) FILTER (NOT empty) AS present, count(*) FILTER (empty) AS missing, round(100.0 * count(*) FILTER (NOT empty) / any_value(total)::DOUBLE, 6) AS percentage FROM e JOIN t ON e.parser_type = t.parser_type GROUP BY 1, 2"""
)
def field_coverage(spark, d):
    return stats.field_coverage(_log(spark, d))


def _token_sql() -> str:
    cases = "".join(f" WHEN regexp_full_match(t, '{p}') THEN '{n}'" for n, p in stats.TOKENS)
    literals = ", ".join(f"'{w}'" for w in stats.LITERALS)
    return f"CASE WHEN t IN ({literals}) THEN t{cases} WHEN strlen(t) <= 2 THEN t ELSE '<OTHER>' END"


@query(
    f"""WITH l AS (SELECT delivery_id, label, raw_text, list_filter(list_transform(string_split(upper(raw_text), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS lines FROM messages WHERE raw_text <> ''),
m AS (SELECT delivery_id, label, raw_text, array_to_string(list_transform(lines, lambda x: array_to_string(list_transform(regexp_split_to_array(x, '[ \\t\\f\\r]+'), lambda t: {_token_sql()}), ' ')), ' | ') AS template FROM l),
c AS (SELECT label, template, count(*) AS n, arg_min(raw_text, delivery_id) AS ex FROM m GROUP BY ALL),
r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY label) AS BIGINT) AS total, count(*) OVER (PARTITION BY label) AS unique_templates, row_number() OVER (PARTITION BY label ORDER BY n DESC, template) AS place FROM c)
SELECT label, total, unique_templates, place, template, n, CASE WHEN strlen(ex) > 100 THEN left(translate(ex, chr(10) || chr(9), '  '), 100) || '...' ELSE translate(ex, chr(10) || chr(9), '  ') END AS example FROM r WHERE place <= 10 AND total >= 10"""
)
def template_histogram(spark, d):
    return stats.template_histogram(_log(spark, d))


@query(
    """WITH h AS (SELECT delivery_id, coalesce(regexp_matches(raw_text, 'FL[0-9]{3}'), false) AS hit FROM messages)
SELECT count(*) AS total, count(*) FILTER (hit) AS matches, round(100.0 * count(*) FILTER (hit) / count(*)::DOUBLE, 6) AS rate,
(SELECT string_agg(delivery_id, ',' ORDER BY delivery_id) FROM (SELECT delivery_id FROM h WHERE hit ORDER BY 1 LIMIT 5)) AS matching_ids, (SELECT string_agg(delivery_id, ',' ORDER BY delivery_id) FROM (SELECT delivery_id FROM h WHERE NOT hit ORDER BY 1 LIMIT 5)) AS other_ids FROM h"""
)
def regex_hit_rate(spark, d):
    return stats.hit_rate(_log(spark, d), "FL[0-9]{3}")


def _annotations(log: DataFrame) -> DataFrame:
    """Annotations made from the log: confident complete messages are golden."""
    return log.where("id <> 0").groupBy(F.col("id").alias("message_id")).agg(F.max(F.expr("confidence >= 0.6 AND missing_fields = ''")).alias("is_golden"), F.lit("").alias("annotation"), F.lit("").alias("expected_json"))


ANNOTATIONS = "SELECT id AS message_id, max(CASE WHEN confidence >= 0.6 AND missing_fields = '' THEN 1 ELSE 0 END) = 1 AS is_golden FROM messages WHERE id <> 0 GROUP BY id"


@query(f"WITH a AS ({ANNOTATIONS}), p AS (SELECT * FROM messages ORDER BY \"timestamp\", id, delivery_id LIMIT 50) SELECT p.id, delivery_id, label FROM p JOIN a ON a.message_id = p.id WHERE is_golden")
def golden_left_join_page(spark, d):
    log = _log(spark, d)
    rows = search.page(log, search.Search(order="timestamp", limit=50))
    return search.annotated_page(rows, _annotations(log), golden_only=True).select("id", "delivery_id", "label")


@query(f"WITH a AS ({ANNOTATIONS}) SELECT delivery_id, id, parser_type, parsed_json AS expected FROM messages m JOIN a ON a.message_id = m.id WHERE is_golden")
def golden_export(spark, d):
    log = _log(spark, d)
    return search.golden_export(log, _annotations(log)).select("delivery_id", "id", "parser_type", "expected")


@query(
    """SELECT icao_hex, arg_max(nullif(registration, ''), CASE WHEN nullif(registration, '') IS NOT NULL THEN update_id END) AS registration, arg_max(nullif(type_code, ''), CASE WHEN nullif(type_code, '') IS NOT NULL THEN update_id END) AS type_code,
arg_max(nullif(operator, ''), CASE WHEN nullif(operator, '') IS NOT NULL THEN update_id END) AS operator, count(*) AS msg_count, min(update_id) AS first_seen, max(update_id) AS last_seen FROM flight_updates WHERE icao_hex <> '' GROUP BY icao_hex"""
)
def upsert_aircraft(spark, d):
    return folds.fold(table(spark, d, "flight_updates"), ["icao_hex"], ["update_id"], texts=["registration", "type_code", "operator"], seen="update_id")


@query(
    "SELECT waypoint, arg_max(latitude, update_id) AS latitude, arg_max(longitude, update_id) AS longitude, count(*) AS source_count FROM flight_updates WHERE waypoint <> '' AND latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY waypoint"
)
def upsert_waypoint(spark, d):
    placed = table(spark, d, "flight_updates").where("latitude IS NOT NULL AND longitude IS NOT NULL")
    return folds.fold(placed, ["waypoint"], ["update_id"], whole=["latitude", "longitude"], count="source_count")


LAST = "arg_max({0}, CASE WHEN {0} IS NOT NULL THEN update_id END) AS {0}"


@query("SELECT icao_hex, " + ", ".join(LAST.format(c) for c in ("origin", "destination", "latitude", "longitude", "altitude", "ground_speed", "track")) + ", count(*) AS msg_count FROM flight_updates WHERE icao_hex <> '' GROUP BY icao_hex")
def upsert_flight_state(spark, d):
    return folds.fold(table(spark, d, "flight_updates"), ["icao_hex"], ["update_id"], texts=["origin", "destination"], numbers=["latitude", "longitude", "altitude", "ground_speed", "track"])


@query("SELECT flight_number, origin, destination, count(*) AS observation_count, min(update_id) AS first_seen, max(update_id) AS last_seen FROM flight_updates WHERE flight_number <> '' AND origin IS NOT NULL AND destination IS NOT NULL GROUP BY 1, 2, 3")
def upsert_route(spark, d):
    return folds.fold(table(spark, d, "flight_updates"), ["flight_number", "origin", "destination"], ["update_id"], count="observation_count", seen="update_id")


NORMAL = "regexp_extract(trim(flight), '^[^0-9]*') || CASE WHEN regexp_matches(trim(flight), '[0-9]') THEN coalesce(nullif(ltrim(substr(trim(flight), length(regexp_extract(trim(flight), '^[^0-9]*')) + 1), '0'), ''), '0') ELSE '' END"


@query(f"SELECT tail, CAST(\"timestamp\" AS DATE) AS flight_date, regexp_extract(flight, '([0-9]+)$', 1) AS number, max({NORMAL}) AS flight_number, count(*) AS n FROM messages WHERE flight <> '' AND tail <> '' AND \"timestamp\" IS NOT NULL GROUP BY 1, 2, 3")
def callsign_canonical_merge(spark, d):
    rows = _log(spark, d).where("flight <> '' AND tail <> '' AND timestamp IS NOT NULL")
    return rows.groupBy("tail", F.to_date("timestamp").alias("flight_date"), folds.trailing_digits(F.col("flight")).alias("number")).agg(F.max(folds.normal_flight(F.col("flight"))).alias("flight_number"), F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT DISTINCT tail AS icao_hex, CAST("timestamp" AS DATE) AS flight_date, flight AS callsign FROM messages WHERE flight <> '' AND tail <> '' AND "timestamp" IS NOT NULL),
q AS (SELECT DISTINCT icao_hex, flight_date, regexp_extract(callsign, '([0-9]+)$', 1) AS number FROM s)
SELECT s.icao_hex, s.flight_date, callsign, number AS asked_callsign FROM s JOIN q ON s.icao_hex = q.icao_hex AND s.flight_date = q.flight_date WHERE CASE WHEN number <> '' THEN suffix(callsign, number) ELSE callsign = number END"""
)
def callsign_suffix_join(spark, d):
    stored = _log(spark, d).where("flight <> '' AND tail <> '' AND timestamp IS NOT NULL").select(F.col("tail").alias("icao_hex"), F.to_date("timestamp").alias("flight_date"), F.col("flight").alias("callsign")).distinct()
    asked = stored.select("icao_hex", "flight_date", folds.trailing_digits(F.col("callsign")).alias("asked_callsign")).distinct()
    return folds.suffix_matches(stored, asked)


@query(
    "WITH f AS (SELECT tail, CAST(\"timestamp\" AS DATE) AS flight_date, flight, origin, destination, delivery_id FROM messages WHERE tail <> '' AND flight <> '' AND \"timestamp\" IS NOT NULL) "
    "SELECT tail, flight_date, flight, arg_max(nullif(origin, ''), CASE WHEN origin <> '' THEN delivery_id END) AS origin, arg_max(nullif(destination, ''), CASE WHEN destination <> '' THEN delivery_id END) AS destination, count(*) AS msg_count FROM f GROUP BY 1, 2, 3"
)
def flight_enrichment_daily(spark, d):
    rows = _log(spark, d).where("flight <> '' AND timestamp IS NOT NULL").withColumn("flight_date", F.to_date("timestamp"))
    return folds.fold(rows, ["tail", "flight_date", "flight"], ["delivery_id"], texts=["origin", "destination"])


@query(
    """WITH w AS (SELECT DISTINCT icao_hex FROM aircraft WHERE operator IS NOT NULL), f AS (SELECT icao_hex, flight_number, count(*) AS n FROM flight_updates GROUP BY 1, 2)
SELECT w.icao_hex, count(f.flight_number) AS flights, coalesce(string_agg(f.flight_number, ',' ORDER BY f.flight_number), '') AS callsigns FROM w LEFT JOIN f ON f.icao_hex = w.icao_hex GROUP BY 1"""
)
def enrichment_batch_lookup(spark, d):
    wanted = table(spark, d, "aircraft").where("operator IS NOT NULL").select("icao_hex").distinct()
    flights = table(spark, d, "flight_updates").select("icao_hex", "flight_number").distinct()
    return wanted.join(flights, "icao_hex", "left").groupBy("icao_hex").agg(F.count("flight_number").alias("flights"), F.array_join(F.sort_array(F.collect_list("flight_number")), ",").alias("callsigns"))


LEGS = (
    "SELECT l_orderkey AS route, row_number() OVER w AS sequence, s_nationkey AS o, lead(s_nationkey) OVER w AS de FROM lineitem JOIN supplier ON s_suppkey = l_suppkey "
    "WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, s_nationkey)"
)


@query(f"SELECT route || ',' || string_agg(o, ',' ORDER BY sequence) || ',' || arg_max(de, sequence) AS value FROM ({LEGS}) WHERE de IS NOT NULL GROUP BY route")
def route_sequence_export(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    along = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "s_nationkey")
    nation = F.col("s_nationkey").cast("string")
    legs = lines.select(F.col("l_orderkey").cast("string").alias("pattern"), F.row_number().over(along).alias("sequence"), nation.alias("origin"), F.lead(nation).over(along).alias("destination")).where("destination IS NOT NULL")
    return routes.csv_lines(routes.sequences(legs, "pattern"))


BUCKETS = "CASE WHEN n <= 1 THEN 'once' WHEN n <= 5 THEN 'few' WHEN n <= 20 THEN 'some' WHEN n <= 100 THEN 'many' ELSE 'most' END"


@query(f"SELECT {BUCKETS} AS bucket, count(*) AS routes, CAST(sum(n) AS BIGINT) AS observations, min(n) AS least, max(n) AS greatest, round(avg(n), 6) AS mean FROM (SELECT flight_number, origin, destination, count(*) AS n FROM flight_updates GROUP BY 1, 2, 3) GROUP BY 1")
def route_stats_buckets(spark, d):
    seen = table(spark, d, "flight_updates").groupBy("flight_number", "origin", "destination").agg(F.count("*").alias("n"))
    bucket = routes.buckets(F.col("n"), [(1, "once"), (5, "few"), (20, "some"), (100, "many")], "most")
    return seen.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("routes"), F.sum("n").alias("observations"), F.min("n").alias("least"), F.max("n").alias("greatest"), F.round(F.avg("n"), 6).alias("mean"))


@query("SELECT waypoint, count(*) AS n, round(avg(latitude), 6) AS latitude, round(avg(longitude), 6) AS longitude FROM flight_updates WHERE waypoint <> '' GROUP BY 1")
def waypoint_stats(spark, d):
    return table(spark, d, "flight_updates").where("waypoint <> ''").groupBy("waypoint").agg(F.count("*").alias("n"), F.round(F.avg("latitude"), 6).alias("latitude"), F.round(F.avg("longitude"), 6).alias("longitude"))


@query("SELECT '<Placemark><name>' || icao || '</name><Point><coordinates>' || printf('%.6f,%.6f,0', longitude, latitude) || '</coordinates></Point></Placemark>' AS value FROM airports")
def airport_kml(spark, d):
    return routes.kml(table(spark, d, "airports"), "icao")


@query("SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' GROUP BY n_name")
def native_join_smoke(spark, d):
    joined = table(spark, d, "orders").where("o_orderstatus = 'F'").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT 'both' AS side, count(*) AS n FROM (SELECT tail FROM messages INTERSECT SELECT registration FROM aircraft) UNION ALL SELECT 'log only', count(*) FROM (SELECT tail FROM messages EXCEPT SELECT registration FROM aircraft)")
def native_set_ops(spark, d):
    log, known = _log(spark, d).select("tail"), table(spark, d, "aircraft").select(F.col("registration").alias("tail"))
    return log.intersect(known).agg(F.lit("both").alias("side"), F.count("*").alias("n")).unionByName(log.subtract(known).agg(F.lit("log only").alias("side"), F.count("*").alias("n")))


@query("SELECT label, parser_type, count(*) AS n FROM messages GROUP BY ROLLUP (label, parser_type)")
def native_rollup(spark, d):
    return _log(spark, d).rollup("label", "parser_type").agg(F.count("*").alias("n"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, count(*) AS n, min(ts) AS started FROM s GROUP BY user_id, session"""
)
def native_session_window(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("started")).drop("w")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def window_tumbling_daily(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


_J = "CASE WHEN json_valid(parsed_json) THEN parsed_json END"


def _text_sql(*keys: str) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN json_type(j, '$.{k}') = 'VARCHAR' THEN nullif(json_extract_string(j, '$.{k}'), '') END" for k in keys) + ")"


def _number_sql(key: str) -> str:
    return f"CASE WHEN json_type(j, '$.{key}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(json_extract_string(j, '$.{key}') AS DOUBLE) END"


def _whole_sql(key: str) -> str:
    return f"nullif(CAST(trunc({_number_sql(key)}) AS BIGINT), 0)"


def _airport_sql(key: str) -> str:
    return f"CASE WHEN {fixed.valid(_text_sql(key))} THEN {_text_sql(key)} END"


_PREFIX = "regexp_extract(trim(f), '^[^0-9]*')"
_FLIGHT = f"CASE WHEN f IS NULL THEN NULL ELSE {_PREFIX} || CASE WHEN regexp_matches(trim(f), '[0-9]') THEN (CASE WHEN regexp_full_match(substr(trim(f), length({_PREFIX}) + 1), '0+') THEN '0' ELSE ltrim(substr(trim(f), length({_PREFIX}) + 1), '0') END) ELSE '' END END"
UPDATES = f"""SELECT delivery_id, id, coalesce(nullif(tail, ''), {_text_sql('tail')}, {_text_sql('registration')}) AS registration, {_FLIGHT} AS flight_number, coalesce({_airport_sql('origin_icao')}, {_airport_sql('origin')}) AS origin,
coalesce({_airport_sql('dest_icao')}, {_airport_sql('destination')}) AS destination, CASE WHEN la IS NOT NULL AND lo IS NOT NULL THEN CASE WHEN la <> 0 OR lo <> 0 THEN la END WHEN lo IS NULL AND la <> 0 THEN la END AS latitude,
CASE WHEN la IS NOT NULL AND lo IS NOT NULL THEN CASE WHEN la <> 0 OR lo <> 0 THEN lo END WHEN la IS NULL AND lo <> 0 THEN lo END AS longitude, coalesce({_whole_sql('flight_level')} * 100, {_whole_sql('altitude')}) AS altitude,
{_whole_sql('ground_speed')} AS ground_speed, coalesce({_whole_sql('track')}, {_whole_sql('heading')}) AS track, coalesce({_text_sql('aircraft_type')}, {_text_sql('aircraft_icao')}) AS type_code
FROM (SELECT *, {_text_sql('flight_num', 'flight_number', 'callsign')} AS f, {_number_sql('latitude')} AS la, {_number_sql('longitude')} AS lo FROM (SELECT *, {_J} AS j FROM messages) WHERE j IS NOT NULL)"""


@query(f"SELECT * FROM ({UPDATES}) WHERE registration IS NOT NULL")
def extract_flight_updates(spark, d):
    return extract.flight_updates(_log(spark, d))


_LISTED = """SELECT delivery_id, unnest(CASE WHEN json_type(p) = 'OBJECT' THEN [CAST(p AS JSON)] ELSE json_extract(p, '$[*]') END) AS w FROM (
SELECT delivery_id, CASE WHEN json_type(j, '$.waypoints') = 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string(j, '$.waypoints')) THEN json_extract_string(j, '$.waypoints') END ELSE CAST(json_extract(j, '$.waypoints') AS VARCHAR) END AS p
FROM (SELECT delivery_id, parsed_json AS j FROM messages WHERE json_valid(parsed_json)))"""


@query(
    f"""SELECT * FROM (SELECT delivery_id, json_extract_string(w, '$.name') AS name, TRY_CAST(json_extract_string(w, '$.latitude') AS DOUBLE) AS latitude, TRY_CAST(json_extract_string(w, '$.longitude') AS DOUBLE) AS longitude FROM ({_LISTED})
UNION ALL SELECT delivery_id, {_text_sql('waypoint')}, {_number_sql('latitude')}, {_number_sql('longitude')} FROM (SELECT delivery_id, {_J} AS j FROM messages)) WHERE name <> '' AND latitude <> 0 AND longitude <> 0"""
)
def extract_waypoints(spark, d):
    return extract.waypoint_updates(_log(spark, d))


@query(
    f"""WITH u AS (SELECT u.*, CAST(m."timestamp" AS DATE) AS flight_date FROM ({UPDATES}) u JOIN messages m ON u.delivery_id = m.delivery_id)
SELECT registration, flight_number, flight_date, arg_max(origin, CASE WHEN origin IS NOT NULL THEN delivery_id END) AS origin, arg_max(destination, CASE WHEN destination IS NOT NULL THEN delivery_id END) AS destination, count(*) AS observations
FROM u WHERE registration <> '' AND flight_number <> '' AND flight_date IS NOT NULL GROUP BY 1, 2, 3"""
)
def extract_enrichment(spark, d):
    log = _log(spark, d)
    return extract.enrichment(extract.flight_updates(log), log.select("delivery_id", "timestamp"))


@query(
    """WITH w AS (SELECT record_id, payload AS p FROM feed_records WHERE record_kind = 'wrapper' AND json_valid(payload) AND json_type(payload, '$.message') = 'OBJECT')
SELECT record_id, CASE WHEN regexp_full_match(json_extract_string(p, '$.message.id'), '[+-]?[0-9]{1,19}') THEN CAST(json_extract_string(p, '$.message.id') AS BIGINT) ELSE 0 END AS id, json_extract_string(p, '$.source.name') AS source,
json_extract_string(p, '$.message.timestamp') AS timestamp, coalesce(nullif(json_extract_string(p, '$.message.tail'), ''), json_extract_string(p, '$.airframe.tail')) AS tail, json_extract_string(p, '$.message.text') AS text, json_extract_string(p, '$.message.label') AS label FROM w"""
)
def ingest_wrapped(spark, d):
    rows = table(spark, d, "feed_records").where("record_kind = 'wrapper'")
    return ingest.wrapped_messages(rows, "payload", ("record_id",)).drop("frequency", "block_id", "link_direction")


@query(
    """SELECT record_id, CASE WHEN regexp_full_match(json_extract_string(payload, '$.id'), '[+-]?[0-9]{1,19}') THEN CAST(json_extract_string(payload, '$.id') AS BIGINT) ELSE 0 END AS id, json_extract_string(payload, '$.timestamp') AS timestamp,
nullif(json_extract_string(payload, '$.tail'), '') AS tail, json_extract_string(payload, '$.label') AS label FROM feed_records WHERE record_kind = 'log' AND json_valid(payload)"""
)
def ingest_flat(spark, d):
    rows = table(spark, d, "feed_records").where("record_kind = 'log'")
    return ingest.flat_messages(rows, "payload", ("record_id",)).select("record_id", "id", "timestamp", "tail", "label")
