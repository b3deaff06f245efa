"""Takeoff briefs: runways in use, positions of flight briefs and position reports of one label.

Fixed values: formats, label and names of the message's parts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aerolith.decoders.engine import Decoder, Format, bind, decimal, degrees, first_of, onward_items, text_of, to_java, whole

BRIEFS = {
    "runway_header": r"^(?P<airport>{ICAO})\s+T/O\s+RWYS?,(?P<runway>\d{2})",
    "fb_position": r"/FB\s*(?P<fb>\d+)/AD\s*(?P<airport>{ICAO})/(?P<lat_dir>{LAT_DIR})\s*(?P<lat>[\d.]+),(?P<lon_dir>{LON_DIR})\s*(?P<lon>[\d.]+),(?P<callsign>[A-Z0-9]+),(?P<unknown>[^,]+),(?P<dest>{ICAO}),(?P<time>{TIME4})",
    "pos_report": r"^POS(?P<unknown>\d{2}),(?P<lat_dir>{LAT_DIR})(?P<lat>\d{5,6})(?P<lon_dir>{LON_DIR})(?P<lon>\d{5,6}),(?P<fl>\d{1,3}),(?P<origin>{ICAO}),(?P<dest>{ICAO}),(?P<time1>{TIME4}),(?P<time2>{TIME4})",
}
RUNWAY_LINE = to_java(r"^(?P<runway>\d{2})(?:/(?P<suffix>[A-Z0-9]+))?\s+.*?(?P<distance>\d{4,5})\s*$")[0]
RUNWAYS = "array<struct<runway: string, suffix: string, distance: bigint>>"
FIELDS = ("message_type", "airport", "runways", "procedures", "latitude", "longitude", "flight_level", "origin", "destination", "callsign", "report_time", "raw_data")
TYPES = {"runways": RUNWAYS, "procedures": "array<string>", "latitude": "double", "longitude": "double", "flight_level": "bigint"}


def _record(**known: Column) -> Column:
    return F.struct(*[known.get(n, F.lit(None)).cast(TYPES.get(n, "string")).alias(n) for n in FIELDS])


def _unless_empty(items: Column) -> Column:
    return bind(items, lambda x: F.when(F.size(x) > 0, x))


def _bare(x: Column) -> Column:
    return F.trim(x, F.lit(" \t\r\n"))


def _line(x: Column) -> Column:
    """A line behind the header: the runway it names, or the procedure that an indented one is."""
    return bind(
        F.struct(_bare(x).alias("bare"), (x.startswith(" ") & ~_bare(x).startswith("0")).alias("indented")),
        lambda r: F.when(
            r["bare"].rlike(RUNWAY_LINE),
            F.when(~r["indented"], F.struct(F.regexp_extract(r["bare"], RUNWAY_LINE, 1).alias("runway"), text_of(F.regexp_extract(r["bare"], RUNWAY_LINE, 2)).alias("suffix"), F.regexp_extract(r["bare"], RUNWAY_LINE, 3).cast("bigint").alias("distance"), F.lit(None).cast("string").alias("procedure"))),
        ).when(r["indented"], F.struct(F.lit(None).cast("string").alias("runway"), F.lit(None).cast("string").alias("suffix"), F.lit(None).cast("bigint").alias("distance"), r["bare"].alias("procedure"))),
    )


def _runways(t: Column):
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(x, "\r", "")), lambda x: F.trim(x, F.lit(" \t")) != "")

    def made(g) -> Column:
        def read(every: Column) -> Column:
            length = whole(F.element_at(F.split(F.rtrim(F.get(every, F.lit(0))), r"\s+"), -1))
            own = F.when(length > 1000, F.array(F.struct(g("runway").alias("runway"), F.lit(None).cast("string").alias("suffix"), length.alias("distance"))))
            return bind(
                F.array_compact(F.transform(onward_items(every, 2), _line)),
                lambda rest: _record(
                    message_type=F.lit("runway"), airport=g("airport"), procedures=_unless_empty(F.array_compact(F.transform(rest, lambda x: x["procedure"]))),
                    runways=_unless_empty(F.concat(F.coalesce(own, F.array().cast(RUNWAYS)), F.transform(F.filter(rest, lambda x: x["runway"].isNotNull()), lambda x: F.struct(x["runway"], x["suffix"], x["distance"])))),
                ),
            )

        return bind(lines, read)

    return made


def _flight_brief(g) -> Column:
    lat, lon = decimal(g("lat"), g("lat_dir")), decimal(g("lon"), g("lon_dir"))
    return _record(
        message_type=F.lit("fb"), airport=g("airport"), callsign=g("callsign"), destination=g("dest"), report_time=g("time"), raw_data=g("unknown"), latitude=F.nullif(lat, F.lit(0.0)), longitude=F.nullif(lon, F.lit(0.0))
    )


def _report(g) -> Column:
    lat, lon = degrees(g("lat"), g("lat_dir"), False), degrees(g("lon"), g("lon_dir"), True)
    return _record(
        message_type=F.lit("pos"), origin=g("origin"), destination=g("dest"), report_time=g("time1"), latitude=F.nullif(lat, F.lit(0.0)), longitude=F.nullif(lon, F.lit(0.0)), flight_level=F.nullif(g("fl").cast("bigint"), F.lit(0).cast("bigint"))
    )


FORMATS = tuple(Format(n, p) for n, p in BRIEFS.items())


def _brief(t: Column) -> Column:
    return first_of(t, list(zip(FORMATS, (_runways(t), _flight_brief, _report))))


def _offered(t: Column) -> Column:
    return ~t.contains("|") & ~t.contains("\\") & (t.contains("T/O RWY") | t.contains("/FB ") | t.startswith("POS"))


DECODERS = [Decoder("label44", "label44", ("44",), 100, _offered, _brief, upper=False, formats=FORMATS)]
