"""Flight plans, predicted winds, trajectories and maintenance reports of label H1.

Fixed values: names, labels, priorities, section marks and patterns of the messages.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aerolith.decoders.engine import Decoder, bind, degrees, number, onward, onward_items, signed, text_of, to_java, whole
from aerolith.decoders.notes import find, find_all, find_int, find_number, record
from aerolith.functions.crc import sound

APPROACHES = ("RNAV", "RNVY", "ILS", "VOR", "NDB", "LOC", "LDA", "GPS", "RNP")


def waypoint_name(name: Column) -> Column:
    """Two to six capitals and digits, with two letters or more, at most two digits, and these last or behind three letters."""
    letters = F.length(F.regexp_replace(name, "[^A-Z]", ""))
    digits = F.length(F.regexp_replace(name, "[^0-9]", ""))
    return name.rlike(r"\A[A-Z0-9]{2,6}\z") & ~name.rlike(r"\A[PLNAB][0-9]+\z") & (letters >= 2) & (digits <= 2) & ~name.rlike(r"\A(?:[0-9]*[A-Z]){0,2}[0-9]*[0-9].{2,}")


def waypoint(segment: Column) -> Column:
    """A named point with its coordinates, 0 where there are none; null if the name is none."""
    name = F.substring_index(segment, ",", 1)
    where = F.when(segment.contains(","), onward(segment, F.length(name) + 2)).otherwise(F.lit(""))
    form = r"\A(.)(.{4,}?)([EW])(.+)\z"
    part = lambda i: F.regexp_extract(where, form, i)
    read = (F.length(where) >= 11) & where.rlike(form)
    zero = F.lit(0.0)
    lat = F.when(read, degrees(part(2), part(1), False)).otherwise(zero)
    lon = F.when(read, degrees(part(4), part(3), True)).otherwise(zero)
    return F.when(waypoint_name(name), F.struct(name.alias("name"), F.nullif(lat, zero).alias("latitude"), F.nullif(lon, zero).alias("longitude")))


def waypoints(parts: Column, plain: bool) -> Column:
    made = F.filter(F.transform(parts, lambda p: waypoint(F.substring_index(p, ".", 1) if plain else p)), lambda w: w.isNotNull())
    return F.when(F.size(made) > 0, made)


def section(plan: Column, mark: str) -> Column:
    return F.regexp_extract(plan, rf"(?s):{mark}:(.*?)(?::[A-Z]{{1,2}}:|\z)", 1)


def truncated(text: Column, route: Column) -> Column:
    """Whether a flight plan lost its end or doesn't fit its checksum."""
    t = F.trim(text, F.lit(" \t\r\n"))
    check = F.substring(t, -4, 4)
    last = F.regexp_extract(route, r",([^,]*)\z", 1)
    return (
        F.when(t.contains("#M1") & ~t.contains("#MD"), F.lit(True))
        .when(t.contains("/WD") & check.rlike(r"\A[0-9A-Fa-f]{4}\z"), ~sound(F.substring(t, F.lit(1), F.length(t) - 4), check))
        .otherwise(t.rlike(r"(?::|,|\.\.)\z") | (last.rlike(r"\A[NS][0-9]") & (F.length(last) < 13)))
    )


def _fpn(text: Column) -> Column:
    def made(plan: Column) -> Column:
        da, aa = section(plan, "DA"), section(plan, "AA")
        origin, destination = (F.when(F.length(x) >= 4, F.substring(x, 1, 4)) for x in (da, aa))
        listed = F.regexp_replace(section(plan, "F"), r"(?s)/(?:FN|RP|SN).*\z", "")
        inline = F.when(F.substring(aa, 5, 2) == "..", onward(aa, 7)).otherwise(F.lit(""))
        route = F.when(listed != "", listed).otherwise(inline)
        approach = F.substring_index(section(plan, "AP"), "/", 1)
        first = F.trim(F.substring_index(F.substring_index(approach, "..", 1), ",", 1))
        spaced = F.locate(" ", first) > 1
        kind = F.regexp_extract(first, rf"\A({'|'.join(APPROACHES)})", 1)
        after = onward(first, F.length(kind) + 1)
        kind_of = lambda k: F.when(k == "RNVY", F.lit("RNAV")).otherwise(k)
        approach_type = F.when(spaced, kind_of(F.substring_index(first, " ", 1))).when(kind != "", kind_of(kind)).otherwise(first)
        runway = F.when(spaced, F.substring_index(F.trim(F.regexp_replace(first, r"\A\S+ ", "")), ".", 1)).when(kind != "", F.regexp_extract(after, r"\A(\d\d[LRC]?)", 1))
        dep, arr = section(plan, "D"), section(plan, "A")
        head = F.regexp_extract(F.regexp_extract(plan, r"(?s)\A(.*?)(?::[A-Z]{1,2}:|\z)", 1), r"/FN([A-Z]{2,3}\d{1,4}[A-Z]{0,2})", 1)
        flight = F.coalesce(text_of(head), find(plan, r"/FN([A-Z]{2,3}\d{1,4}[A-Z]{0,2})"))
        split = lambda x: (text_of(F.when(F.locate(".", x) > 1, F.substring_index(x, ".", 1)).otherwise(x)), text_of(F.when(F.locate(".", x) > 1, F.regexp_replace(x, r"(?s)\A[^.]*\.", ""))))
        (departure, departure_transition), (arrival, arrival_transition) = split(dep), split(arr)
        full = F.struct(
            flight.alias("flight_num"), origin.alias("origin"), destination.alias("destination"), text_of(route).alias("route"), waypoints(F.split(route, r"\.\."), True).alias("waypoints"), departure.alias("departure"),
            departure_transition.alias("departure_transition"), arrival.alias("arrival"), arrival_transition.alias("arrival_transition"), text_of(first).alias("approach"), text_of(approach_type).alias("approach_type"),
            text_of(runway).alias("approach_runway"), text_of(approach).alias("approach_route"), waypoints(onward_items(F.split(approach, r"\.\."), 2), False).alias("approach_waypoints"), F.nullif(truncated(text, route), F.lit(False)).alias("truncated"),
        )
        return F.when(origin.isNotNull() & destination.isNotNull(), full)

    return bind(F.regexp_replace(text, r"[\r\n\t]", ""), made)


def _altitude_winds(data: Column) -> Column:
    def one(p: Column) -> Column:
        cut = lambda a, n: whole(F.substring(p, a, n))
        wide = F.struct(cut(1, 3).alias("flight_level"), cut(4, 3).alias("wind_dir"), cut(7, 3).alias("wind_speed"))
        narrow = F.struct(cut(1, 2).alias("flight_level"), cut(3, 3).alias("wind_dir"), cut(6, 3).alias("wind_speed"))
        late = F.struct(cut(1, 3).alias("flight_level"), cut(4, 3).alias("wind_dir"), cut(7, 2).alias("wind_speed"))
        return F.when(p.rlike(r"\A\d{9}\z"), wide).when(p.rlike(r"\A\d{8}\z"), F.when(cut(6, 3) > 200, late).otherwise(narrow))

    made = F.filter(F.transform(F.split(data, r"\."), one), lambda w: (w["flight_level"] > 0) & (w["wind_dir"] > 0))
    return F.when(F.size(made) > 0, made)


def _layer(data: Column) -> Column:
    level = whole(F.regexp_extract(data, r"\A(\d+),", 1))
    java = F.lit(to_java(r"(?:,|\.)([A-Z]{2,6})\.?,(\d{6})(?:,(\d+[MP]\d+|[MP]\d+))?")[0])
    every = F.arrays_zip(*[F.regexp_extract_all(data, java, i).alias(f"g{i}") for i in (1, 2, 3)])
    temp = lambda x: F.when(x["g3"].contains("M"), -whole(F.regexp_extract(x["g3"], r"M(\d+)", 1))).otherwise(whole(F.regexp_extract(x["g3"], r"P(\d+)", 1)))
    zero = F.lit(0).cast("bigint")
    points = F.transform(every, lambda x: F.struct(x["g1"].alias("waypoint"), whole(F.substring(x["g2"], 1, 3)).alias("wind_dir"), whole(F.substring(x["g2"], 4, 3)).alias("wind_speed"), F.nullif(temp(x), zero).alias("temperature")))
    return F.when((level != 0) & (F.size(points) > 0), F.struct(level.alias("flight_level"), points.alias("waypoints")))


def _pwi(text: Column) -> Column:
    body = F.regexp_replace(onward(text, F.locate("PWI/", text) + 4), r"\r?\n", "")

    def made(parts: Column) -> Column:
        last = lambda mark: F.element_at(F.filter(parts, lambda p: p.startswith(mark)), -1)
        data = lambda mark: onward(F.when(F.exists(parts, lambda p: p.startswith(mark)), last(mark)), 3)
        layers = F.filter(F.transform(F.filter(parts, lambda p: p.startswith("WD")), lambda p: _layer(onward(p, 3))), lambda x: x.isNotNull())
        return record(
            "climb_winds", "descent_winds", "route_winds", report_time=text_of(F.substring_index(data("TS"), ",", 1)), climb_winds=_altitude_winds(data("CB")), descent_winds=_altitude_winds(data("DD")), route_winds=F.when(F.size(layers) > 0, layers)
        )

    return bind(F.split(body, "/"), made)


def _trajectory(text: Column) -> Column:
    t = F.regexp_replace(text, r"\r\n?", "\n")
    head = r"^\+\+\d+,\s*([A-Z0-9-]+),([A-Z0-9-]+),(\d{6}),([A-Z0-9]*),([A-Z]{4}),([A-Z]{4}),(\d+),([A-Z0-9-]+)"
    spot = r"([NS])(\d{2})(\d{2}\.\d),([EW])(\d{2,3})(\d{2}\.\d),(\d{6}),(-?\d+),\s*([+-]?\d+\.?\d*),(\d+),(\d+),([A-Z]{2}),"
    zero, none = F.lit(0).cast("bigint"), F.lit(0.0)
    made = lambda a, b, c, d, e, f, g, h, i, j, k, m: F.struct(
        signed(number(b) + number(c) / 60, a).alias("latitude"), signed(number(e) + number(f) / 60, d).alias("longitude"), g.alias("time"), whole(h).alias("altitude"), F.nullif(number(i), none).alias("temperature"),
        F.nullif(whole(j), zero).alias("heading"), F.nullif(whole(k), zero).alias("speed"), m.alias("phase"),
    )
    return F.when(
        t.rlike(to_java(head)[0]),
        record(
            "positions", registration=find(t, head), aircraft_type=find(t, head, 2), date=find(t, head, 3), flight_number=find(t, head, 4), origin=find(t, head, 5), destination=find(t, head, 6), distance=find_int(t, head, 7), system_id=find(t, head, 8),
            positions=find_all(t, spot, 12, made),
        ),
    )


# Engine parameters, with the fields they fill and whether these are whole numbers.
ENGINE = {
    "N1": ("n1", False), "N2": ("n2", False), "ITT": ("itt", True), "PS3": ("ps3", True), "N1 VIBES": ("n1_vibes", False), "N2 VIBES": ("n2_vibes", False), "OIL TEMP": ("oil_temp", True), "OIL PRESSURE": ("oil_press", True), "PLA": ("pla", False),
    "FUEL FLOW": ("fuel_flow", True), "VG POSITION": ("vg_pos", False),
}


def _mdc(text: Column) -> Column:
    report = F.trim(find(text, r"MDC REPORT:\s*([A-Z ]+?)\s*[\r\n]"))
    java = F.lit(to_java(r"([LR])\s+([A-Z0-9 ]+?)\s+([\d.-]+)\s*([A-Z%]+)")[0])
    readings = F.arrays_zip(*[F.regexp_extract_all(text, java, i).alias(f"g{i}") for i in (1, 2, 3)])

    def trend(rows: Column) -> Column:
        def last(letter: str, name: str) -> Column:
            hits = F.filter(rows, lambda x: (x["g1"] == letter) & (F.trim(x["g2"]) == name))
            return F.nullif(number(F.get(hits, F.size(hits) - 1)["g3"]), F.lit(0.0))

        fields = {}
        for name, (column, is_whole) in ENGINE.items():
            for side, letter in (("left", "L"), ("right", "R")):
                value = last(letter, name)
                fields[f"{side}_{column}"] = value.cast("bigint") if is_whole else value
        fields |= {
            "fadec_control": text_of(F.trim(find(text, r"FADEC IN CONTROL\s+([A-Z0-9 ]+)"))), "airspeed": find_number(text, r"COMPUTED AIRSPEED\s+([\d.]+)"), "altitude": find_int(text, r"ALTITUDE\s+(\d+)"),
            "total_air_temp": F.nullif(number(find(text, r"TOTAL AIR TEMP\s+([+-]?[\d.]+)")), F.lit(0.0)),
        }
        return record(*fields, **fields)

    blocks = F.filter(F.split(text, r"(?=ATA\d{2}-\d{2}\s)"), lambda s: s.rlike(r"\AATA\d{2}-\d{2}[ \t\n\f\r]+[A-Z /-]"))
    line = r"^ATA(\d{2}-\d{2})\s+([A-Z /-]+)"
    faults = F.transform(blocks, lambda s: F.struct(find(s, line).alias("ata"), F.trim(find(s, line, 2)).alias("system"), find(s, r"Equation ID:\s*([A-Z0-9-]+)").alias("equation_id")))
    return F.when(
        report.isNotNull(),
        record(
            report_type=report, write_option=text_of(F.trim(find(text, r"WRITE OPTION:\s*([^\r\n]+)"))), filename=find(text, r"FILENAME:\s*([A-Z0-9._]+)"), time=find(text, r"TIME:\s*(\d{2}:\d{2})"),
            date=find(text, r"DATE:\s*(\d{2}[A-Za-z]{3}\d{4})"), application_pn=find(text, r"MDC APPLICATION PN:\s*([0-9-]+)"), tables_pn=find(text, r"MDC TABLES PN:\s*([0-9-]+)"), leg_number=find(text, r"LEG:\s*(\d+)"),
            engine_trend=F.when(report == "ENGINE TREND", bind(readings, trend)), faults=F.when(report.isin("CURRENT FAULTS", "FAULT HISTORY") & (F.size(faults) > 0), faults),
        ),
    )


DECODERS = [
    Decoder("fpn", "flight_plan", ("H1", "4A", "HX"), 10, lambda t: t.contains("FPN") & t.contains(":DA:"), _fpn, upper=False),
    Decoder("pwi", "pwi", ("H1",), 30, lambda t: t.contains("PWI/"), _pwi, upper=False),
    Decoder("mdc", "mdc", ("H1",), 40, lambda t: t.contains("MDC REPORT:"), _mdc, upper=False),
    Decoder("trajectory", "trajectory", ("H1",), 50, lambda t: t.startswith("++86501") | t.startswith("++76502"), _trajectory, upper=False),
]
