"""Position, status and service messages with a declared format each.

Fixed values: names, labels, priorities, formats and code tables of the messages.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aerolith.decoders.engine import Decoder, Format, bind, count_of, decimal, degrees, first_of, number, onward, onward_items, signed, text_of, whole


def _map(pairs: dict[str, str]) -> Column:
    return F.expr(f"map({', '.join(repr(x) for pair in pairs.items() for x in pair)})")


def _struct(**fields: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _somewhere(s: Column) -> Column:
    """The record unless it lies at 0, 0, which stands for an unread position."""
    return bind(s, lambda r: F.when((r["latitude"] != 0) | (r["longitude"] != 0), r))


def _begins(*heads: str):
    return lambda t: F.coalesce(*[F.nullif(t.startswith(h), F.lit(False)) for h in heads], F.lit(False))


def _holds(*parts: str):
    return lambda t: F.coalesce(*[F.nullif(t.contains(p), F.lit(False)) for p in parts], F.lit(False))


# Squitters: airport, position and frequency of ground stations.


def _squitter(g) -> Column:
    lat, lon = g("lat"), g("lon")
    part = lambda c, a, n: F.substring(c, a, n).try_cast("int")
    north = F.when((part(lat, 2, 2) <= 90) & (part(lat, 4, 2) <= 59), part(lat, 2, 2) + part(lat, 4, 2) / 60)
    degree = part(lon, 1, 1) * 100 + part(lon, 2, 2)
    east = F.when((part(lon, 1, 1) <= 1) & (degree <= 180) & (part(lon, 4, 2) <= 59), degree + part(lon, 4, 2) / 60)
    return _struct(
        message_type=g("msg_type"), iata_code=g("iata"), icao_code=g("icao"), latitude=F.coalesce(signed(north, g("lat_dir")), F.lit(0.0)), longitude=F.coalesce(signed(east, g("lon_dir")), F.lit(0.0)),
        freq_band=g("freq_band"), freq_mhz=F.nullif(number(g("freq")) / 1000, F.lit(0.0)),
    )


_PLACE = r"(?P<iata>{IATA})(?P<icao>{ICAO})(?P<lat>{LAT_5D})(?P<lat_dir>{LAT_DIR})(?P<lon>{LON_5D})(?P<lon_dir>{LON_DIR})"
SQ = [
    (Format("arinc_position", r"^02X(?P<msg_type>[AS])" + _PLACE + r"(?P<freq_band>[VB])(?P<freq>{LON_6D})"), _squitter),
    (Format("avicom_frequency", r"^02J(?P<msg_type>[A-Z])" + _PLACE + r"(?P<freq_band>[VBT])(?P<freq>\d{6})"), _squitter),
]

# Label 10


def _rich(g) -> Column:
    def rest(f: Column) -> Column:
        n = F.size(f)
        at = lambda i: F.when(n >= 5, F.coalesce(F.get(f, F.lit(i)), F.lit("")))
        four = lambda i: F.when(F.length(at(i)) == 4, at(i))
        tail = F.transform(onward_items(f, 9), lambda x: F.trim(x))
        name = lambda x: x.rlike("[A-Za-z]") & F.length(x).between(2, 7)
        after = lambda i: F.coalesce(F.get(tail, i + 1), F.lit(""))
        pairs = F.filter(F.transform(tail, lambda x, i: F.when(name(x), F.struct(x.alias("name"), F.when(after(i).rlike(r"\A[0-9]{4}\z"), after(i)).alias("eta")))), lambda x: x.isNotNull())
        return _struct(
            latitude=decimal(g("lat"), g("lat_dir")), longitude=decimal(g("lon"), g("lon_dir")), mach=F.nullif(number(at(1)), F.lit(0.0)), heading=count_of(at(2)), flight_level=count_of(at(3)),
            destination=four(4), eta=four(5), fuel=count_of(at(6)), distance=count_of(at(7)), waypoints=F.when(F.size(pairs) > 0, pairs),
        )

    return bind(F.split(g("rest"), "/"), rest)


LABEL10 = [(Format("rich_position", r"^/(?P<lat_dir>{LAT_DIR})(?P<lat>[\d.]+)/(?P<lon_dir>{LON_DIR})(?P<lon>[\d.]+)/(?P<rest>.*)"), _rich)]

# Label 16

_SPOT = r"(?P<lat_dir>[NS])\s*(?P<lat>[\d.]+)[,\s]+(?P<lon_dir>[EW])\s*(?P<lon>[\d.]+)"
_WAY = r"\s*,(?P<lat_dir>[NS])\s*(?P<lat>[\d.]+),(?P<lon_dir>[EW])\s*(?P<lon>[\d.]+),(?P<altitude>\d+),\s*(?P<ground_speed>\d+),(?P<eta>\d+),\s*(?P<track>\d+)"


def _level(c: Column) -> Column:
    feet = whole(F.regexp_replace(F.regexp_replace(c, r"\A\+", ""), r"\AM", ""))
    return F.nullif(F.when(feet > 1000, F.floor(feet / 100)).otherwise(feet), F.lit(0).cast("bigint"))


def _label16(g, time=None, flight=None, waypoint=None, level=None, speed=None, eta=None, track=None, compact=False) -> Column:
    def spot(digits, side, lon):
        if not compact:
            return decimal(digits, side)
        n = 3 if lon else 2
        value = F.substring(digits, 1, n).try_cast("double") + F.substring(digits, n + 1, 2).try_cast("double") / 60 + F.substring(digits, n + 3, 2).try_cast("double") / 3600
        return F.coalesce(signed(value, side), F.lit(0.0))

    none, gone = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    return _somewhere(
        _struct(
            time=text_of(g(time)) if time else none, flight=flight if flight is not None else none, waypoint=text_of(g(waypoint)) if waypoint else none, latitude=spot(g("lat"), g("lat_dir"), False),
            longitude=spot(g("lon"), g("lon_dir"), True), flight_level=_level(g(level)) if level else gone, ground_speed=count_of(g(speed)) if speed else gone, eta=text_of(g(eta)) if eta else none,
            track=count_of(g(track)) if track else gone,
        )
    )


LABEL16 = [
    (Format("csv_position", r"^(?P<time>\d{6}),(?P<altitude>[+M]?\d+),(?P<speed>\d+),\s*(?P<track>\d+)," + _SPOT), lambda g: _label16(g, time="time", level="altitude", speed="speed", track="track")),
    (Format("csv_position_no_alt", r"^(?P<time>\d{6}),,(?P<speed>\d+),\s*(?P<track>\d+)," + _SPOT), lambda g: _label16(g, time="time", speed="speed", track="track")),
    (
        Format("waypoint_position_prefixed", r"^M(?P<msg_seq>\d{2})A(?P<prefix_airline>[A-Z0-9]{2})(?P<prefix_flight>[A-Z0-9]{4})(?P<waypoint>[A-Z][A-Z0-9]*)" + _WAY),
        lambda g: _label16(g, flight=F.concat(g("prefix_airline"), F.regexp_replace(g("prefix_flight"), r"\A0+", "")), waypoint="waypoint", level="altitude", speed="ground_speed", eta="eta", track="track"),
    ),
    (Format("waypoint_position", r"^(?P<waypoint>[A-Z0-9]{2,8})" + _WAY), lambda g: _label16(g, waypoint="waypoint", level="altitude", speed="ground_speed", eta="eta", track="track")),
    (Format("autpos", r"^(?P<time>\d{6})/AUTPOS/LLD\s+(?P<lat_dir>[NS])(?P<lat>\d{6})\s+(?P<lon_dir>[EW])(?P<lon>\d{7})"), lambda g: _label16(g, time="time", compact=True)),
]

# Labels 21 and 22

LABEL21 = [
    (
        Format(
            "posn_report",
            r"POSN\s+(?P<lat>{LAT_DEC})(?P<lon_dir>{LON_DIR})(?P<lon>[\d.]+),\s*(?P<heading>\d+),(?P<time>\d+),(?P<altitude>\d+),(?P<fob>\d+),\s*(?P<wind>[-\d ]+),\s*(?P<temp>[-\d ]+),(?P<eta>\d+),(?P<dest>{ICAO})",
        ),
        lambda g: _struct(
            latitude=F.coalesce(number(g("lat")), F.lit(0.0)), longitude=decimal(g("lon"), g("lon_dir")), heading=count_of(g("heading")), altitude=count_of(g("altitude")), fuel_on_board=count_of(g("fob")),
            wind=text_of(F.trim(g("wind"))), temperature=text_of(F.trim(g("temp"))), eta=text_of(g("eta")), destination=text_of(g("dest")),
        ),
    )
]


def _dms(g) -> Column:
    def rest(f: Column) -> Column:
        at = lambda i: F.trim(F.coalesce(F.get(f, F.lit(i)), F.lit("")))
        level = whole(F.substring(at(7), 1, 3))
        track = whole(at(9))
        mach = whole(F.trim(F.regexp_replace(at(6), r"\AM", "")))
        return _struct(
            latitude=degrees(g("lat"), g("lat_dir"), False), longitude=degrees(g("lon"), g("lon_dir"), True), report_time=F.when(at(1).rlike(r"\A[0-9]{6}\z"), at(1)), altitude=count_of(at(2)),
            mach=F.when(at(6).startswith("M"), 0.8 + mach / 100), flight_level=F.when((F.length(at(7)) >= 3) & level.between(100, 500), level), ground_speed=count_of(at(8)),
            track=F.nullif(F.when(track.between(0, 360), track), F.lit(0).cast("bigint")), raw_data=text_of(g("rest")),
        )

    return bind(F.split(g("rest"), ","), rest)


LABEL22 = [(Format("dms_position", r"^(?P<lat_dir>{LAT_DIR})\s*(?P<lat>{LAT_DMS})(?P<lon_dir>{LON_DIR})\s*(?P<lon>{LON_DMS}),(?P<rest>.*)"), _dms)]

# Labels 4J, 5L, 80, 83


def _label4j(t: Column) -> Column:
    burn = Format("fuel_burn", r"/FB(?P<fuel_burn>\d+)").captures(t, lambda g: count_of(g("fuel_burn")))
    form = Format(
        "pos_weather",
        r"/PSN(?P<lat>{LAT_5D})(?P<lon_dir>{LON_DIR})(?P<lon>{LON_6D}),(?P<time>{TIME6}),(?P<heading>\d+),(?P<curr_wpt>[A-Z0-9]+),(?P<eta>\d+),(?P<next_wpt>[A-Z0-9]+),(?P<temp>{TEMP_SIGN}\d+),(?P<altitude>\d+)",
    )
    return form.captures(
        t,
        lambda g: _somewhere(
            _struct(
                latitude=degrees(g("lat"), F.lit("N"), False), longitude=degrees(g("lon"), g("lon_dir"), True), heading=count_of(g("heading")), altitude=count_of(g("altitude")), temperature=text_of(g("temp")),
                current_waypoint=text_of(g("curr_wpt")), next_waypoint=text_of(g("next_wpt")), eta=text_of(g("eta")), fuel_burn=burn,
            )
        ),
    )


LABEL5L = [
    (
        Format(
            "route",
            r"^\.?(?P<callsign>[A-Z0-9]+),\.?(?P<tail>[A-Z0-9-]+),(?P<origin_iata>[A-Z]{3}),(?P<origin_icao>{ICAO}),(?P<dest_iata>[A-Z-]{3}),(?P<dest_icao>{ICAO})"
            + "".join(rf"(?:,(?P<{n}>[^,]*))?" for n in ("flight_id", "date", "dep_sched", "dep_actual", "arr_sched", "arr_actual")),
        ),
        lambda g: _struct(
            **{n: text_of(g(n)) for n in ("callsign", "tail", "origin_iata", "origin_icao")}, dest_iata=F.nullif(text_of(g("dest_iata")), F.lit("---")),
            **{n: text_of(g(n)) for n in ("dest_icao", "flight_id", "date", "dep_sched", "dep_actual", "arr_sched", "arr_actual")},
        ),
    )
]
# The parts of a label 80 report.
LABEL80 = {
    "header": r"\d+\s+(?P<msg_type>\w+)\s+\S+\s+(?P<origin>{ICAO})/(?P<dest>{ICAO})\s+\.?(?P<tail>\S+)",
    "flight": r"^(?P<flight>[A-Z0-9]+),(?P<origin>{ICAO}),(?P<dest>{ICAO})",
    "position": r"/POS\s+(?P<lat_dir>{LAT_DIR})(?P<lat>\d+\.?\d*)[/\s]*(?P<lon_dir>{LON_DIR})(?P<lon>\d+\.?\d*)",
    "altitude": r"/(?:ALT|FL)\s+\+?(?P<x>\d+)",
    "mach": r"/MCH\s+(?P<x>\d+)",
    "tas": r"/TAS\s+(?P<x>\d+)",
    "fuel_on_board": r"/FOB\s+[N]?(?P<x>\d+)",
    "eta": r"/ETA\s+(?P<x>\d+[:\.]?\d*)",
    "out_time": r"/OUT\s+(?P<x>\d+)",
    "off_time": r"/OFF\s+(?P<x>\d+)",
    "on_time": r"/ON\s+(?P<x>\d+)",
    "in_time": r"/IN\s+(?P<x>\d+)",
}


def _label80(t: Column) -> Column:
    one = lambda name: _one(t, LABEL80[name])
    place = Format("position", LABEL80["position"]).captures(t, lambda g: F.struct(decimal(g("lat"), g("lat_dir")).alias("lat"), decimal(g("lon"), g("lon_dir")).alias("lon")))
    zero = F.lit(0.0)
    return Format("header", LABEL80["header"]).captures(
        t,
        lambda g: bind(
            place,
            lambda p: _struct(
                msg_type=g("msg_type"), origin_icao=g("origin"), dest_icao=g("dest"), tail=g("tail"), latitude=F.nullif(p["lat"], zero), longitude=F.nullif(p["lon"], zero), altitude=count_of(one("altitude")), mach=one("mach"),
                tas=count_of(one("tas")), fuel_on_board=count_of(one("fuel_on_board")), eta=one("eta"), out_time=one("out_time"), off_time=one("off_time"), on_time=one("on_time"), in_time=one("in_time"),
            ),
        ),
    )


def _label83(g, kind: str) -> Column:
    pr = kind == "PR"
    none = F.lit(None)
    return _struct(
        message_type=F.lit(kind), day_of_month=count_of(g("day")) if pr else none.cast("bigint"), report_time=text_of(g("time")), latitude=degrees(g("lat"), g("lat_dir"), False) if pr else F.coalesce(number(g("lat")), F.lit(0.0)),
        longitude=degrees(g("lon"), g("lon_dir"), True) if pr else F.coalesce(number(g("lon")), F.lit(0.0)), altitude=count_of(g("altitude")), heading=none.cast("bigint") if pr else count_of(g("heading")),
        ground_speed=none.cast("double") if pr else F.nullif(number(g("ground_speed")), F.lit(0.0)), origin=none.cast("string") if pr else g("origin"), destination=none.cast("string") if pr else g("dest"),
    )


LABEL83 = [
    (Format("pr_position", r"\d{3}PR(?P<day>\d{2})(?P<time>{TIME6})(?P<lat_dir>{LAT_DIR})(?P<lat>\d{4}\.\d)(?P<lon_dir>{LON_DIR})(?P<lon>\d{5}\.\d)(?P<altitude>{LON_6D})"), lambda g: _label83(g, "PR")),
    (
        Format("zspd_position", r"(?P<origin>{ICAO}),(?P<dest>{ICAO}),(?P<time>{TIME6}),\s*(?P<lat>{LAT_DEC}),\s*(?P<lon>{LON_DEC}),(?P<altitude>\d+),(?P<heading>{HEADING}),\s*(?P<ground_speed>[\d.]+)"),
        lambda g: _label83(g, "ZSPD"),
    ),
]

# Labels B2, B3, RF


def _one(t: Column, pattern: str) -> Column:
    return text_of(F.regexp_extract(t, Format("part", pattern).java()[0], 1))


def _oceanic(t: Column) -> Column:
    fixes = F.regexp_extract_all(t, F.lit(r"(\d{2}[NS]\d{3}[EW])"), 1)
    flight = F.coalesce(_one(t, r"^(?P<x>[A-Z]{3}\d+)"), text_of(F.regexp_extract(t, r"(?m)^[ \t\r\f]*([A-Z]{3}\d[A-Z0-9]*)", 1)))
    level, mach = _one(t, r"F(?P<x>\d{3})"), _one(t, r"M0?(?P<x>\d{2,3})")
    made = _struct(
        flight_num=flight, destination=_one(t, r"CLRD TO (?P<x>\w{4})"), oceanic_fixes=F.when(F.size(fixes) > 0, fixes), flight_level=F.concat(F.lit("FL"), level), mach=F.concat(F.lit("M"), mach)
    )
    return bind(made, lambda r: F.when(r["destination"].isNotNull() | r["oceanic_fixes"].isNotNull(), r))


def _gate_info(t: Column) -> Column:
    main = Format("gate_info", r"(?P<flight>[A-Z0-9]+)-(?P<origin>{ICAO})-GATE\s+(?P<gate>\S+)-(?P<dest>{ICAO})")
    part = lambda n: main.captures(t, lambda g: text_of(g(n)))
    made = _struct(flight_num=part("flight"), origin=part("origin"), destination=part("dest"), gate=part("gate"), atis=_one(t, r"ATIS\s+(?P<x>{ATIS})"), aircraft_type=_one(t, r"-TYP/(?P<x>[A-Z0-9]+)"))
    return bind(made, lambda r: F.when(F.coalesce(r["flight_num"], r["gate"], r["atis"]).isNotNull(), r))


# Four-letter codes of airports by their three-letter codes.
AIRPORTS = {
    "SYD": "YSSY", "MEL": "YMML", "BNE": "YBBN", "PER": "YPPH", "ADL": "YPAD", "CBR": "YSCB", "HBA": "YMHB", "AKL": "NZAA", "WLG": "NZWN", "CHC": "NZCH",
    "SIN": "WSSS", "HKG": "VHHH", "NRT": "RJAA", "HND": "RJTT", "ICN": "RKSI", "PEK": "ZBAA", "PKX": "ZBAD", "PVG": "ZSPD", "SHA": "ZSSS", "CAN": "ZGGG",
    "TPE": "RCTP", "KUL": "WMKK", "BKK": "VTBS", "DEL": "VIDP", "BOM": "VABB", "BLR": "VOBL", "MNL": "RPLL", "CGK": "WIII", "DPS": "WADD", "CTS": "RJCC",
    "LHR": "EGLL", "LGW": "EGKK", "CDG": "LFPG", "FRA": "EDDF", "AMS": "EHAM", "FCO": "LIRF", "MAD": "LEMD", "BCN": "LEBL", "MUC": "EDDM", "ZRH": "LSZH",
    "VIE": "LOWW", "IST": "LTFM", "LAX": "KLAX", "SFO": "KSFO", "JFK": "KJFK", "EWR": "KEWR", "ORD": "KORD", "DFW": "KDFW", "ATL": "KATL", "MIA": "KMIA",
    "SEA": "KSEA", "YVR": "CYVR", "YYZ": "CYYZ", "YUL": "CYUL", "DXB": "OMDB", "AUH": "OMAA", "DOH": "OTHH", "RUH": "OERK", "JED": "OEJN", "GRU": "SBGR",
    "EZE": "SAEZ", "SCL": "SCEL", "JNB": "FAOR", "CPT": "FACT",
}


def _icao(c: Column) -> Column:
    return F.element_at(_map(AIRPORTS), c)


LABELRF = [
    (
        Format(
            "flight_subscription",
            r"^,(?P<msg_type>FD(?:ASUB|ACOM|AACK)|FSTREQ)\d+,(?P<origin>[A-Z]{3}),,(?P<dest>[A-Z]{3}),,(?P<flight>{FLIGHT}),(?P<date>\d{6}),(?P<time>\d{4}),(?P<actype>[^,]*),,(?P<reg>[^,]*),",
        ),
        lambda g: _struct(
            msg_type=g("msg_type"), origin_iata=g("origin"), origin_icao=_icao(g("origin")), dest_iata=g("dest"), dest_icao=_icao(g("dest")), flight_num=g("flight"), date=g("date"), time=g("time"),
            aircraft_type=text_of(g("actype")), registration=text_of(g("reg")),
        ),
    )
]

# Status reports: AGFSR, FST, ETA


def _agfsr(g) -> Column:
    place = Format("position", r"(?P<lat>\d{4}\.\d)(?P<lat_dir>{LAT_DIR})(?P<lon>\d{5}\.\d)(?P<lon_dir>{LON_DIR})").captures(
        g("position"), lambda p: F.struct(degrees(p("lat"), p("lat_dir"), False).alias("lat"), degrees(p("lon"), p("lon_dir"), True).alias("lon"))
    )
    mach = F.substring(g("mach"), 2, 2).try_cast("double") / 100
    a, b = whole(g("field1")), whole(g("field2"))
    first, second = F.coalesce(a >= 100, F.lit(False)), F.coalesce(b >= 100, F.lit(False))
    timed = lambda c: F.when(~c.isin("----", "****"), text_of(c))
    zero = F.lit(0.0)
    return bind(
        place,
        lambda p: _struct(
            flight_number=g("flight"), day_of_month=count_of(g("day1")), route=g("route"), origin=F.substring(g("route"), 1, 3), destination=F.substring(g("route"), 4, 3), report_time=g("time"), unknown1=g("unknown1"),
            latitude=F.nullif(p["lat"], zero), longitude=F.nullif(p["lon"], zero), flight_level=count_of(g("fl")), phase=g("phase"), fuel_remain=count_of(g("fuel_remain")), fuel_used=count_of(g("fuel_used")),
            mach=F.when(mach < 1, mach + 0.8).otherwise(mach), wind_dir=count_of(F.substring(g("wind"), 1, 3)), wind_speed=count_of(F.substring(g("wind"), 4, 3)), heading=count_of(g("heading")),
            ground_speed=F.nullif(F.when(first, a).otherwise(b), F.lit(0).cast("bigint")), unknown2=text_of(F.when(first, g("field2")).otherwise(g("field1"))), eta=timed(g("eta")), scheduled=timed(g("sched")),
        ),
    )


AGFSR = [
    (
        Format(
            "agfsr_status",
            r"^AGFSR\s+(?P<flight>[A-Z]{2}\d{4})/(?P<day1>\d{2})/(?P<day2>\d{2})/(?P<route>[A-Z]{6})/(?P<time>\d{4}Z)/(?P<unknown1>[^/]+)/(?P<position>[^/]+)/(?P<fl>{HEADING})/(?P<phase>[A-Z]+)/"
            r"(?P<fuel_remain>\d{4})/(?P<fuel_used>\d{4})/(?P<mach>M\d{2})/(?P<wind>\d{6})/(?P<heading>{TIME4})/(?P<field1>[^/]+)/(?P<field2>[^/]+)/(?P<eta>\d{4}|\-{4}|\*{4})/(?P<sched>\d{4}|\-{4}|\*{4})",
        ),
        _agfsr,
    )
]


def _fst(t: Column) -> Column:
    def coordinate(c: Column, side: Column) -> Column:
        two, three = F.substring(c, 1, 2).try_cast("int"), F.substring(c, 1, 3).try_cast("int")
        short = F.when(F.substring(c, 3, 3).try_cast("double") / 10 < 60, two + F.substring(c, 3, 3).try_cast("double") / 600)
        hundredths = F.when(F.substring(c, 3, 4).try_cast("double") / 100 < 60, two + F.substring(c, 3, 4).try_cast("double") / 6000)
        tenths = F.when(F.substring(c, 4, 3).try_cast("double") / 10 < 60, three + F.substring(c, 4, 3).try_cast("double") / 600)
        return F.coalesce(signed(F.when(F.length(c) == 5, short).when(two <= 90, hundredths).otherwise(tenths), side), F.lit(0.0))

    def made(g) -> Column:
        rest = g("rest")
        numbers = F.regexp_extract_all(rest, F.lit(r"(\d{3})"), 1)
        level, heading, speed = whole(F.substring(rest, 1, 3)), whole(F.get(numbers, F.lit(0))), whole(F.get(numbers, F.lit(1)))
        sign, temp = F.regexp_extract(rest, r"([MP])[ \t\n\f\r]*(\d{1,3})C?", 1), whole(F.regexp_extract(rest, r"([MP])[ \t\n\f\r]*(\d{1,3})C?", 2))
        zero = F.lit(0).cast("bigint")
        return _struct(
            sequence=g("seq"), origin=g("origin"), destination=g("dest"), latitude=F.nullif(coordinate(g("lat"), g("lat_dir")), F.lit(0.0)), longitude=F.nullif(coordinate(g("lon"), g("lon_dir")), F.lit(0.0)),
            flight_level=F.nullif(F.when((F.length(rest) >= 3) & level.between(0, 600), level), zero), heading=F.nullif(F.when((F.size(numbers) >= 2) & (heading <= 360), heading), zero),
            ground_speed=F.when((speed > 0) & (speed < 1000), speed), temperature=F.nullif(F.when(sign == "M", -temp).otherwise(temp), zero), raw_data=text_of(rest),
        )

    begun = F.when(t.contains("FST"), onward(t, F.locate("FST", t))).otherwise(t)
    return bind(
        begun,
        lambda b: Format("fst_5digit_lon", r"FST(?P<seq>\d{2})(?P<origin>{ICAO})(?P<dest>{ICAO})(?P<lat_dir>{LAT_DIR})(?P<lat>\d{5,6})(?P<lon_dir>{LON_DIR})(?P<lon>\d{5})(?P<rest>\d.+)").captures(b, made),
    )


def _eta(kind: str, **fields: str):
    def made(g) -> Column:
        out = {n: text_of(g(fields[n])) if n in fields else F.lit(None).cast("string") for n in ("origin", "destination", "report_time", "eta", "mode", "runway", "gate", "raw_data")}
        return _struct(message_type=F.lit(kind), day_of_month=count_of(g("day")) if "day" in fields else F.lit(None).cast("bigint"), **out)

    return made


ETA = [
    (
        Format("et_exp_time", r"/ET\s+EXP\s+TIME\s+/\s*(?P<origin>{ICAO})\s+(?P<dest>{ICAO})\s+(?P<day>\d{2})\s+(?P<time>{TIME6})/EON\s+(?P<eta>{TIME4})(?:\s+(?P<mode>\w+))?"),
        _eta("ET", origin="origin", destination="dest", day="day", report_time="time", eta="eta", mode="mode"),
    ),
    (Format("ir_format", r"/IR\s+(?P<flight>[A-Z]{3}\d+)/.*?/ETA\s+(?P<eta>{TIME4})"), _eta("IR", raw_data="flight", eta="eta")),
    (
        Format("b6_ldg_data", r"/B6\s+LDG\s+DATA\s+REQ/(?P<dest>{ICAO})\s+(?P<eta>{TIME4})(?:\s+\d{2})?/RWY\s*(?P<runway>{RUNWAY})(?:/GATE\s*(?P<gate>[A-Z0-9]+))?"),
        _eta("B6", destination="dest", eta="eta", runway="runway", gate="gate"),
    ),
    (Format("os_format", r"/OS\s+(?P<origin>{ICAO})\s*/(?P<dest>{ICAO})\s*(?P<time>{TIME6})?"), _eta("OS", origin="origin", destination="dest", report_time="time")),
    (Format("c3_route", r"/C3\s+(?P<origin>{ICAO})\s*\.(?P<dest>{ICAO})"), _eta("C3", origin="origin", destination="dest")),
]

# Winds aloft, H1 positions, media advisories, gates


def _h2(t: Column) -> Column:
    form = r"(\d{1,3})([MP])(\d{1,3})(?:(\d{3})(\d{2,3})(G)?)?"
    rest = onward(t, 37)
    every = lambda i: F.regexp_extract_all(rest, F.lit(form), i)
    zero = F.lit(0).cast("bigint")
    layers = F.transform(
        F.arrays_zip(*[every(i).alias(f"g{i}") for i in range(1, 7)]),
        lambda x: F.struct(
            whole(x["g1"]).alias("flight_level"), F.when(x["g2"] == "M", -whole(x["g3"])).otherwise(whole(x["g3"])).alias("temperature"), F.nullif(whole(x["g4"]), zero).alias("wind_dir"),
            F.nullif(whole(x["g5"]), zero).alias("wind_speed"), (x["g6"] == "G").alias("gusting"),
        ),
    )
    head = Format("h2_header", r"^02A(?P<time>{TIME6})(?P<origin>{ICAO})(?P<dest>{ICAO})(?P<lat_dir>{LAT_DIR})(?P<lat>{LAT_5D})(?P<lon_dir>{LON_DIR})(?P<lon>{LON_6D})(?P<datetime>{TIME6})")
    return head.captures(
        t,
        lambda g: _struct(
            origin=g("origin"), destination=g("dest"), latitude=F.nullif(degrees(g("lat"), g("lat_dir"), False), F.lit(0.0)), longitude=F.nullif(degrees(g("lon"), g("lon_dir"), True), F.lit(0.0)), report_time=g("time"),
            wind_layers=F.when(F.size(layers) > 0, layers), raw_data=text_of(F.trim(rest)),
        ),
    )


def _h1pos(g, timed: bool) -> Column:
    temp = whole(F.substring(g("temp"), 2, 10))
    none = F.lit(None)
    zero = F.lit(0).cast("bigint")
    return _struct(
        latitude=degrees(g("lat"), g("lat_dir"), False), longitude=degrees(g("lon"), g("lon_dir"), True), report_time=text_of(g("report_time")) if timed else none.cast("string"), flight_level=count_of(g("altitude")),
        ground_speed=none.cast("bigint") if timed else count_of(g("gs")), current_waypoint=g("curr_wpt"), next_waypoint=g("next_wpt"), third_waypoint=g("wpt3"), eta=g("eta"),
        temperature=F.nullif(F.when(g("temp").startswith("M"), -temp).otherwise(temp), zero), wind_dir=count_of(F.substring(g("wind"), 1, 3)) if timed else none.cast("bigint"), wind_speed=count_of(F.substring(g("wind"), 4, 2)) if timed else none.cast("bigint"),
    )


_H1 = r"^POS(?P<lat_dir>{LAT_DIR})(?P<lat>\d{5})(?P<lon_dir>{LON_DIR})(?P<lon>\d{6}),(?P<curr_wpt>[A-Z]+),"
H1POS = [
    (
        Format("h1_position_time", _H1 + r"(?P<report_time>\d{6}),(?P<altitude>\d+),(?P<next_wpt>[A-Z]+),(?P<eta>\d+),(?P<wpt3>[A-Z]+),(?P<temp>[MP]\d+)(?:,(?P<wind>\d{5}))?(?:,(?P<extra>[A-Z0-9]+))?"),
        lambda g: _h1pos(g, True),
    ),
    (Format("h1_position_alt", _H1 + r"(?P<altitude>\d{3}),(?P<gs>\d+),(?P<next_wpt>[A-Z]+),(?P<eta>\d+),(?P<wpt3>[A-Z]+),(?P<temp>[MP]\d+)"), lambda g: _h1pos(g, False)),
]
# Descriptions of datalink media.
LINKS = {"V": "VHF ACARS", "S": "Default SATCOM", "H": "HF", "G": "Global Star Satcom", "C": "ICO Satcom", "2": "VDL2", "X": "Inmarsat Aero H/H+/I/L", "I": "Iridium Satcom"}


def _media(g) -> Column:
    known = _map(LINKS)
    link = lambda c: F.struct(c.alias("code"), F.element_at(known, c).alias("description"))
    t = g("time")
    part = lambda a: F.substring(t, a, 2)
    valid = (part(1).try_cast("int") <= 23) & (part(3).try_cast("int") <= 59) & (part(5).try_cast("int") <= 59)
    codes = F.regexp_extract_all(g("available"), F.lit("(.)"), 1)
    made = _struct(version=F.lit(0), current_link=link(g("current_link")), established=g("state") == "E", link_time=F.concat_ws(":", part(1), part(3), part(5)), available_links=F.transform(codes, link), text=text_of(g("text")))
    return F.when(valid, made)


MEDIA = [(Format("media_advisory_v0", r"^0(?P<state>[EL])(?P<current_link>[VSHGC2XI])(?P<time>{TIME6})(?P<available>[VSHGC2XI]*)(?:/(?P<text>.*))?$"), _media)]


def _gate(**fields: str):
    def made(g) -> Column:
        s = _struct(**{n: text_of(F.trim(g(fields[n]))) if n in fields else F.lit(None).cast("string") for n in ("gate", "ppos", "bag_belt", "next_flight", "next_route")})
        return bind(s, lambda r: F.when(F.coalesce(r["gate"], r["ppos"], r["next_flight"]).isNotNull(), r))

    return made


GATE = [
    (Format("simple_gate", r"GATE\s+ASSIGNMENT[:\s]+(?P<gate>[A-Z]?\d+)"), _gate(gate="gate")),
    (Format("in_range_gate", r"(?P<station>[A-Z]{3})\s+GATE\s+(?P<gate>\d+)\s+ASSIGNED"), _gate(gate="gate")),
    (
        Format("structured_gate", r"GATE\s+ASSIGNMENT\s*\n\s*\nPPOS:(?P<ppos>[^\n]*)\nBAG\s+BELT:(?P<bagbelt>[^\n]*)\n(?:NEXT\s+LEG:\s*(?P<next_flight>\w+)\s+(?P<next_route>[A-Z]{3}-[A-Z]{3}))?"),
        _gate(ppos="ppos", bag_belt="bagbelt", next_flight="next_flight", next_route="next_route"),
    ),
]


def _first(formats):
    return lambda t: first_of(t, formats)


def _formats(rows) -> tuple[Format, ...]:
    return tuple(form for form, _ in rows)


def _always(t: Column) -> Column:
    return F.lit(True)


DECODERS = [
    Decoder("sq", "sq_position", ("SQ",), 100, _begins("02X", "02J"), _first(SQ), formats=_formats(SQ)),
    Decoder("label10", "label10_position", ("10",), 100, _begins("/N", "/S"), _first(LABEL10), formats=_formats(LABEL10)),
    Decoder("label16", "waypoint_position", ("16",), 100, _always, _first(LABEL16), formats=_formats(LABEL16)),
    Decoder("label21", "position_report", ("21",), 100, _holds("POSN"), _first(LABEL21), formats=_formats(LABEL21)),
    Decoder("label22", "label22_position", ("22",), 100, _holds("N ", "S "), _first(LABEL22), formats=_formats(LABEL22)),
    Decoder("label4j", "pos_weather", ("4J",), 100, _begins("POS"), _label4j),
    Decoder("label5l", "route", ("5L",), 100, _holds(","), lambda t: first_of(F.substring_index(t, "\n", 1), LABEL5L)),
    Decoder("label80", "position", ("80",), 100, _always, _label80),
    Decoder("label83", "label83_position", ("83",), 100, _holds("PR", "ZSPD"), _first(LABEL83), formats=_formats(LABEL83)),
    Decoder("labelb2", "oceanic_clearance", ("B2",), 100, _always, _oceanic),
    Decoder("labelb3", "gate_info", ("B3",), 100, _always, _gate_info),
    Decoder("labelrf", "flight_subscription", ("RF",), 100, _holds("FDASUB", "FDACOM", "FSTREQ"), _first(LABELRF), formats=_formats(LABELRF)),
    Decoder("agfsr", "agfsr", ("4T",), 100, _holds("AGFSR"), _first(AGFSR), formats=_formats(AGFSR)),
    Decoder("fst", "fst", ("15",), 100, _holds("FST"), _fst),
    Decoder("eta", "eta", ("5Z",), 100, _holds("/ET ", "/IR ", "/B6 ", "/OS ", "/C3 "), _first(ETA), formats=_formats(ETA)),
    Decoder("h2wind", "h2_wind", ("H2",), 100, lambda t: t.startswith("02A") & (F.length(t) > 40), _h2),
    Decoder("h1pos", "h1_position", ("H1",), 20, lambda t: t.startswith("POS") & ~t.startswith("POS/"), _first(H1POS), formats=_formats(H1POS)),
    Decoder("mediaadv", "media_advisory", ("SA",), 100, lambda t: (F.length(t) >= 10) & t.startswith("0"), _first(MEDIA), formats=_formats(MEDIA)),
    Decoder("gateassign", "gate_assignment", ("RA",), 60, lambda t: F.upper(t).contains("GATE ASSIGNMENT") | (F.upper(t).contains("GATE") & F.upper(t).contains("ASSIGNED")), _first(GATE), formats=_formats(GATE)),
]
