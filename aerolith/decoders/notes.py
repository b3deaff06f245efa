"""Free-form operational messages: independent extracts from one text.

Fixed values: names, labels, priorities, keywords and patterns of the messages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from aerolith.decoders.engine import Decoder, bind, count_of, number, onward, text_of, to_java, unless_zero, whole


def find(t: Column, pattern: str, group: int = 1) -> Column:
    """One group of the first match; null where there is none or it is empty."""
    return text_of(F.regexp_extract(t, to_java(pattern)[0], group))


def find_int(t: Column, pattern: str, group: int = 1) -> Column:
    return count_of(F.regexp_extract(t, to_java(pattern)[0], group))


def find_number(t: Column, pattern: str, group: int = 1) -> Column:
    return unless_zero(number(F.regexp_extract(t, to_java(pattern)[0], group)))


def find_all(t: Column, pattern: str, groups: int, build: Callable[..., Column]) -> Column:
    """What `build` makes of the groups of each match; null where there is none."""
    java = F.lit(to_java(pattern)[0])
    every = F.arrays_zip(*[F.regexp_extract_all(t, java, i).alias(f"g{i}") for i in range(1, groups + 1)])
    made = F.transform(every, lambda x: build(*[x[f"g{i}"] for i in range(1, groups + 1)]))
    return F.when(F.size(made) > 0, made)


def record(*needed: str, **fields: Column) -> Column:
    """A struct, kept if one of the needed fields is there."""
    made = F.struct(*[c.alias(n) for n, c in fields.items()])
    if not needed:
        return made

    def kept(m: Column) -> Column:
        some = m[needed[0]].isNotNull()
        for n in needed[1:]:
            some = some | m[n].isNotNull()
        return F.when(some, m)

    return bind(made, kept)


def _delay(t: Column) -> Column:
    line = r"([A-Z]{2}\d+)/(\d{2}[A-Z]{3}\d{4})\s+([A-Z]{3})-([A-Z]{3})"
    minutes = lambda p: F.coalesce(whole(find(t, p)), F.lit(0).cast("bigint"))
    return record(
        flight_number=find(t, line), flight_date=find(t, line, 2), origin=find(t, line, 3), destination=find(t, line, 4), std=find(t, r"STD\s+(\d{2}:\d{2})"), atd=find(t, r"ATD\s+(\d{2}:\d{2})"),
        dep_delay_minutes=minutes(r"DEP DELAY\s+(\d+)\s*MIN"), sta=find(t, r"STA\s+(\d{2}:\d{2})"), ata=find(t, r"ATA\s+(\d{2}:\d{2})"), arr_delay_minutes=minutes(r"ARR DELAY\s+(\d+)\s*MIN"),
        delay_codes=find_all(t, r"DL(\d+)/(\d+)MIN", 2, lambda a, b: F.struct(F.concat(F.lit("DL"), a).alias("code"), whole(b).alias("minutes"))),
        message_created=find(t, r"MESSAGE CREATED:\s*(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z?)"),
    )


def _crew(t: Column) -> Column:
    line = r"([A-Z]{2}\d+)/(\d+)\s+([A-Z]{4})\s+([A-Z]{4})"
    member = lambda a, b, c, d: F.struct(a.alias("position"), F.trim(F.concat_ws(" ", b, F.trim(c))).alias("name"), d.alias("employee_id"))
    return record(
        "cockpit_crew", "cabin_crew", flight_number=find(t, line), flight_date=find(t, line, 2), origin=find(t, line, 3), destination=find(t, line, 4), sent_time=find(t, r"SENT:\s*(\d{2}:\d{2}:\d{2}z?)"),
        gate_eta=find(t, r"GATE ETA\s*(\d{4})"), cockpit_crew=find_all(t, r"(?:\d+\.)?(CA|FO|SO|FE)\s+([A-Z]+)\s+([A-Z ]+?)\s*\n\s*([A-Z]?\d+)", 4, member),
        cabin_crew=find_all(t, r"(FA|FM|FP|FS)\s+([A-Z]+)\s+([A-Z ]+?)\s*\n\s*([A-Z]?\d+)", 4, member), min_crew=find_int(t, r"(?:FLIGHT ATTENDANT|FA)\s*MIN[:\s]*(\d+)"),
    )


def _dispatch(t: Column) -> Column:
    a, b = r"([A-Z]{2,3}\d+)\s+([A-Z0-9-]+)\s*\n", r"FLT:\s*(\d+)\s*\n\s*ACFT:\s*(\d+)"
    desk = r"DISP/([A-Z]{2})\s+(\d+)/(\d{4}Z)"
    mel = find(t, r"MEL,?\s*CDL,?\s*SDL\s*REF:\s*([A-Z0-9-]+)")
    fuel = t.contains("FUEL") & (t.contains("MRF") | t.contains("MIN TO FUEL"))
    category = F.when(fuel, F.lit("FUEL")).when(find(t, r"SIGMET\s+([A-Z]\d+)").isNotNull(), F.lit("SIGMET")).when(mel.isNotNull(), F.lit("MEL")).when(t.contains("AMND FLT PLAN") | t.contains("AMEND"), F.lit("AMEND"))
    content = F.trim(onward(t, F.locate("DISPATCHER MSG", t) + 14), F.lit(" \t\r\n"))
    return record(
        flight_number=F.coalesce(find(t, b), find(t, a)), tail=F.coalesce(find(t, b, 2), find(t, a, 2)), ack_required=t.contains("PLEASE ACK"), category=category, mel_ref=mel, mddr_number=find(t, r"MDDR\s*#?:?\s*=?\s*(\d+)"),
        dispatcher_id=find(t, desk), timestamp=find(t, desk, 3), content=text_of(F.when(F.octet_length(content) > 500, F.concat(F.substring(content, 1, 500), F.lit("..."))).otherwise(content)),
    )


def _fuel(t: Column) -> Column:
    line = r"([A-Z]{2}\d+)\s+([A-Z0-9-]+)\s+(\d{2}\.\d{2}\.\d{4})"
    return record(
        "flight_number", "amount_litres", flight_number=find(t, line), tail=find(t, line, 2), date=find(t, line, 3), destination=find(t, r"DEST:\s*([A-Z]{3,4})"), fuel_company=find(t, r"FUEL COMPANY:\s*([A-Z0-9]+)"),
        fuel_grade=find(t, r"FUEL GRADE:\s*([A-Z0-9]+)"), truck_id=find(t, r"TRUCK:\s*([A-Z0-9]+)"), start_time=find(t, r"START:\s*(\d{2}:\d{2})"), end_time=find(t, r"END:\s*(\d{2}:\d{2})"),
        amount_litres=find_int(t, r"AMOUNT:\s*(\d+)\s*LTRS"), density_kg_m3=find_int(t, r"DENSITY:\s*(\d+)\s*KG/M3"), qty_before_kg=find_int(t, r"QTY BEFORE[^:]*:\s*(\d+)\s*KG"),
    )


def _hazard(t: Column) -> Column:
    head = r"MSG/RX(\d{2}-[A-Z]{3}-\d{2}\s+\d{4}Z)\s+FR:([A-Z0-9]+)\s+TO:([A-Z0-9]+)"
    alert = r"HAZARD ALERT FOR\s+([A-Z0-9]+)\s+([A-Z0-9]+):\s*([A-Z]{4})-([A-Z]{4})"
    segment = r"SEGMENT:\s*([A-Z0-9-]+)\s+ETO:\s*(\d{4}Z)"
    rate, wind = find(t, r"EDR TURBULENCE IS\s+([\d.]+)\s+EDR"), find(t, r"WARNING:\s*WINDS\s+IS\s+(\d+)")
    return record(
        "callsign", "edr", timestamp=find(t, head), **{"from": find(t, head, 2), "to": find(t, head, 3)}, callsign=find(t, alert), flight_id=find(t, alert, 2), origin=find(t, alert, 3), destination=find(t, alert, 4),
        etd=find(t, r"\((\d{4}Z)\s+ETD\)"), segment=find(t, segment), eto=find(t, segment, 2), edr=F.nullif(number(rate), F.lit(0.0)), wind_warning=F.concat(wind, F.lit(" knots")),
        alert_level=F.when(rate.isNotNull(), F.lit("CRITICAL")).when(wind.isNotNull(), F.lit("WARNING")),
    )


def _parking(t: Column) -> Column:
    return record(
        "airport", "parking_stand", "baggage_carousel", airport=find(t, r"ESCALE\s+([A-Z]{3})"), parking_stand=find(t, r"PARKING[^:]+:\s*([A-Z0-9]+)"), baggage_carousel=find(t, r"TAPIS A BAGAGES\s*:\s*([A-Z0-9]+)")
    )


def _paxbag(t: Column) -> Column:
    info = r"FLIGHT INFO\s+([A-Z0-9]+)\s+REG\s+([A-Z0-9-]+)\s+(\d+[A-Z])"
    line = r"([A-Z]{2}\d+)\s+(\d{2}[A-Z]{3})\s+([A-Z]{3})\s+STD(\d{4})\s+BOARD\s+(\d{4})\s+GATE\s+(\S+)"
    total = r"TOTAL PASSENGERS\s+(\d+)\s+PLUS INFANTS\s+(\d+)"
    joining = r"JOINING\s+[A-Z]\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)@(\d+)"
    count = lambda c: F.coalesce(whole(c), F.lit(0).cast("bigint"))
    zones = find_all(
        t, r"ZONE\s+([A-Z])\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)", 6,
        lambda z, a, m, f, c, i: F.struct(z.alias("zone"), count(a).alias("adults"), count(m).alias("male"), count(f).alias("female"), count(c).alias("children"), count(i).alias("infants")),
    )
    infants = F.when(find(t, joining).isNotNull(), find_int(t, joining, 5)).otherwise(find_int(t, total, 2))
    return record(
        "flight_number", "total_pax", aircraft_type=find(t, info), registration=find(t, info, 2), configuration=find(t, info, 3), flight_number=find(t, line), date=find(t, line, 2), origin=find(t, line, 3),
        destination=find(t, r"DEST\s+CABIN.*\n([A-Z]{3})"), std=find(t, line, 4), boarding_time=find(t, line, 5), gate=find(t, line, 6), total_pax=find_int(t, total), infants=infants, adults=find_int(t, joining),
        male=find_int(t, joining, 2), female=find_int(t, joining, 3), children=find_int(t, joining, 4), bag_count=find_int(t, joining, 6), bag_weight=find_int(t, joining, 7), zones=zones, is_finalised=~t.contains("NOT FINALISED"),
    )


def _paxconn(t: Column) -> Column:
    flight = r"([A-Z]{2}\d+)\s+(\d{8})\s+(\d{2}:\d{2})\s+([A-Z]{3})"
    decision = r"(MISSEDCONNECTION|PENDING|WILLWAIT)\s+([A-Z])\s+(\d+)\s+(\d+)"
    made = F.transform(
        F.split(t, "-{32}"),
        lambda s: F.when(
            find(s, flight).isNotNull() & find(s, decision).isNotNull(),
            F.struct(
                find(s, flight).alias("flight_number"), find(s, flight, 2).alias("date"), find(s, flight, 3).alias("time"), find(s, flight, 4).alias("destination"), find(s, decision).alias("decision"), find(s, decision, 2).alias("class"),
                whole(find(s, decision, 3)).alias("passengers"), whole(find(s, decision, 4)).alias("bags"),
            ),
        ),
    )
    connections = F.filter(made, lambda c: c.isNotNull())
    total = lambda kind: F.aggregate(connections, F.lit(0).cast("bigint"), lambda n, c: n + F.when((F.lit(kind) == "") | (c["decision"] == kind), c["passengers"]).otherwise(F.lit(0).cast("bigint")))
    return record(
        "connections", current_flight=find(t, r"CURRENT FLIGHT[:\s]*\n[^\n]*\n\s*([A-Z]{2}\d+)"), connections=F.when(F.size(connections) > 0, connections), missed_count=total("MISSEDCONNECTION"), pending_count=total("PENDING"),
        will_wait_count=total("WILLWAIT"), total_connecting=total(""),
    )


def _takeoff(t: Column) -> Column:
    kind, gtow, fuel = r"([AB]\d{3}-\d{3})\s+([A-Z0-9-]+)", r"GTOW\s*/\s*CG\s+PAX\s*\n\s*([\d.]+)/([\d.]+)\s+(\d+)", r"FUEL\s+CARGO\s*\n\s*([\d.]+)\s+(\d+)"
    runway = lambda a, n, r, s: F.struct(a.alias("airport"), r.alias("runway"), whole(n).alias("length"), whole(s).alias("shift"))
    header = find_all(t, r"LENGTH\s+([A-Z]{4})\s+SHIFT\s*\n?\s*(\d+)\s+(\d+[LRC]?)\s+(\d+)", 4, runway)
    plain = r"T/O\s+([A-Z]{3,4})\s+(\d{2}[LRC]?)"
    none = F.lit(None).cast("bigint")
    simple = F.when(find(t, plain).isNotNull(), F.array(F.struct(find(t, plain).alias("airport"), find(t, plain, 2).alias("runway"), none.alias("length"), none.alias("shift"))))
    every = F.coalesce(header, simple)
    v1 = find_int(t, r"V1\s*\n?\s*(\d+)")
    return record(
        "gtow", "runways", aircraft_type=find(t, kind), engine_type=find(t, kind, 2), time=find(t, r"(\d{4}Z)"), wind=find(t, r"(\d{3}/\d+)"), oat=find_int(t, r"(?:TEMP|OAT)[^\d-]*([+-]?\d+)\s*C"),
        qnh=F.coalesce(find_number(t, r"QNH\s*\n[^\n]*\s(\d+\.\d+)"), find_number(t, r"ALT\s+(\d+\.\d+)"), find_number(t, r"(\d{2}\.\d{2})\s*$")), gtow=find_number(t, gtow), cg=find_number(t, gtow, 2), pax=find_int(t, gtow, 3),
        fuel=find_number(t, fuel), cargo=find_int(t, fuel, 2), zfw=find_number(t, r"ZFW\s*/\s*CG\s*\n?\s*([\d.]+)"),
        runways=F.transform(every, lambda r, i: F.struct(r["airport"].alias("airport"), r["runway"].alias("runway"), r["length"].alias("length"), r["shift"].alias("shift"), F.when(i == F.size(every) - 1, v1).alias("v1"))),
    )


def _landing(t: Column) -> Column:
    place, kind, temp = r"LANDING DATA\s+([A-Z]{3,4})\s+RW\s*(\d{2}[LRC]?)", r"\n\s*([A-Z0-9]{3}-\d+)\s+([A-Z0-9-]+)", r"TEMP\s+(M?\d+)C\s+ALT\s+([\d.]+)"
    degrees = find(t, temp)
    return record(
        "airport", "runway", "landing_weight", airport=find(t, place), runway=find(t, place, 2), runway_length=find_int(t, r"(\d{4,5})\s*FT"), aircraft_type=F.concat(find(t, kind), F.lit(" "), find(t, kind, 2)),
        flap_setting=find(t, r"\*FLAPS?\s*(\d+)\*"), temperature=F.nullif(F.when(degrees.startswith("M"), -whole(F.substring(degrees, 2, 10))).otherwise(whole(degrees)), F.lit(0).cast("bigint")), altimeter=find_number(t, temp, 2),
        wind=find(t, r"WIND\s+(\d{3}/\d+)\s*(?:MAG)?"), landing_weight=find_number(t, r"([\d.]+)\s*-\s*PLANNED\s+LDG\s+WT"), structural_limit=find_number(t, r"([\d.]+)\s*-\s*STRUCTURAL"),
        performance_limit=find_number(t, r"([\d.]+)\s*-\s*LM\s"), runway_condition=find(t, r"\bRWY\s+(DRY|WET|CONTAMINATED|SLIPPERY)\b"),
    )


def _turbulence(t: Column) -> Column:
    level, valid, way = r"\bALT[:\s]+FL(\d{3})(?:\s*[-TO]+\s*FL?(\d{3}))?", r"\bVALID[:\s]+(\d{6}Z?)(?:\s*[-TO]+\s*(\d{6}Z?))?", r"\bENTRY/EXIT[:\s]+(\d+[NS]\d+[EW])\s*/\s*(\d+[NS]\d+[EW])"
    line = lambda p: text_of(F.trim(find(t, p), F.lit(" \t\r\n")))
    level_of = lambda g: F.concat(F.lit("FL"), find(t, level, g))
    return record(
        "severity", "altitude_low", "id", turb_type=line(r"\bTYPE[:\s]+([A-Z\s]+?)(?:\n|\z)"), id=find(t, r"\bID[:\s]+(\d+)"),
        severity=F.coalesce(line(r"\b(?:SEVERITY|INTST)[:\s]+([A-Z\s]+?)(?:\n|\z)"), line(r"\b(LGT|MOD|MDT|SEV|OCNL\s+MOD)\s+(?:\(\d+\)\s+)?INTENSITY")), altitude_low=level_of(1), altitude_hi=level_of(2), valid_from=find(t, valid),
        valid_to=find(t, valid, 2), movement=line(r"\bMVT[:\s]+([A-Z0-9\s]+?)(?:\n|\z)"), description=line(r"\bDISC[:\s]+(.+?)(?:\n|\z)"), entry_point=find(t, way), exit_point=find(t, way, 2),
    )


def _holds(*parts: str):
    return lambda t: F.coalesce(*[F.nullif(t.contains(p), F.lit(False)) for p in parts], F.lit(False))


def _turbulent(t: Column) -> Column:
    u = F.upper(t)
    return u.contains("TURB") & (u.contains("SIGMET") | u.contains("ADVISORY") | u.contains("WSI"))


def _as_is(name: str, kind: str, labels: tuple[str, ...], priority: int, quick, build, standard: bool = False) -> Decoder:
    return Decoder(name, kind, labels, priority, quick, build, standard, upper=False)


DECODERS = [
    _as_is("crew", "crew_list", ("RA",), 55, _holds("CREW LIST"), _crew),
    _as_is("delay", "delay_summary", ("3E", "RA"), 50, _holds("DELAY SUMMARY"), _delay),
    _as_is("dispatch", "dispatcher", ("RA", "25", "H1"), 45, _holds("DISPATCHER MSG"), _dispatch),
    _as_is("fuel", "fuel_delivery", ("3E", "RA"), 100, _holds("FUEL DELIVERY"), _fuel),
    _as_is("hazard", "hazard_alert", ("_", "H1", "SA"), 60, _holds("HAZARD ALERT"), _hazard),
    _as_is("parking", "parking_info", ("1E", "RA"), 50, _holds("PKG INFO MSG"), _parking),
    _as_is("paxbag", "pax_bag", ("RA",), 55, _holds("PAX AND BAG DETAILS"), _paxbag),
    _as_is("paxconn", "pax_conn_status", ("3E", "RA"), 55, _holds("PAX CONN STATUS"), _paxconn),
    _as_is("takeoff", "takeoff_data", ("RA", "H1", "C1"), 55, _holds("TAKEOFF DATA", "T/O DATA"), _takeoff),
    _as_is("landingdata", "landing_data", ("C1",), 70, lambda t: F.upper(t).contains("LANDING DATA"), _landing, True),
    _as_is("turbulence", "turbulence", ("C1",), 65, _turbulent, _turbulence, True),
]
