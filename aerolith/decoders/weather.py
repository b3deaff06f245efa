"""Weather: airport broadcasts, observations, forecasts and warnings.

Fixed values: names, labels, priorities, keywords and patterns of the messages.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aerolith.decoders.engine import Decoder, bind, count_of, groups_of, text_of, to_java, unless_zero, whole
from aerolith.decoders.notes import find, find_all, record

REMARKS = (
    r"CAUTION\s+([^.]+)", r"(RWY\s+\d{1,2}[LCR]?\s+(?:CLSD|CLOSED|UNUSABLE)[^.]*)", r"(BIRD\s+ACTIVITY)", r"(GPS\s+(?:SIGNAL\s+)?UNRELIABLE[^.]*)", r"(LOW\s+VISIBILITY[^.]*)", r"(WORK\s+IN\s+PROGRESS)",
)
BLANK = " \t\r\n"


def _distinct(t: Column, pattern: str) -> Column:
    found = F.array_distinct(F.regexp_extract_all(t, F.lit(to_java(pattern)[0]), 1))
    return F.when(F.size(found) > 0, found)


def _atis(t: Column) -> Column:
    head = r"/([A-Z0-9]+)\.TI2/([A-Z]{4})\s+(ARR|DEP)?\s*ATIS\s+([A-Z])"

    def below(pattern: str) -> Column:
        value = find(t, pattern, 2)
        return F.when(F.coalesce(find(t, pattern), F.lit("")).contains("MS"), F.concat(F.lit("-"), value)).otherwise(value)

    remarks = F.array_compact(F.array(*[text_of(F.trim(find(t, p), F.lit(BLANK))) for p in REMARKS]))
    return record(
        "airport", "qnh", "runways", airport=find(t, head, 2), atis_letter=find(t, head, 4), atis_type=find(t, head, 3), atis_time=F.concat(find(t, r"\b(\d{4})Z\b"), F.lit("Z")), runways=_distinct(t, r"RWY\s+(\d{1,2}[LCR]?)"),
        approaches=_distinct(t, r"(ILS(?:\s+[A-Z])?\s+APCH|RNAV\s+APCH|VOR\s+APCH)"), wind=F.trim(find(t, r"WIND\s+(\d{3}/\d{1,3}KT(?:\s+(?:VRB|GUST)[^.]*)?|VRB\s+\d{1,3}KT)"), F.lit(BLANK)),
        visibility=F.when(t.contains("CAVOK"), F.lit("CAVOK")).otherwise(find(t, r"VIS\s+(\d+KM(?:\s+OR\s+MORE)?)")), clouds=find(t, r"(?:CLD\s+([A-Z]+\s+\d+FT)|CAVOK)"), temperature=below(r"\bT\s+(MS\s*)?\s*(\d{1,2})\b"),
        dew_point=below(r"\bDP\s*(MS\s*)?\s*(\d{1,2})\b"), qnh=find(t, r"QNH\s+(\d{3,4})(?:HPA)?"), remarks=F.when(F.size(remarks) > 0, remarks),
    )



def _celsius(c: Column) -> Column:
    return count_of(F.regexp_replace(c, r"\AM", "-"))


def _metar(whole_text: Column, airport: Column, time: Column, body: Column) -> Column:
    def made(wind: Column) -> Column:
        def speed(i: int) -> Column:
            knots = whole(wind[i])
            return unless_zero(F.when(wind[4] == "MPS", F.floor(knots * 1.944)).otherwise(knots))

        def rest(sight: Column, temp: Column, qnh: Column) -> Column:
            hecto = whole(qnh[2])
            return F.struct(
                airport.alias("airport"), time.alias("time"), wind[0].alias("wind"), count_of(wind[1]).alias("wind_dir"), speed(2).alias("wind_speed"), speed(3).alias("wind_gust"), F.coalesce(sight[1], F.concat(sight[2], F.lit("SM"))).alias("visibility"),
                text_of(F.array_join(F.regexp_extract_all(body, F.lit(r"\b((?:FEW|SCT|BKN|OVC)\d{3}(?:CB|TCU)?\b|(?:CAVOK|NCD|NSC|SKC|CLR)\b)"), 1), " ")).alias("clouds"), _celsius(temp[1]).alias("temperature"),
                _celsius(temp[2]).alias("dew_point"), F.when(qnh[1] == "A", F.floor(hecto * 0.338639)).otherwise(hecto).alias("qnh"), F.trim(whole_text, F.lit(BLANK)).alias("raw"),
            )

        parts = F.struct(_parts(body, r"\b(\d{4})\b|\b(\d+)SM\b").alias("s"), _parts(body, r"\b(M?\d{2})/(M?\d{2})\b").alias("t"), _parts(body, r"\b([QA])(\d{4})\b").alias("q"))
        return bind(parts, lambda p: rest(p["s"], p["t"], p["q"]))

    return bind(_parts(body, r"\b(\d{3}|VRB)(\d{2,3})(?:G(\d{2,3}))?(KT|MPS)\b"), made)


def _parts(text: Column, pattern: str) -> Column:
    """The first match and its groups as an array of five, empty ones null, all null where there is no match."""
    return F.coalesce(groups_of(text, pattern, lambda g: F.array(*[g(i) for i in range(5)])), F.expr("array_repeat(CAST(NULL AS STRING), 5)"))


def _sigmet(raw: Column, id_: Column, start: Column, end: Column, office: Column, fir: Column, name: Column, body: Column) -> Column:
    before = lambda word: F.when(F.locate(word, body) > 1, F.trim(F.substring_index(body, word, 1), F.lit(BLANK)))
    return F.struct(
        id_.alias("id"), start.alias("valid_from"), end.alias("valid_to"), office.alias("originator"), F.concat_ws(" ", fir, name).alias("fir"), F.coalesce(before(" WI "), before(" OBS "), before(" FCST ")).alias("phenomenon"),
        text_of(F.regexp_extract(body, r"(FL\d{3}/\d{3}|TOP\s+FL\d{3}|SFC/FL\d{3})", 1)).alias("altitude"), text_of(F.regexp_extract(body, r"\b(STNR|MOV\s+[NESW]+\s+\d+KT)\b", 1)).alias("movement"), F.trim(raw, F.lit(BLANK)).alias("raw"),
    )


def _weather(t: Column) -> Column:
    metars = find_all(t, r"(?m)(^(?:METAR\s+)?(?:COR\s+)?([A-Z]{4})\s+(\d{6}Z)\s+(.+?)(?:\s*=|(?-m:\z)|(?=\n)))", 4, _metar)
    tafs = find_all(
        t, r"(TAF\s+(?:AMD\s+)?(?:COR\s+)?([A-Z]{4})\s+(\d{6}Z)\s+(\d{4}/\d{4})\s+(.+?)(?:\s*=|\z|(?=\n)))", 5,
        lambda raw, airport, issued, valid, _: F.struct(airport.alias("airport"), issued.alias("issued"), valid.alias("valid"), F.trim(raw, F.lit(BLANK)).alias("raw")),
    )
    sigmets = find_all(t, r"(SIGMET\s+(\w+)\s+VALID\s+(\d{6})/(\d{6})\s+([A-Z]{4})-\s+([A-Z]{4})\s+(\w+(?:\s+\w+)?)\s+FIR\s+(.+?)(?:\s*=|\z))", 8, _sigmet)
    return record("metars", "tafs", "sigmets", metars=metars, tafs=tafs, sigmets=sigmets)


def _broadcast(t: Column) -> Column:
    u = F.upper(t)
    return u.contains("ATIS") & (u.contains(".TI2/") | u.contains("QNH") | u.contains("WIND"))


def _reports(t: Column) -> Column:
    u = F.upper(t)
    return u.contains("METAR") | u.contains(" TAF ") | u.contains("SIGMET")


DECODERS = [
    Decoder("atis", "atis", ("A9",), 100, _broadcast, _atis),
    Decoder("weather", "weather", ("RA", "C1", "21", "H1", "3W", "27", "31", "34", "3T", "23"), 50, _reports, _weather, upper=False),
]
