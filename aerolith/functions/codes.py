"""Airport codes and what free text says of a flight: number, airports, runway, departure, transponder, frequency, level, type and broadcast letter.

Every extract is the first of some patterns that finds something in the text in upper case; a place that needs a valid
code gives none where the code at the place is not valid.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that look like airport codes but are none.
NOT_AIRPORTS = (
    "WHEN WITH WILL WERE WHAT PUSH PULL ONLY OVER COPY CALL CLMB CONT EACH ELSE LEFT LIVE LOST YOUR YEAR ZERO ZONE READ RQST "
    "RPLY VOID VERY VFRQ OPER SEND STOP STAY UPDT UPON TIME TEST THEN TILL TAKE ATIS ACFT AFTN MAIN MNTN NEXT NONE HOLD HIGH "
    "FROM FREQ BACK BASE DOWN DCPC AREA ACAS APCH SKED SUPP WIND WIDE TAXI TURN TRSN PLAN PROC PDCL PDOP PFRQ CLRD CKPT CPDL "
    "TCAS SELC DATE DATA DPTS DEST STAR CODE GATE RSTR FILE FULL NOSE PAGE ASAT ALSO MINS MUST SIXI ECFG HELD CAPT TAIL EGGX "
    "CZQX BIRD KZNY KZAK PAZA RJJJ VHHK WAAF YBBB "
).split()
# The second letters that airport codes have in each region.
REGIONS = {
    "A": "GNY",
    "B": "GIK",
    "C": "YZ",
    "D": "ABFGINRTX",
    "E": "BDEFGHIKLNPSTVY",
    "F": "ABCDEGHIJKLMNOPQSTVWXYZ",
    "G": "ABCEFGLMOQSUV",
    "H": "ABCDEHKLRSTU",
    "L": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "M": "BDGHKMNPRSTUWYZ",
    "N": "CFGILSTVWZ",
    "O": "ABEIJKLMOPRSTY",
    "P": "ABCFGHJKLMOPTW",
    "R": "CJKOP",
    "S": "ABCDEFGKLMNOPSUVWY",
    "T": "ABCDFGIJKLNQRTUVX",
    "U": "ABCDEGHIKLMNORSTUW",
    "V": "ACDEGHILMNOQRTVY",
    "W": "ABIMPRS",
    "Y": "ABCDFGHILMNOPRSTUVWY",
    "Z": "ABGHJKLMPSUWY",
}
# Airports often named by three letters.
HINTS = {
    "SFO": "KSFO", "LAX": "KLAX", "JFK": "KJFK", "ORD": "KORD", "DFW": "KDFW", "ATL": "KATL", "DEN": "KDEN", "SEA": "KSEA", "CLT": "KCLT", "PHX": "KPHX", "MIA": "KMIA", "BOS": "KBOS", "MSP": "KMSP", "DTW": "KDTW", "EWR": "KEWR", "LGA": "KLGA", "IAH": "KIAH", "ANC": "PANC", "HNL": "PHNL",
}
PREFIXES = [a + b for a, second in REGIONS.items() for b in second]
CODE = r"\b([KCELPYZRVOSWUABDFGHMNT][A-Z]{3})\b"
DIGITS = {w: str(i + 1) for i, w in enumerate("ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE".split())}


def valid(code: Column) -> Column:
    """Whether a code is that of an airport: four capital letters of a region, and no usual word; K is a region of its own."""
    region = code.startswith("K") | F.substring(code, 1, 2).isin(*PREFIXES)
    return F.coalesce(code.rlike(r"\A[A-Z]{4}\z") & ~code.isin(*NOT_AIRPORTS) & region, F.lit(False))


def airport(code: Column) -> Column:
    return F.when(valid(code), code)


def all_airports(text: Column) -> Column:
    """Every valid code of a text, in order."""
    return F.filter(F.regexp_extract_all(text, F.lit(CODE), 1), valid)


def first_airport(text: Column) -> Column:
    return F.get(all_airports(text), F.lit(0))


def hinted(code: Column) -> Column:
    """The four-letter code of a three-letter one that is known, else the code as it is."""
    known = F.create_map(*[F.lit(x) for pair in HINTS.items() for x in pair])
    return F.coalesce(known[code], code)


# Patterns of free text, in the order in which they are tried.
RUNWAY = (r"\bOFF\s+(\d{1,2}[LRC]?)\b", r"\b(?:RWY|RUNWAY)\s+(\d{1,2}[LRC]?)\b", r"\bDEP[:\s]+[A-Z0-9]+.*?(\d{1,2}[LRC])\b")
SID = (r"\bVIA\s+([A-Z]{2,}[0-9][A-Z0-9]*)\b", r"\bDEP[:\s]+([A-Z]{2,}[0-9][A-Z0-9]*)\b", r"\b([A-Z]{2,}[0-9][A-Z0-9]*)\s+DEP(?:ARTURE)?\b", r"\bCLEARED\s+([A-Z]{2,}[0-9][A-Z0-9]*)\s+DEP")
SPELLED_SID = r"\b([A-Z]{3,})\s+(ONE|TWO|THREE|FOUR|FIVE|SIX|SEVEN|EIGHT|NINE)\s+DEP(?:ARTURE)?\b"
SQUAWK = (r"\b(?:SQUAWK|XPNDR|XPDR|TRANSPONDER)[/:\s]+([0-7]{4})\b",)
FREQUENCY = (r"\b(?:DEP\s*FREQ|DPFRQ|NEXT\s*FREQ)[:\s]+(\d{3}\.\d{1,3})\b", r"\b(?:FREQ)[:\s]+(\d{3}\.\d{1,3})\b")
LEVEL = (r"\bFL\s*(\d{2,3})\b", r"\bEXP\s+(\d{2,3})\s+(?:\d+\s+)?MIN\b", r"\bREQUESTED\s+FL\s*(\d{2,3})\b")
ALTITUDE = (r"\bCLIMB\s+(?:VIA\s+SID\s+)?TO[:\s]+(\d{3,5})\b", r"\bALT\s*(\d{3,5})\b", r"\bMAINT(?:AIN)?\s+(\d{3,5})\s*(?:FT)?\b", r"\bINITIAL\s+(?:ALT(?:ITUDE)?)\s+(\d{3,5})\s*(?:FT)?")
LETTER = (r"\bATIS\s+([A-Z])\b",)
TYPE_WITH_EQUIPMENT, TYPE = r"\b[HLMS]?/?([A-Z]\d{2,3}[A-Z]?)/[A-Z]\b", r"\b([A-Z][A-Z0-9]{3,4})\b"
TO_WORDS = ("CLRD TO ", "CLEARED TO ", "CLRD ", "DEST ", "DEST:", "DESTINATION ", "ARR ", "ARRIVING ")
FROM_WORDS = ("DEPART ", "DEPARTING ", "DEP ", "FROM ", "ORIGIN ", "ORG ")
PAIRS = (r"\b([A-Z]{4})\s*-\s*([A-Z]{4})\b", r"\b([A-Z]{4})/([A-Z]{4})\b")
FLIGHT, FLIGHT_NUMBERED = r"\b([A-Z]{2,3}\d{1,4}[A-Z]?)\b", r"(?:FLT|FLIGHT)\s+(\d+)(?:/\d+)?"
FLIGHT_BEFORE = r"\b([A-Z]{2,3}\d{1,4}[A-Z]?)\s+(?:A\d{3}|B7\d{2}|CLRD|XPNDR|[KCELPYZRVOSWUABDFGHMNT][A-Z]{3})\b"
FLIGHT_LAST = r"([A-Z]{2,3}\d{3,4}[A-Z]?)\z"
FIRST_WORDS = 11  # of a text, in which its flight number may stand


def found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def first_found(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(*[found(text, p) for p in patterns])


def _next_airport(text: Column, words: tuple[str, ...]) -> Column:
    """The valid code right behind the first occurrence of a keyword, of the first keyword with one."""
    return F.coalesce(*[airport(found(text, r"(?s)\A.*?" + w + r"[ \t\r\n]*([^ \t\r\n,/-]*)")) for w in words])


def _pair(text: Column, pattern: str, group: int) -> Column:
    a, b = found(text, pattern, 1), found(text, pattern, 2)
    return F.when(valid(a) & valid(b), a if group == 1 else b)


def is_flight(code: Column) -> Column:
    """Whether a code can be a flight number: of three to seven characters, no airport code, and not like an aircraft's hexadecimal address."""
    changes = F.length(F.regexp_replace(F.regexp_replace(code, r"[0-9]+", "9"), r"[^0-9]+", "A")) - 1
    address = code.rlike(r"\A[0-9A-Fa-f]{6}\z") | ((F.length(code) >= 5) & ((changes >= 3) | (code.rlike(r"\A[0-9]") & (changes >= 2))))
    return F.length(code).between(3, 7) & ~code.rlike(CODE) & ~address & code.rlike(FLIGHT)


def flight_number(text: Column) -> Column:
    checked = lambda c: F.when(is_flight(c), c)
    words = F.filter(F.split(F.regexp_replace(text, r"[\r\n\t/]", " "), r"\s+"), lambda w: w != "")
    early = F.filter(F.transform(F.slice(words, 1, FIRST_WORDS), lambda w: F.regexp_extract(F.upper(w), FLIGHT, 1)), lambda w: (w != "") & is_flight(w))
    return F.coalesce(checked(found(text, FLIGHT_BEFORE)), found(text, FLIGHT_NUMBERED), F.get(early, F.lit(0)), checked(found(text, FLIGHT_LAST)))


def free_text(text: Column) -> dict[str, Column]:
    """What a text says of its flight, by name; null where it says nothing."""
    u = F.upper(text)
    spelled = F.coalesce(*[F.when(found(u, SPELLED_SID, 2) == w, F.concat(found(u, SPELLED_SID, 1), F.lit(d))) for w, d in DIGITS.items()])
    some_type = F.get(F.filter(F.regexp_extract_all(u, F.lit(TYPE), 1), lambda w: w.rlike("[0-9]")), F.lit(0))
    return {
        "flight_number": flight_number(text), "origin": F.coalesce(_next_airport(u, FROM_WORDS), *[_pair(u, p, 1) for p in PAIRS]), "destination": F.coalesce(_next_airport(u, TO_WORDS), *[_pair(u, p, 2) for p in PAIRS]),
        "runway": first_found(u, RUNWAY), "sid": F.coalesce(first_found(u, SID), spelled), "squawk": first_found(u, SQUAWK), "frequency": first_found(u, FREQUENCY), "altitude": first_found(u, ALTITUDE),
        "flight_level": F.concat(F.lit("FL"), first_found(u, LEVEL)), "aircraft_type": F.coalesce(found(u, TYPE_WITH_EQUIPMENT), some_type), "atis": first_found(u, LETTER),
    }
