"""Load sheets: each format is a list of anchors found one after the other.

Between anchors anything may stand, line ends included. Every gap up to an anchor is
atomic: the first occurrence of the anchor is taken and not given back, which keeps
long texts that don't match from being tried in every way.

Fixed values: labels, format names, their order, and the wording of the anchors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aerolith.decoders.engine import Decoder, Format, bind, number, text_of, whole

COMMON = ("C1", "RA", "H1", "30", "31", "2A", "22", "35", "45", "13", "42")
FIELDS = ("status", "time", "edition", "flight", "origin", "destination", "tail", "crew", "zfw", "zfw_max", "tof", "tow", "tow_max", "tif", "law", "law_max", "pax_total", "mac_zfw", "mac_tow")


def weight(word: str, name: str, between: str = r"\s+MAX\s+", before: str = "") -> str:
    """An actual weight and its limit."""
    return rf"{word}{before}\s+(?P<{name}>\d+){between}(?P<{name}_max>\d+)"


def one(word: str, name: str, form: str = r"\d+") -> str:
    return rf"{word}\s+(?P<{name}>{form})"


FINAL = r"LOADSHEET\s+(?P<status>FINAL|PRELIM)\s+"
DATED = r"/\d+\s+\d+[A-Z]{3}\d+"
CITIES = r"(?P<origin>[A-Z]{3})\s+(?P<destination>[A-Z]{3})\s+"
TAIL, HULL, CREW = r"(?P<tail>[A-Z0-9-]+)\s+", r"(?P<tail>[A-Z0-9]+)\s+", r"(?P<crew>\d+/\d+)"
ZFW, TOF, TOW, LAW, TIF = weight("ZFW", "zfw"), one("TOF", "tof"), weight("TOW", "tow"), weight("LAW", "law"), one("TIF", "tif")
PAX = r"PAX/[\d/]+\s+TTL\s+(?P<pax_total>\d+)"
BALANCE = [("?", one("MACZFW", "mac_zfw", r"[\d.]+")), ("?", one("MACTOW", "mac_tow", r"[\d.]+"))]
LIST_LB = r"\s+[\d,.]+\s+"
LIST_KG = r"\s+[\d,.-]+\s+"
LANDING = "(?:LW|LAW)"


def cargo(flight: str, cities: str, model: str, unit: str, between: str) -> list:
    sheet = rf"FLT\s+{cities}\s+{model}\s*/\s*(?P<tail>[A-Z0-9]+)"
    return [rf"LOADSHEET\s+(?P<flight>[A-Z0-9]+){flight}", sheet, rf"ALL\s+WGHTS\s+{unit}", weight("ZFW", "zfw", between), TOF, weight("TOW", "tow", between), weight(LANDING, "law", between)]


LEGS, STOPS = r"(?P<origin>[A-Z]{3})-(?P<destination>[A-Z]{3})", r"(?P<origin>[A-Z]{3})-\d?(?P<destination>[A-Z]{3})"
STANDARD = [FINAL + r"(?P<time>\d{4})\s+(?:EDNO?\s*(?P<edition>\d+))?", r"(?P<flight>[A-Z]{2}\d{1,4}[A-Z]?)" + DATED + r"\s*\n\s*" + CITIES + TAIL + CREW, ZFW, TOF, TOW]
AIRLINES = r"(?:TIBET|SI\s+CHUAN|SICHUAN|CHINA\s+EASTERN|CHINA\s+SOUTHERN|HAINAN|XIAMEN|OKAY|AIR\s+CHINA|SHAN\s*DONG|SPRING)\s+(?:AIRLINES?|AIRWAYS)?(?:\s+CO\.?\s*(?:LTD)?)?"

# (name, labels, unit, anchors); an anchor ("?", x) may be missing.
FORMATS = [
    ("standard_kg", COMMON, "kg", [*STANDARD, ("?", TIF), LAW, PAX, *BALANCE]),
    ("standard_kg_minimal", COMMON, "kg", STANDARD),
    (
        "qantas_tonnes", ("C1",), "tonnes",
        [r"(?P<status>FINAL|PRELIM(?:INARY)?)\s+LOADSHEET", r"(?:REGO|REG):\s*(?P<tail>[A-Z0-9-]+)", r"FLIGHT:\s*(?P<flight>[A-Z]{2}\d{1,4})", r"[A-Z]{2}\d{1,4}\s+\d+[A-Z]{3}\s+(?P<origin>[A-Z]{3})\s+[A-Z0-9-]+\s+" + CREW]
        + [one(w.upper(), w, r"[\d.]+") for w in ("zfw", "tof", "tow", "tif", "law")],
    ),
    (
        "ba_full_names", ("10", "14"), "kg",
        [r"L\s+O\s+A\s+D\s+S\s+H\s+E\s+E\s+T", CITIES + r"(?P<flight>[A-Z]{2}\s*\d{1,4})\s+" + HULL + r"[A-Z0-9]+\s+" + CREW + r"\s+\d+[A-Z]{3}\d+", weight(r"ZERO\s+FUEL\s+WEIGHT", "zfw", before=r"\s+ACTUAL"), one(r"TAKE\s+OFF\s+FUEL", "tof")]
        + [weight(r"TAKE\s+OFF\s+WEIGHT", "tow", before=r"\s+ACTUAL"), weight(r"LANDING\s+WEIGHT", "law", before=r"\s+ACTUAL")],
    ),
    (
        "jetsmart", ("C1",), "kg",
        [r"JETSMART\s+LOADSHEET", r"(?P<flight>[A-Z]{2}\d{1,4})" + DATED + r"\s+(?:EDNO?\s*(?P<edition>\d+))?", CITIES + HULL + CREW, ZFW, TOF, TOW, ("?", TIF), ("?", LAW), ("?", PAX)],
    ),
    ("jetsmart_minimal", ("C1",), "kg", [r"JETSMART\s+LOADSHEET", r"(?P<flight>[A-Z]{2}\d{1,4}[A-Z]?)" + DATED + r"\s+(?:EDNO?\s*(?P<edition>\d+))?", CITIES + HULL + CREW, ZFW]),
    (
        "chinese_airlines", ("C1",), "kg",
        [AIRLINES, r"LOADSHEET\s+EDNO?\s*(?P<edition>\d+)", r"FLIGHT:\s*(?P<flight>[A-Z0-9]{2}\d{1,4})/\d+[A-Z]{3}\d+\s+(?P<origin>[A-Z]{3,6})\s+(?P<tail>[A-Z0-9]+)", r"CREW:\s*(?P<crew>\d+/\d+(?:/\d+)?)"]
        + [one("ZFW", "zfw") + r"\s+MACZFW:\s*(?P<mac_zfw>[\d.]+)", one("MZFW", "zfw_max"), TOF, one("TOW", "tow") + r"\s+MACTOW:\s*(?P<mac_tow>[\d.]+)", one("MTOW", "tow_max")]
        + [("?", one("LDW", "law")), ("?", one("MLDW", "law_max")), ("?", r"TTL:\s*(?P<pax_total>\d+)")],
    ),
    ("jat_bw_dow", ("3S",), "kg", [FINAL + r"(?:00)?(?P<edition>\d+)\s+(?P<time>\d{4})", r"(?P<flight>[A-Z]{2}\d{1,4}[A-Z]?)" + DATED + r"\s*\n\s*" + CITIES + HULL + CREW, ZFW, TOF, TOW, LAW]),
    ("european_edn", ("C1",), "kg", [FINAL + r"EDN(?P<edition>\d+)", r"(?P<flight>[A-Z]{2}\d{1,4})" + DATED, CITIES + HULL + CREW, ZFW, TOF, TOW, ("?", TIF), ("?", LAW), *BALANCE, ("?", PAX)]),
    (
        "cathay_act", ("C1",), "kg",
        [FINAL + r"(?P<edition>\d+)", CITIES + r"(?P<flight>[A-Z]{2}\d{1,4})/\d+\s+(?P<tail>[A-Z0-9-]+)", CREW, weight("ZFW", "zfw", before=r"\s+ACT"), one(r"TO\s+FUEL", "tof"), weight("TOW", "tow", before=r"\s+ACT")]
        + [("?", one(r"TRIP\s+FUEL", "tif")), ("?", weight("LAW", "law", before=r"\s+ACT")), *BALANCE, ("?", one(r"TTL\s+PAX", "pax_total"))],
    ),
    ("tui_edn", ("C1",), "kg", [r"LOADSHEET\s+EDN(?P<edition>\d+)", r"(?P<flight>[A-Z]{2,3}\d{1,4})" + DATED, CITIES + HULL + CREW, ZFW, TOF, TOW, ("?", TIF), ("?", LAW), *BALANCE]),
    ("eat_cargo_lb", ("C1",), "lb", cargo(r"\s+REF", STOPS, "[A-Z0-9]+", "LB", LIST_LB)),
    (
        "ethiopian", ("C1",), "kg",
        [FINAL + r"(?P<time>\d{4})", r"(?P<flight>[A-Z]{2}\d{1,4})/\d+[A-Z]{3}\d+\s+\d+[A-Z]{3}\d+\s+EDNO-(?P<edition>\d+)", CITIES + HULL + r"[A-Z0-9]+\s+" + CREW, ZFW, TOF, TOW, ("?", TIF), ("?", LAW), *BALANCE, ("?", PAX)],
    ),
    ("kalitta_cargo_lb", ("C1",), "lb", cargo(r"\s+REF", LEGS, "[A-Z0-9-]+", "LB", r"\s+")),
    ("kalitta_old_lb", ("C1",), "lb", cargo(r"\s*\n", LEGS, "[A-Za-z0-9 -]+", "LB", r"\s+")),
    ("dhl_cargo_kg", ("C1",), "kg", cargo(r"\s+REF", STOPS, "[A-Z0-9-]+", "KG", LIST_KG)),
    ("french_bee_short", ("C1",), "kg", [FINAL + r"(?P<time>\d{4})", r"(?P<flight>[A-Z]{2}\d{1,4})" + DATED + r"\s*\n\s*" + CITIES + TAIL + CREW, ZFW, TOW, LAW, ("?", PAX)]),
    (
        "vic_corsair", ("C1",), "kg",
        [r"VIC\s+(?P<edition>\d+)", r"FROM/TO\s+FLIGHT", CITIES + r"(?P<flight>[A-Z]{2}\d{1,4})/\d+[A-Z]{3}\s+" + TAIL + r"[A-Z0-9]+\s+(?P<crew>\d+/\d+(?:/\d+)?)", weight(r"ZERO\s+FUEL\s+WEIGHT", "zfw", before=r"\s+EST"), one(r"TAKE\s+OFF\s+FUEL", "tof")]
        + [weight(r"TAKE\s+OFF\s+WEIGHT", "tow", before=r"\s+EST"), ("?", one(r"TRIP\s+FUEL", "tif")), weight(r"LANDING\s+WEIGHT", "law", before=r"\s+EST"), *BALANCE],
    ),
]


def pattern(anchors: list) -> str:
    """The anchors as one expression, with atomic gaps."""
    out = "(?s)" + anchors[0]
    for a in anchors[1:]:
        out += f"(?:(?>.*?{a[1]}))?" if isinstance(a, tuple) else f"(?>.*?{a})"
    return out


def words(anchors: list) -> list[str]:
    """Weight words that must be there: a cheap rejection before the expression runs."""
    text = " ".join(a for a in anchors if not isinstance(a, tuple))
    return [w for w in ("ZFW", "TOW", "LAW", "JETSMART", "WGHTS", "VIC", "WEIGHT") if w in text and f"{w})" not in text.replace("(?:LW|LAW)", "") and not (w == "LAW" and "LW|LAW" in text)]


def kilos(c: Column, unit: str) -> Column:
    plain = F.replace(c, F.lit(","), F.lit(""))
    value = {"kg": whole(plain), "tonnes": F.floor(number(plain) * 1000), "lb": F.floor(whole(plain) * 0.453592)}[unit]
    return F.nullif(value, F.lit(0).cast("bigint"))


def _sheet(text: Column, label: Column) -> Column:
    t = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\t"), F.lit(" "))
    out = None
    for name, labels, unit, anchors in FORMATS:
        form = Format(name, pattern(anchors))
        names = form.java()[1]

        def made(g, name=name, unit=unit, names=names):
            at = lambda n: text_of(F.trim(g(n), F.lit(" \t\r\n"))) if n in names else F.lit(None).cast("string")
            weights = {n: kilos(at(n), unit) for n in ("zfw", "zfw_max", "tow", "tow_max", "law", "law_max", "tof", "tif")}
            s = F.struct(
                F.lit(name).alias("format_name"), at("status").alias("status"), at("tail").alias("tail"), F.replace(at("flight"), F.lit(" "), F.lit("")).alias("flight"), at("origin").alias("origin"), at("destination").alias("destination"),
                *[c.alias(n) for n, c in weights.items()], F.nullif(whole(at("pax_total")), F.lit(0).cast("bigint")).alias("pax"), at("crew").alias("crew"), at("mac_zfw").alias("mac_zfw"), at("mac_tow").alias("mac_tow"), at("edition").alias("edition"),
            )
            return bind(s, lambda r: F.when(r["zfw"].isNotNull() | r["tow"].isNotNull(), r))

        there = label.isin(*labels)
        for w in words(anchors):
            there = there & t.contains(w)
        here = there & form.matches(t)
        out = (F.when if out is None else out.when)(here, form.captures(t, made, sure=True))
    return out


DECODERS = [
    Decoder("loadsheet", "loadsheet", tuple(dict.fromkeys(x for _, labels, _, _ in FORMATS for x in labels)), 60, lambda t: F.upper(t).contains("LOADSHEET"), _sheet, upper=False, by_label=True),
]
