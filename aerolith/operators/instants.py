"""Problem 5: written times of any format and zone into instants of UTC.

For each value all valid interpretations are generated: (instant, format, cost). An
interpretation that keeps the rules of the feed (the date order of the station's
zone, the first of two equal local times, a bare number's usual unit, day-hour-minute
groups) costs nothing, one that departs from them much. Where no rule says which one
holds, all cost nothing: slash dates with a zone of their own from stations of unknown
zone may have the day or the month first, and some abbreviations name several zones
(CST, IST, BST, AST) of which the place doesn't keep one. Values of one source, in
record order, are then chosen together by Viterbi: a switch of format between
neighbours and a step back in time cost a little, so that the records around a value
decide among interpretations the rules leave equal. Sources are cut into blocks of
bounded size with a halo (see `ordered`); at a value with one interpretation, as nearly
all are, the path does not depend on what lies before, so blocks agree.

Rules: without zone, a date and time is local, at the station for the message's own
time, at origin and destination for departure and arrival. A time of day alone, or
with a day of the month, is the first such moment at or after the message's time, in
UTC unless marked as local. Local times that occur twice mean the first, those that
were skipped nothing.

Defined results: null, empty, blank, placeholder and impossible values (no format has
more than 64 characters, blanks around it aside) denote nothing and give no row; so do local values whose
place has no known zone, slash dates without zone of such places, and times of day of messages
without a usable time. Null sources are one source; null ids come first. Repeated rows
each give their rows. Empty tables give no rows.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.operators.ordered import blocks
from aerolith.sources.tables import shuffle_width

BLOCK, HALO = 20_000, 32
ODD = 20.0  # cost of an interpretation against the rules
SWITCH, BACK = 0.5, 0.5
EPOCH = datetime(1970, 1, 1)
US = timedelta(microseconds=1)

# Hours from UTC of zone abbreviations.
ZONES = {
    "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 1, "BST": 1, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3, "EAT": 3, "MSK": 3, "IST": 5.5, "JST": 9, "KST": 9,
    "AWST": 8, "ACST": 9.5, "ACDT": 10.5, "AEST": 10, "AEDT": 11, "NZST": 12, "NZDT": 13, "NST": -3.5, "NDT": -2.5, "AST": -4, "ADT": -3, "EST": -5, "EDT": -4,
    "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "AKST": -9, "AKDT": -8, "HST": -10,
}
# Abbreviations in use for several zones, with the hours of the others.
OTHER_ZONES = {"CST": (8, -5), "IST": (1, 2), "BST": (6,), "AST": (3,)}
MONTHS = {m: i + 1 for i, m in enumerate("JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split())}

_clock = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_iso = re.compile(rf"(\d{{4}})-(\d{{2}})-(\d{{2}})[T ]{_clock} ?(Z|[+-]\d{{2}}:?\d{{2}}|[A-Z]{{2,5}})?")
_basic = re.compile(r"(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})(Z|[+-]\d{2}:?\d{2})?")
_slash = re.compile(rf"(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}) {_clock} ?(AM|PM)? ?(Z|UTC|GMT|[+-]\d{{2}}:?\d{{2}})?")
_mail = re.compile(r"(?:[A-Z]{3}, ?)?(\d{1,2}) ([A-Z]{3}) (\d{4}) (\d{2}):(\d{2})(?::(\d{2}))? ?([+-]\d{2}:?\d{2}|[A-Z]{1,4})")
_short = re.compile(r"(\d{2})([A-Z]{3})(\d{2}) (\d{2})(\d{2})(Z)?")
_number = re.compile(r"\d{9,20}(?:\.\d{1,9})?")
_of_day = re.compile(r"(?:[A-Z]{2,4} )?(?:(\d{2})/)?(\d{2}):?(\d{2}) ?(Z|UTC|L|LCL)?")
_group = re.compile(r"(\d{2})(\d{2})(\d{2})(Z|L)")


@lru_cache(maxsize=1024)
def zone_of(name: str | None) -> ZoneInfo | None:
    try:
        return ZoneInfo(name) if name else None
    except (KeyError, ValueError, OSError):
        return None


def _us(moment: datetime) -> int:
    return (moment - EPOCH) // US


def local(moment: datetime, zone: ZoneInfo | None) -> list[tuple[int, float]]:
    """(instant, cost) of a local time: none if it was skipped, two if it occurred twice."""
    if zone is None:
        return []
    out = []
    for fold, cost in ((0, 0.0), (1, ODD)):
        try:
            instant = moment - moment.replace(tzinfo=zone, fold=fold).utcoffset()
            back = instant.replace(tzinfo=timezone.utc).astimezone(zone).replace(tzinfo=None)
        except OverflowError:
            return []
        if back != moment:
            return []
        if not out or out[0][0] != _us(instant):
            out.append((_us(instant), cost))
    return out


def _moment(y, mo, d, h, mi, s, fraction=None) -> datetime | None:
    try:
        return datetime(int(y), int(mo), int(d), int(h), int(mi), int(s or 0), int((fraction or "0").ljust(6, "0")[:6]))
    except ValueError:
        return None


def _offsets(text: str, moment: datetime, zone: ZoneInfo | None) -> list[timedelta]:
    """The offsets a zone mark may stand for at a local time: one, that of the place if it is among several, or all of them."""
    if text[0] in "+-":
        hours, minutes = int(text[1:3]), int(text[-2:])
        if hours > 15 or minutes > 59:
            return []
        return [timedelta(hours=hours, minutes=minutes) * (1 if text[0] == "+" else -1)]
    if text not in ZONES:
        return []
    every = [timedelta(hours=h) for h in (ZONES[text], *OTHER_ZONES.get(text, ()))]
    if len(every) > 1 and zone is not None:
        try:
            here = moment.replace(tzinfo=zone)
            kept = [x for x in every if here.tzname() == text and here.utcoffset() == x]
        except OverflowError:
            kept = []
        return kept or every[:1]  # elsewhere, the usual one
    return every


def _zoned(moment: datetime | None, mark: str | None, zone: ZoneInfo | None, form: str) -> list[tuple[int, str, float]]:
    if moment is None:
        return []
    if mark:
        try:
            return [(_us(moment - offset), f"{form}+{i or ''}", 0.0) for i, offset in enumerate(_offsets(mark, moment, zone))]
        except OverflowError:
            return []
    return [(us, form, cost) for us, cost in local(moment, zone)]


def full(value: str, zone_name: str | None, station_zone: str | None) -> list[tuple[int, str, float]]:
    """Interpretations of a value that has a date, or is a bare number; the station's zone tells the order of its dates."""
    zone = zone_of(zone_name)
    if m := _iso.fullmatch(value):
        return _zoned(_moment(*m.groups()[:7]), m[8], zone, "iso")
    if m := _basic.fullmatch(value):
        return _zoned(_moment(*m.groups()[:6]), m[7], zone, "basic")
    if m := _slash.fullmatch(value):
        a, b, y, h, mi, s, fraction, half, mark = m.groups()
        if half:
            if not 1 <= int(h) <= 12:
                return []
            h = int(h) % 12 + 12 * (half == "PM")
        usual = None if not station_zone else "month/day" if station_zone.startswith("America/") else "day/month"
        out = []
        for mo, d, form in ((a, b, "month/day"), (b, a, "day/month")):
            out += [(us, form, c + (ODD if usual and form != usual else 0.0)) for us, _, c in _zoned(_moment(y, mo, d, h, mi, s, fraction), mark, zone, form)]
        # A date that is impossible in the order of its station denotes nothing.
        return out if any(c < ODD for _, _, c in out) else []
    if m := _mail.fullmatch(value):
        d, mo, y, h, mi, s, mark = m.groups()
        return _zoned(_moment(y, MONTHS[mo], d, h, mi, s), mark, zone, "mail") if mo in MONTHS else []
    if m := _short.fullmatch(value):
        d, mo, y, h, mi, mark = m.groups()
        return _zoned(_moment(2000 + int(y), MONTHS[mo], d, h, mi, 0), mark, zone, "short") if mo in MONTHS else []
    if _number.fullmatch(value):
        whole, _, fraction = value.partition(".")
        out = []
        usual = 0 if len(whole) < 12 else 3 if len(whole) < 15 else 6 if len(whole) < 18 else 9
        for power in (0, 3, 6, 9):
            digits = int(whole + fraction.ljust(9, "0")[:9])  # in units of 10 ** -(power + 9) s
            us = digits // 10 ** (power + 3)
            if power == usual or 946_684_800_000_000 <= us < 4_102_444_800_000_000:
                out.append((us, f"number{power}", 0.0 if power == usual else ODD))
        return out
    return []


def _days(start: datetime, day: int | None):
    """The days from the one of `start` on, or those among them with the given day of the month."""
    base = datetime(start.year, start.month, start.day)
    for i in range(-1, 3 if day is None else 64):
        try:
            d = base + timedelta(days=i)
        except OverflowError:
            return
        if day is None or d.day == day:
            yield d


def following(at: int, hour: int, minute: int, second: int, day: int | None, zone: ZoneInfo | None) -> int | None:
    """The first moment at or after `at` with this time of day, and day of the month, in a zone (None: UTC)."""
    try:
        start = EPOCH + at * US
        start = start if zone is None else start.replace(tzinfo=timezone.utc).astimezone(zone).replace(tzinfo=None)
    except OverflowError:
        return None
    for d in _days(start, day):
        moment = d.replace(hour=hour, minute=minute, second=second)
        us = _us(moment) if zone is None else next((u for u, _ in local(moment, zone)), None)
        if us is not None and us >= at:
            return us
    return None


def partial(value: str, zone_name: str | None, at: int | None) -> list[tuple[int, str, float]]:
    """Interpretations of a time of day, with or without a day of the month, after a message's time."""
    found = []
    if m := _of_day.fullmatch(value):
        found.append((int(m[2]), int(m[3]), 0, int(m[1]) if m[1] else None, m[4], "time", 0.0))
    if m := _group.fullmatch(value):
        found.append((int(m[2]), int(m[3]), 0, int(m[1]), m[4], "day-time", 0.0))
        found.append((int(m[1]), int(m[2]), int(m[3]), None, m[4], "time-seconds", ODD))
    out = []
    for h, mi, s, day, mark, form, cost in found:
        if at is None or h > 23 or mi > 59 or s > 59 or day is not None and not 1 <= day <= 31:
            continue
        zone = zone_of(zone_name) if mark in ("L", "LCL") else None
        if mark in ("L", "LCL") and zone is None:
            continue
        if (us := following(at, h, mi, s, day, zone)) is not None:
            out.append((us, form, cost))
    rules = [x for x in out if x[2] < ODD]
    # A six-digit group that is no day-hour-minute is impossible, not another format.
    return out if rules else []


def interpretations(value: str | None, zone_name: str | None, at: int | None = None, own: bool = False, station_zone: str | None = None) -> list[tuple[int, str, float]]:
    """All valid interpretations; `own`: the message's own time, which must have a date and is that of its station."""
    if value is None or len(value := value.strip()) > 64:
        return []
    text = value.upper()
    return full(text, zone_name, zone_name if own else station_zone) or ([] if own else partial(text, zone_name, at))


def viterbi(values: list[list[tuple[int, str, float]]]) -> list[int | None]:
    """The chosen instant of each value along the record order; None where there is no interpretation."""
    known = [i for i, v in enumerate(values) if v]
    out: list[int | None] = [None] * len(values)
    costs, back, prior = [], [], None
    for i in known:
        now = values[i]
        if prior is None:
            costs.append([c for _, _, c in now])
            back.append([0] * len(now))
        else:
            row, came = [], []
            for us, form, c in now:
                steps = [costs[-1][k] + SWITCH * (form != f) + BACK * (us < u) for k, (u, f, _) in enumerate(prior)]
                best = min(range(len(steps)), key=steps.__getitem__)
                row.append(steps[best] + c)
                came.append(best)
            low = min(row)
            costs.append([x - low for x in row])
            back.append(came)
        prior = now
    if known:
        at = min(range(len(costs[-1])), key=costs[-1].__getitem__)
        for j in range(len(known) - 1, -1, -1):
            out[known[j]] = values[known[j]][at][0]
            at = back[j][at]
    return out


FIELDS = ("timestamp", "departure_time", "eta")


def instants(inbound: DataFrame, stations: DataFrame, airports: DataFrame) -> DataFrame:
    """(id, field_name, utc_ms) of each value that denotes an instant."""

    def zones(places: DataFrame, code: str, name: str) -> DataFrame:
        return places.where(f"{code} IS NOT NULL").groupBy(F.col(code).alias(f"__{name}")).agg(F.min("tz").alias(name))

    rows = inbound.select(
        "id", F.coalesce("id", -F.pmod(F.xxhash64(*FIELDS), F.lit(1 << 40)) - 1).alias("ord"), F.coalesce("source", F.lit("")).alias("source"), *[F.col(f).cast("string").alias(f) for f in FIELDS], "station_ident", "origin", "destination"
    )
    for column, places, code, name in (("station_ident", stations, "ident", "tz0"), ("origin", airports, "icao", "tz1"), ("destination", airports, "icao", "tz2")):
        known = zones(places, code, name)
        rows = rows.join(known, F.col(column) == F.col(f"__{name}"), "left").drop(f"__{name}", column)
    cut = blocks(rows, "source", ["ord", *FIELDS], F.floor(F.col("ord") / F.when(F.col("ord") < 0, F.lit(1 << 30)).otherwise(F.lit(10_000))), BLOCK, HALO).repartition(shuffle_width(inbound.sparkSession), "source", "block")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        plain = {c: [None if x is None or x != x else x for x in pdf[c]] for c in (*FIELDS, "tz0", "tz1", "tz2")}
        chosen = {"timestamp": viterbi([interpretations(v, z, own=True) for v, z in zip(plain["timestamp"], plain["tz0"])])}
        for field, tz in (("departure_time", "tz1"), ("eta", "tz2")):
            chosen[field] = viterbi([interpretations(v, z, at, station_zone=s) for v, z, at, s in zip(plain[field], plain[tz], chosen["timestamp"], plain["tz0"])])
        out = [(i, f, us // 1000) for f in FIELDS for i, core, us in zip(pdf["id"], pdf["is_core"], chosen[f]) if core and us is not None]
        made = pd.DataFrame(out, columns=["id", "field_name", "utc_ms"])
        return made.astype({"id": "Int64", "utc_ms": "int64"})

    return cut.groupBy("source", "block").applyInPandas(run, "id bigint, field_name string, utc_ms bigint")
