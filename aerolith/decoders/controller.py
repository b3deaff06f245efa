"""Elements of controller-pilot messages: bits into values, and values into wording.

A message is a bit string in unaligned packed encoding. What an element carries follows
from its wording: each placeholder stands for one value, in order, and the elements in
UNREAD carry values that are not read, so that what follows them is out of step. Values
are built from a few shapes (numbers of a range, choices, optional parts), stated as
tables. A bit string that ends early, or an element number out of range, is an error.
"""

from __future__ import annotations

import re
from collections.abc import Callable

# The wording of the elements, by number from 0, one a line.
UPLINK = """
UNABLE
STANDBY
REQUEST DEFERRED
ROGER
AFFIRM
NEGATIVE
EXPECT [altitude]
EXPECT CLIMB AT [time]
EXPECT CLIMB AT [position]
EXPECT DESCENT AT [time]
EXPECT DESCENT AT [position]
EXPECT CRUISE CLIMB AT [time]
EXPECT CRUISE CLIMB AT [position]
AT [time] EXPECT CLIMB TO [altitude]
AT [position] EXPECT CLIMB TO [altitude]
AT [time] EXPECT DESCENT TO [altitude]
AT [position] EXPECT DESCENT TO [altitude]
AT [time] EXPECT CRUISE CLIMB TO [altitude]
AT [position] EXPECT CRUISE CLIMB TO [altitude]
MAINTAIN [altitude]
CLIMB TO AND MAINTAIN [altitude]
AT [time] CLIMB TO AND MAINTAIN [altitude]
AT [position] CLIMB TO AND MAINTAIN [altitude]
DESCEND TO AND MAINTAIN [altitude]
AT [time] DESCEND TO AND MAINTAIN [altitude]
AT [position] DESCEND TO AND MAINTAIN [altitude]
CLIMB TO REACH [altitude] BY [time]
CLIMB TO REACH [altitude] BY [position]
DESCEND TO REACH [altitude] BY [time]
DESCEND TO REACH [altitude] BY [position]
MAINTAIN BLOCK [altitude] TO [altitude]
CLIMB TO AND MAINTAIN BLOCK [altitude] TO [altitude]
DESCEND TO AND MAINTAIN BLOCK [altitude] TO [altitude]
CRUISE [altitude]
CRUISE CLIMB TO [altitude]
CRUISE CLIMB ABOVE [altitude]
EXPEDITE CLIMB TO [altitude]
EXPEDITE DESCENT TO [altitude]
IMMEDIATELY CLIMB TO [altitude]
IMMEDIATELY DESCEND TO [altitude]
IMMEDIATELY STOP CLIMB AT [altitude]
IMMEDIATELY STOP DESCENT AT [altitude]
EXPECT TO CROSS [position] AT [altitude]
EXPECT TO CROSS [position] AT OR ABOVE [altitude]
EXPECT TO CROSS [position] AT OR BELOW [altitude]
EXPECT TO CROSS [position] AT AND MAINTAIN [altitude]
CROSS [position] AT [altitude]
CROSS [position] AT OR ABOVE [altitude]
CROSS [position] AT OR BELOW [altitude]
CROSS [position] AT AND MAINTAIN [altitude]
CROSS [position] BETWEEN [altitude] AND [altitude]
CROSS [position] AT [time]
CROSS [position] AT OR BEFORE [time]
CROSS [position] AT OR AFTER [time]
CROSS [position] BETWEEN [time] AND [time]
CROSS [position] AT [speed]
CROSS [position] AT OR LESS THAN [speed]
CROSS [position] AT OR GREATER THAN [speed]
CROSS [position] AT [time] AT [altitude]
CROSS [position] AT OR BEFORE [time] AT [altitude]
CROSS [position] AT OR AFTER [time] AT [altitude]
CROSS [position] AT AND MAINTAIN [altitude] AT [speed]
AT [time] CROSS [position] AT AND MAINTAIN [altitude]
AT [time] CROSS [position] AT AND MAINTAIN [altitude] AT [speed]
OFFSET [distanceoffset] [direction] OF ROUTE
AT [position] OFFSET [distanceoffset] [direction] OF ROUTE
AT [time] OFFSET [distanceoffset] [direction] OF ROUTE
PROCEED BACK ON ROUTE
REJOIN ROUTE BY [position]
REJOIN ROUTE BY [time]
EXPECT BACK ON ROUTE BY [position]
EXPECT BACK ON ROUTE BY [time]
RESUME OWN NAVIGATION
[predepartureclearance]
PROCEED DIRECT TO [position]
WHEN ABLE PROCEED DIRECT TO [position]
AT [time] PROCEED DIRECT TO [position]
AT [position] PROCEED DIRECT TO [position]
AT [altitude] PROCEED DIRECT TO [position]
CLEARED TO [position] VIA [routeclearance]
CLEARED [routeclearance]
CLEARED [procedurename]
CLEARED TO DEVIATE UP TO [distanceoffset] [direction] OF ROUTE
AT [position] CLEARED [routeclearance]
AT [position] CLEARED [procedurename]
EXPECT [routeclearance]
AT [position] EXPECT [routeclearance]
EXPECT DIRECT TO [position]
AT [position] EXPECT DIRECT TO [position]
AT [time] EXPECT DIRECT TO [position]
AT [altitude] EXPECT DIRECT TO [position]
HOLD AT [position] MAINTAIN [altitude] INBOUND TRACK [degrees] [direction] TURNS [legtype]
HOLD AT [position] AS PUBLISHED MAINTAIN [altitude]
EXPECT FURTHER CLEARANCE AT [time]
TURN [direction] HEADING [degrees]
TURN [direction] GROUND TRACK [degrees]
FLY PRESENT HEADING
AT [position] FLY HEADING [degrees]
IMMEDIATELY TURN [direction] HEADING [degrees]
EXPECT [procedurename]
AT [time] EXPECT [speed]
AT [position] EXPECT [speed]
AT [altitude] EXPECT [speed]
AT [time] EXPECT [speed] TO [speed]
AT [position] EXPECT [speed] TO [speed]
AT [altitude] EXPECT [speed] TO [speed]
MAINTAIN [speed]
MAINTAIN PRESENT SPEED
MAINTAIN [speed] OR GREATER
MAINTAIN [speed] OR LESS
MAINTAIN [speed] TO [speed]
INCREASE SPEED TO [speed]
INCREASE SPEED TO [speed] OR GREATER
REDUCE SPEED TO [speed]
REDUCE SPEED TO [speed] OR LESS
DO NOT EXCEED [speed]
RESUME NORMAL SPEED
CONTACT [icaounitname] [frequency]
AT [position] CONTACT [icaounitname] [frequency]
AT [time] CONTACT [icaounitname] [frequency]
MONITOR [icaounitname] [frequency]
AT [position] MONITOR [icaounitname] [frequency]
AT [time] MONITOR [icaounitname] [frequency]
SQUAWK [beaconcode]
STOP SQUAWK
SQUAWK ALTITUDE
STOP ALTITUDE SQUAWK
REPORT BACK ON ROUTE
REPORT LEAVING [altitude]
REPORT LEVEL [altitude]
REPORT PASSING [position]
REPORT REMAINING FUEL AND SOULS ON BOARD
CONFIRM POSITION
CONFIRM ALTITUDE
CONFIRM SPEED
CONFIRM ASSIGNED ALTITUDE
CONFIRM ASSIGNED SPEED
CONFIRM ASSIGNED ROUTE
CONFIRM TIME OVER REPORTED WAYPOINT
CONFIRM REPORTED WAYPOINT
CONFIRM NEXT WAYPOINT
CONFIRM NEXT WAYPOINT ETA
CONFIRM ENSUING WAYPOINT
CONFIRM REQUEST
CONFIRM SQUAWK
CONFIRM HEADING
CONFIRM GROUND TRACK
REQUEST POSITION REPORT
WHEN CAN YOU ACCEPT [altitude]
CAN YOU ACCEPT [altitude] AT [position]
CAN YOU ACCEPT [altitude] AT [time]
WHEN CAN YOU ACCEPT [speed]
WHEN CAN YOU ACCEPT [distanceoffset] [direction] OFFSET
ALTIMETER [altimeter]
RADAR SERVICES TERMINATED
RADAR CONTACT [position]
RADAR CONTACT LOST
CHECK STUCK MICROPHONE [frequency]
ATIS [atiscode]
ERROR [errorinformation]
NEXT DATA AUTHORITY [icaofacilitydesignation]
END SERVICE
SERVICE UNAVAILABLE
[icaofacilitydesignation] [tp4table]
WHEN READY
THEN
DUE TO TRAFFIC
DUE TO AIRSPACE RESTRICTION
DISREGARD
[freetext]
[freetext]
CLIMB AT [verticalrate] MINIMUM
CLIMB AT [verticalrate] MAXIMUM
DESCEND AT [verticalrate] MINIMUM
DESCEND AT [verticalrate] MAXIMUM
REPORT REACHING [altitude]
MAINTAIN OWN SEPARATION AND VMC
AT PILOTS DISCRETION
(reserved)
SQUAWK IDENT
REPORT REACHING BLOCK [altitude] TO [altitude]
REPORT DISTANCE [tofrom] [position]
CONFIRM ATIS CODE
""".strip("\n").split("\n")
DOWNLINK = """
WILCO
UNABLE
STANDBY
ROGER
AFFIRM
NEGATIVE
REQUEST [altitude]
REQUEST BLOCK [altitude] TO [altitude]
REQUEST CRUISE CLIMB TO [altitude]
REQUEST CLIMB TO [altitude]
REQUEST DESCENT TO [altitude]
AT [position] REQUEST CLIMB TO [altitude]
AT [position] REQUEST DESCENT TO [altitude]
AT [time] REQUEST CLIMB TO [altitude]
AT [time] REQUEST DESCENT TO [altitude]
REQUEST OFFSET [distanceoffset] [direction] OF ROUTE
AT [position] REQUEST OFFSET [distanceoffset] [direction] OF ROUTE
AT [time] REQUEST OFFSET [distanceoffset] [direction] OF ROUTE
REQUEST [speed]
REQUEST [speed] TO [speed]
REQUEST VOICE CONTACT
REQUEST VOICE CONTACT [frequency]
REQUEST DIRECT TO [position]
REQUEST [procedurename]
REQUEST [routeclearance]
REQUEST CLEARANCE
REQUEST WEATHER DEVIATION TO [position] VIA [routeclearance]
REQUEST WEATHER DEVIATION UP TO [distanceoffset] [direction] OF ROUTE
LEAVING [altitude]
CLIMBING TO [altitude]
DESCENDING TO [altitude]
PASSING [position]
PRESENT ALTITUDE [altitude]
PRESENT POSITION [position]
PRESENT SPEED [speed]
PRESENT HEADING [degrees]
PRESENT GROUND TRACK [degrees]
LEVEL [altitude]
ASSIGNED ALTITUDE [altitude]
ASSIGNED SPEED [speed]
ASSIGNED ROUTE [routeclearance]
BACK ON ROUTE
NEXT WAYPOINT [position]
NEXT WAYPOINT ETA [time]
ENSUING WAYPOINT [position]
REPORTED WAYPOINT [position]
REPORTED WAYPOINT [time]
SQUAWKING [beaconcode]
POSITION REPORT [positionreport]
WHEN CAN WE EXPECT [speed]
WHEN CAN WE EXPECT [speed] TO [speed]
WHEN CAN WE EXPECT BACK ON ROUTE
WHEN CAN WE EXPECT LOWER ALTITUDE
WHEN CAN WE EXPECT HIGHER ALTITUDE
WHEN CAN WE EXPECT CRUISE CLIMB TO [altitude]
PAN PAN PAN
MAYDAY MAYDAY MAYDAY
[remainingfuel] OF FUEL REMAINING AND [remainingsouls] SOULS ON BOARD
CANCEL EMERGENCY
DIVERTING TO [position] VIA [routeclearance]
OFFSETTING [distanceoffset] [direction] OF ROUTE
DESCENDING TO [altitude]
ERROR [errorinformation]
NOT CURRENT DATA AUTHORITY
[icaofacilitydesignation]
DUE TO WEATHER
DUE TO AIRCRAFT PERFORMANCE
[freetext]
[freetext]
REQUEST VMC DESCENT
REQUEST HEADING [degrees]
REQUEST GROUND TRACK [degrees]
REACHING [altitude]
[versionnumber]
MAINTAIN OWN SEPARATION AND VMC
AT PILOTS DISCRETION
REACHING BLOCK [altitude] TO [altitude]
ASSIGNED BLOCK [altitude] TO [altitude]
AT [time] [distance] [tofrom] [position]
ATIS [atiscode]
DEVIATING [distanceoffset] [direction] OF ROUTE
""".strip("\n").split("\n")

# Uplink elements whose values are not read.
UNREAD = {*range(26, 30), *range(50, 64), 65, 66, 73, *range(76, 79), *range(88, 92), 97, *range(100, 106), 118, 119, 121, 122, 149, 150, 163, 181}
LAST = {"uplink": 182, "downlink": 128}
LABELS = {"uplink": UPLINK, "downlink": DOWNLINK}


class Bits:
    """A bit string read from its start."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data), len(data) * 8

    def take(self, width: int) -> int:
        if width > self.left:
            raise ValueError("bits are missing")
        self.left -= width
        return self.value >> self.left & (1 << width) - 1

    def between(self, low: int, high: int) -> int:
        """A number of a range; as many bits as its width needs."""
        return low + self.take((high - low).bit_length())

    def letters(self, n: int) -> str:
        return "".join(chr(self.take(7)) for _ in range(n))

    def length(self) -> int:
        """A length: one byte, or two of which the first begins with 10, or multiples of 16,384."""
        first = self.take(8)
        if first < 0x80:
            return first
        if first < 0xC0:
            return (first & 0x3F) << 8 | self.take(8)
        if not 1 <= first & 0x3F <= 4:
            raise ValueError("no length")
        return (first & 0x3F) * 16384


Reader = Callable[[Bits], object]


# Shapes


def number(low: int, high: int, times: int = 1) -> Reader:
    return lambda b: b.between(low, high) * times


def word(low: int, high: int) -> Reader:
    return lambda b: b.letters(b.between(low, high))


def named(*names: str, other: str = "") -> Reader:
    """A name by its number; `other` for numbers beyond."""
    top = len(names) - 1
    return lambda b: (*names, *[other] * (1 << top.bit_length()))[b.between(0, top)]


def either(*ways: Reader) -> Reader:
    """One of several shapes, by a number before it; None for numbers beyond."""

    def read(b: Bits):
        at = b.between(0, len(ways) - 1)
        return ways[at](b) if at < len(ways) else None

    return read


def record(**parts: Reader) -> Reader:
    return lambda b: {name: part(b) for name, part in parts.items()}


def optional(first: dict[str, Reader], **parts: Reader) -> Reader:
    """Parts that may be missing, which bits in front tell, behind some that are always there."""

    def read(b: Bits):
        there = [b.take(1) for _ in parts]
        out = {name: part(b) for name, part in first.items()}
        return out | {name: part(b) for (name, part), is_there in zip(parts.items(), there) if is_there}

    return read


def amounts(key: str, *units: tuple[str, int, int, int]) -> Reader:
    """A number with its unit: (unit, least, most, what one step is worth)."""
    return either(*[lambda b, u=unit, r=number(low, high, times): {key: u, "value": r(b)} for unit, low, high, times in units])


# Values. Ranges, steps and names of the encoding.

TIME = record(hours=number(0, 23), minutes=number(0, 59), seconds=number(0, 59))
ALTITUDE = amounts(
    "type", ("feet", 0, 2500, 10), ("meters", 0, 16000, 1), ("feet", 0, 2100, 10), ("meters", 0, 7000, 1), ("feet", 0, 150000, 1), ("meters", 0, 50000, 1), ("flight_level", 30, 600, 1), ("flight_level_metric", 100, 2000, 1)
)
SPEED = amounts("type", ("knots", 7, 38, 10), ("kph", 10, 137, 10), ("knots", 7, 70, 10), ("kph", 10, 137, 10), ("knots", 7, 70, 10), ("kph", 10, 265, 10), ("mach", 61, 92, 1), ("mach", 93, 604, 1))
FREQUENCY = amounts("type", ("hf", 2850, 28000, 1), ("vhf", 117000, 138000, 1), ("uhf", 225000, 399975, 1), ("satcom", 0, 0, 1))
DISTANCE = amounts("unit", ("nm", 0, 9999, 1), ("km", 0, 16000, 1))
NORTH = ("left", "right", "either side", "north", "south", "east", "west", "north-east", "north-west", "south-east", "south-west")
STRENGTH = named("none", "light", "moderate", "severe")
FACILITY = lambda b: b.letters(4)
FIX, NAVAID, AIRWAY = word(1, 5), word(1, 4), word(2, 7)
RUNWAY = record(direction=number(1, 36), configuration=named("left", "right", "center", "none"))
ERRORS = (
    "unrecognized message reference number", "logon data not accepted", "insufficient resources", "service unavailable", "duplicate message reference number", "no operational PDC", "unexpected request reference",
)


def degrees(b: Bits) -> dict:
    magnetic = not b.take(1)
    return ({"magnetic": True} if magnetic else {}) | {"value": b.between(1, 360)}


def offset(b: Bits) -> dict:
    far = amounts("unit", ("nm", 1, 128, 1), ("km", 1, 256, 1))(b)
    return {"distance": far["value"], "unit": far["unit"], "direction": named(*NORTH)(b)}


def coordinates(b: Bits) -> dict:
    sides = []
    for top in (90, 180):
        d, m, s, negative = b.between(0, top), b.between(0, 59), b.between(0, 59), b.take(1)
        sides.append((d + m / 60.0 + s / 3600.0) * (-1 if negative else 1))
    return dict(zip(("latitude", "longitude"), sides))


def bearing_place(b: Bits) -> dict:
    placed = b.take(1)
    out = {"name": FIX(b)} | (coordinates(b) if placed else {})
    b.take(1)  # magnetic or true
    bearing = b.between(1, 360)
    far = amounts("unit", ("nm", 0, 9999, 1), ("km", 1, 1024, 1))(b)
    return out | {"bearing": bearing, "distance": far["value"], "distance_unit": far["unit"]}


def typed(kind: str, part: Reader) -> Reader:
    def read(b: Bits):
        value = part(b)
        return {"type": kind} | (value if isinstance(value, dict) else {"name": value})

    return read


_place = either(typed("fix", FIX), typed("navaid", NAVAID), typed("airport", FACILITY), typed("latlon", coordinates), typed("place_bearing_distance", bearing_place))
POSITION = lambda b: _place(b) or {"type": ""}


def procedure(b: Bits) -> dict:
    kind, onward = named("arrival", "approach", "departure", other="unknown")(b), b.take(1)
    return {"type": kind, "name": word(1, 6)(b)} | ({"transition": FIX(b)} if onward else {})


def climb(b: Bits) -> dict:
    return {"value": b.between(0, 60) * 100 if not b.take(1) else int(float(b.between(0, 200)) * 10 * 3.28084)}


def free_text(b: Bits) -> dict:
    return {"text": b.letters(min(b.length(), 256))}  # the encoding allows 256 characters at most


def failure(b: Bits) -> dict:
    code = b.between(0, len(ERRORS) - 1)
    return {"code": code} | ({"description": ERRORS[code]} if code < len(ERRORS) else {})


def wind(b: Bits) -> dict:
    direction = b.between(0, 359)
    speed = amounts("unit", ("kt", 0, 255, 1), ("km/h", 0, 511, 1))(b)
    return {"direction": direction, "speed": speed["value"], "unit": speed["unit"]}


def on_route(b: Bits) -> str:
    """One part of a route as text; four of its kinds are named only."""
    at = lambda part: lambda b: at_text({"type": "place_bearing_distance"} | part(b))
    plain = lambda text: lambda b: text
    found = either(
        word(1, 6), lambda b: at_text(coordinates(b)), plain("(place-bearing-place-bearing)"), at(bearing_place), AIRWAY, plain("(track-detail)"), FACILITY, plain("(rnp)"), FIX, NAVAID, plain("(hold)")
    )(b)
    if found is None:
        raise ValueError("no part of a route")
    return found


ROUTE = optional(
    {}, airport_departure=FACILITY, airport_destination=FACILITY, runway_departure=RUNWAY, procedure_departure=procedure, runway_arrival=RUNWAY, procedure_approach=procedure, procedure_arrival=procedure, airway_intercept=AIRWAY,
    route_information=lambda b: [on_route(b) for _ in range(b.between(1, 128))], route_info_additional=word(1, 256),
)
REPORT = optional(
    {"position": POSITION}, time=TIME, fix_next=POSITION, fix_next_eta=TIME, fix_next_plus_one=POSITION, altitude=ALTITUDE, speed=SPEED, temperature=number(-100, 100), wind=wind, turbulence=STRENGTH, icing=STRENGTH,
)


# Wording


def time_text(t: dict) -> str:
    return f"{t['hours']:02d}:{t['minutes']:02d}:{t['seconds']:02d}"


def amount_text(a: dict) -> str:
    """An altitude, a speed or a frequency."""
    n = a["value"]
    forms = {"flight_level": f"FL{n}", "flight_level_metric": f"SM{n}", "feet": f"{n} ft", "meters": f"{n} m", "mach": f"M.{n:02d}", "knots": f"{n} kt", "kph": f"{n} km/h", "hf": f"{n} kHz", "satcom": f"SATCOM ch {n}"}
    return forms.get(a["type"], f"{n / 1000.0:.3f} MHz")


def at_text(p: dict) -> str:
    if "bearing" in p and p["name"]:
        return f"{p['name']} {p['bearing']:03d}/{p['distance']}{p['distance_unit']}"
    if p.get("name"):
        return p["name"]
    return f"{p['latitude']:.4f},{p['longitude']:.4f}" if "latitude" in p else ""


def procedure_text(p: dict) -> str:
    return ".".join([p["name"], *([p["transition"]] if p.get("transition") else [])])


def route_text(r: dict) -> str:
    runway = r.get("runway_departure")
    side = {"left": "L", "right": "R", "center": "C"}
    parts = [
        ("DEP", r.get("airport_departure")), ("DEST", r.get("airport_destination")), ("RWY", runway and f"{runway['direction']:02d}{side.get(runway['configuration'], '')}"),
        ("SID", procedure_text(r["procedure_departure"]) if "procedure_departure" in r else None), ("AWY", r.get("airway_intercept")),
    ]
    said = " ".join(f"{k}:{v}" for k, v in parts if v is not None and (v or k == "SID"))
    return f"[{said}]" if said else "(route clearance)"


def report_text(r: dict) -> str:
    out = at_text(r["position"])
    if "time" in r:
        out += " at " + time_text(r["time"])
    if "altitude" in r:
        out += " " + amount_text(r["altitude"])
    if "fix_next" in r:
        out += " next:" + at_text(r["fix_next"]) + (" ETA:" + time_text(r["fix_next_eta"]) if "fix_next_eta" in r else "")
    return out


# A placeholder's value: its name in a record of several, its shape, and how it is said (None: the placeholder stays).
VALUES: dict[str, tuple[str, Reader, Callable | None]] = {
    "altitude": ("altitude", ALTITUDE, amount_text),
    "time": ("time", TIME, time_text),
    "position": ("position", POSITION, at_text),
    "speed": ("speed", SPEED, amount_text),
    "degrees": ("degrees", degrees, lambda d: f"{d['value']:03d}{'M' if d.get('magnetic') else 'T'}"),
    "direction": ("direction", named("left", "right"), str),
    "distanceoffset": ("distance_offset", offset, lambda o: f"{o['distance']} {o['unit']}"),
    "frequency": ("frequency", FREQUENCY, amount_text),
    "icaounitname": ("unit", FACILITY, str),
    "beaconcode": ("code", lambda b: {"code": "".join(str(b.take(3)) for _ in range(4))}, lambda c: c["code"]),
    "altimeter": ("altimeter", lambda b: {"type": "hpa", "value": b.between(7500, 12500) / 10.0} if b.take(1) else {"type": "inhg", "value": b.between(2200, 3200) / 100.0}, None),
    "atiscode": ("atis", lambda b: chr(ord("A") + b.between(0, 25)), str),
    "errorinformation": ("error", failure, lambda e: e.get("description", "")),
    "icaofacilitydesignation": ("facility", FACILITY, str),
    "freetext": ("text", free_text, lambda t: t["text"]),
    "verticalrate": ("rate", climb, lambda r: f"{r['value']} ft/min"),
    "routeclearance": ("route_clearance", ROUTE, route_text),
    "procedurename": ("procedure", procedure, procedure_text),
    "versionnumber": ("version", number(0, 15), None),
    "remainingfuel": ("remaining_fuel", record(hours=number(0, 99), minutes=number(0, 59)), lambda f: f"{f['hours']}h{f['minutes']:02d}m"),
    "remainingsouls": ("persons_on_board", record(count=number(0, 1023)), lambda p: str(p["count"])),
    "positionreport": ("report", REPORT, report_text),
    "distance": ("distance", DISTANCE, lambda d: f"{d['value']} {d['unit']}"),
    "tofrom": ("to_from", named("to", "from"), str),
}
_placeholder = re.compile(r"\[(\w+)\]")


def element(b: Bits, way: str) -> dict:
    """The next element: id, label, data (absent where it carries none) and text."""
    at = b.between(0, LAST[way])
    if at > LAST[way]:
        raise ValueError(f"no element {at}")
    label = LABELS[way][at] if at < len(LABELS[way]) else "(reserved)"
    out: dict = {"id": at, "label": label}
    if way == "uplink" and at in UNREAD:
        return out | {"text": label}
    wanted = _placeholder.findall(label)
    if "distanceoffset" in wanted:  # its direction comes with it
        wanted.remove("direction")
    read = [(name, VALUES[name][1](b)) for name in wanted]
    said = {name: [VALUES[name][2](v) for n, v in read if n == name] for name in wanted if VALUES[name][2]}
    for name, value in read:
        if name == "distanceoffset":
            said["direction"] = [value["direction"]]
    if len(read) == 1:
        out["data"] = read[0][1]
    elif read:
        names = [VALUES[n][0] for n, _ in read]
        out["data"] = {f"{k}{names[: i + 1].count(k)}" if names.count(k) > 1 else k: v for i, (k, (_, v)) in enumerate(zip(names, read))}
    # Several placeholders of one name take their values in order.
    return out | {"text": _placeholder.sub(lambda m: (said[m[1]].pop(0) if len(said[m[1]]) > 1 else said[m[1]][0]) if m[1] in said else m[0], label)}


def message(payload: bytes, way: str) -> dict:
    """header, elements and formatted_text; ValueError where bits are missing or out of range."""
    b = Bits(payload)
    more, has_ref, has_time = b.take(1), b.take(1), b.take(1)
    header: dict = {"msg_id": b.between(0, 63)}
    if has_ref:
        header["msg_ref"] = b.between(0, 63)
    if has_time:
        header["timestamp"] = TIME(b)
    elements = [element(b, way)]
    if more:
        elements += [element(b, way) for _ in range(b.between(1, 4))]
    return {"header": header, "elements": elements, "formatted_text": "; ".join(e["text"] or e["label"] for e in elements)}
