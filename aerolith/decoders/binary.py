"""Binary surveillance reports and datalink envelopes, decoded batch by batch in Arrow.

Bit fields can't be read by column expressions at a reasonable size, so these two
decoders take the raw text of the few labels that carry them, after a check in the
JVM, and return a record as JSON. Groups are described by tables of bit positions.

Fixed values: labels, tags and their sizes, field positions and registration forms.
"""

from __future__ import annotations

import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolith.decoders.controller import message as elements_of
from aerolith.decoders.engine import Decoder, dispatch, records

GOOD = 0x1D0F


def checked(prefix: str, payload: bytes) -> bool:
    """Whether the ten characters and the payload, with its checksum, agree."""
    return len(prefix) == 10 and len(payload) >= 2 and binascii.crc_hqx(prefix.encode("latin-1", "replace") + payload, 0xFFFF) == GOOD


def bits(data: bytes, start: int, width: int, signed: bool = False) -> int:
    value = int.from_bytes(data, "big") >> (len(data) * 8 - start - width) & (1 << width) - 1
    return value - (1 << width) if signed and value >> (width - 1) else value


def scaled(data: bytes, start: int, width: int, limit: float) -> float:
    """A signed field that spans a range up to the limit."""
    return (limit - limit / 2 / 2 ** (width - 2)) * bits(data, start, width, True) / (2 ** (width - 1) - 1)


def turned(data: bytes, start: int, width: int) -> float:
    return scaled(data, start, width, 180.0) % 360.0


def position(data: bytes, at: int = 0) -> dict:
    return {"latitude": scaled(data, at, 21, 180.0), "longitude": scaled(data, at + 21, 21, 180.0), "altitude": bits(data, at + 42, 16, True) * 2}


def basic(data: bytes) -> dict:
    out = position(data) | {"report_time_sec": bits(data, 58, 15) * 0.125}
    flags = data[9] & 0x7F
    if abs(out["latitude"]) > 90:
        out["latitude"] = 0.0
    return out | {"nav_redundancy": bool(flags & 1), "accuracy": flags >> 1 & 7, "tcas_available": bool(flags & 16)}


def flight_id(data: bytes) -> dict:
    codes = [bits(data, 6 * i, 6) for i in range(8)]
    return {"adsc_flight_id": "".join(chr(c if c & 32 else c + 64) for c in codes).rstrip(" ")}


def route(data: bytes) -> dict:
    def point(at: int) -> dict:
        p = position(data, at)
        return {"latitude": p["latitude"], "longitude": p["longitude"], "altitude_ft": p["altitude"]}

    return {"predicted_route": {"next_waypoint": point(0) | {"eta_seconds": bits(data, 58, 14)}, "next_next_waypoint": point(72)}}


def earth(data: bytes) -> dict:
    return {"earth_ref": {"track_deg": turned(data, 1, 12), "track_invalid": bool(bits(data, 0, 1)), "ground_speed_kts": bits(data, 13, 13) / 2, "vert_speed_fpm": bits(data, 26, 12, True) * 16}}


def air(data: bytes) -> dict:
    return {"air_ref": {"heading_deg": turned(data, 1, 12), "heading_invalid": bool(bits(data, 0, 1)), "mach": bits(data, 13, 13) / 1000, "vert_speed_fpm": bits(data, 26, 12, True) * 16}}


def meteo(data: bytes) -> dict:
    return {"meteo": {"wind_speed_kts": bits(data, 0, 9) / 2, "wind_direction_deg": turned(data, 10, 9), "wind_dir_invalid": bool(bits(data, 9, 1)), "temperature_c": scaled(data, 19, 12, 512.0)}}


# tag: (message type if it comes first, size of the group, what it holds)
GROUPS = {
    0x03: ("acknowledgment", 1, None), 0x04: ("nack", 2, None), 0x05: ("noncompliance", 2, None), 0x06: ("cancel_emergency", 0, None), 0x07: ("basic", 10, basic), 0x09: ("emergency", 10, basic), 0x0A: ("lateral_deviation", 10, basic),
    0x0C: ("", 6, flight_id), 0x0D: ("", 17, route), 0x0E: ("", 5, earth), 0x0F: ("", 5, air), 0x10: ("", 4, meteo), 0x11: ("", 3, lambda d: {"airframe_id": d.hex().upper()}), 0x12: ("vert_rate_change", 10, basic),
    0x13: ("altitude_range", 10, basic), 0x14: ("waypoint_change", 10, basic), 0x16: ("", 8, None), 0x17: ("", 9, None),
}


def groups(payload: bytes) -> dict:
    """The fields of all groups up to the first unknown or incomplete one."""
    out: dict = {"message_type": "", "payload_bytes": len(payload)}
    at = 0
    while at < len(payload):
        tag, at = payload[at], at + 1
        name, size, read = GROUPS.get(tag, (f"unknown_{tag:02x}", None, None))
        if at == 1:
            out["message_type"] = name
        if size is None or len(payload) < at + size:
            break
        if read:
            out |= read(payload[at : at + size])
        if tag == 0x05:
            size += payload[at + 1] * 2
        at += size
    return out


_flight = re.compile(r"([A-Z0-9]{2}\d{3,4}[A-Z]?)$")


def surveillance(text: str) -> dict | None:
    at = text.find(".ADS.")
    if at < 0:
        return None
    prefix, head, digits = text[:at], text[at + 1 : at + 11], text[at + 11 :]
    if len(head) < 10 or len(digits) < 6 or not re.fullmatch(r"(?:[0-9A-Fa-f]{2})+", digits):
        return None
    payload = bytes.fromhex(digits)
    if not checked(head, payload):
        return None
    before, slash, station = prefix.rpartition("/")
    found = _flight.search(before if slash else prefix)
    record = {"flight_id": found[1] if found else None, "registration": head[3:].lstrip("."), "ground_station": station if slash else None, "raw_hex": digits}
    return record | groups(payload[:-2])


# Registrations by their form, in the order in which they are tried.
TAILS = re.compile(
    "|".join(
        (
            r"[A-Z]{1,2}-[A-Z]{3,4}",
            r"VH-[A-Z]{3}",
            r"B-[A-Z0-9]{3,4}",
            r"TC-[A-Z]{3}",
            r"N[0-9]{1,5}[A-Z]{0,2}",
            r"JA[0-9]{3,4}[A-Z]?",
            r"HL[0-9]{4}",
            r"9V-[A-Z]{3}",
            r"9M-[A-Z]{3}",
            r"A7-[A-Z]{3}",
            r"A6-[A-Z]{3}",
            r"A4O-[A-Z]{2,3}",
            r"HS-[A-Z]{3}",
            r"VN-[A-Z][0-9]{3}",
            r"EC-[A-Z]{3}",
            r"HB-[A-Z]{3}",
            r"OH-[A-Z]{3}",
            r"LN-[A-Z]{3}",
            r"SE-[A-Z]{3}",
        )
    )
)


def envelope(text: str, tail: str | None = None) -> dict | None:
    """Station, kind and aircraft of a wrapped binary message; None if its checksum fails."""
    found = next(((text.find(m), m[1:]) for m in (".AT1", ".CR1", ".ADS") if m in text), None)
    out: dict = {"station": None, "message_type": None, "tail": None}
    if text.startswith("/") and found and found[0] >= 5:
        at, kind = found
        out |= {"station": text[1:at], "message_type": kind}
        head, digits = text[at + 1 : at + 11], text[at + 11 :]
        if len(head) == 10:
            register = head[3:].lstrip(".").upper()
            m = (TAILS.match(register + digits[:6].upper()) if len(digits) >= 6 else None) or TAILS.match(register)
            out["tail"] = m[0] if m else None
            if len(digits) >= 4 and re.fullmatch(r"(?:[0-9A-Fa-f]{2})+", digits):
                payload = bytes.fromhex(digits)
                if len(payload) < 3 or not checked(head, payload):
                    return None
                payload = payload[:-2]
                out["payload_bytes"] = len(payload)
                if kind == "ADS" and payload[0] in (7, 8):
                    out |= _short_fields(payload)
    out["tail"] = out["tail"] or tail or None
    return out if out["tail"] or out["station"] else None


def _short_fields(payload: bytes) -> dict:
    """The short tags of an envelope: a level, and in position reports latitude and longitude."""
    sizes = {0x0B: 2, 0x0A: 3, 0x12: 3, 0x13: 3, 0x14: 3} if payload[0] == 8 else {0x0B: 2} | dict.fromkeys((0x0C, 0x0D, 0x0E, 0x0F, 0x10, 0x15), 2)
    out, i = {}, 2
    while i < len(payload) - 1:
        size = sizes.get(payload[i], 1)
        if size > 1 and i + size <= len(payload):
            value = payload[i + 1 : i + size]
            if payload[i] == 0x0B and value[0]:
                out["altitude"] = f"FL{value[0]:03d}"
            elif payload[0] == 8 and payload[i] in (0x12, 0x13):
                name, limit = ("latitude", 90.0) if payload[i] == 0x12 else ("longitude", 180.0)
                out[name] = int.from_bytes(value, "big", signed=True) * limit / 32768
            i += size
        else:
            i += 1
    return out


READERS = {"adsc": (("B6",), ".ADS.", surveillance), "envelope": (("AA", "A6"), ".", envelope)}


def read_one(which: str, text: str, label: str | None) -> dict | None:
    read = READERS[which][2]
    return read(text, label) if which == "cpdlc" else read(text)


def as_json(record: dict) -> str:
    return json.dumps({k: v for k, v in record.items() if v is not None})


def decode_binary(messages: DataFrame, which: str, id_col: str = "delivery_id", text_col: str = "raw_text", label_col: str = "label") -> DataFrame:
    """(id, result_type, result): the records of one reader as JSON."""
    labels, mark, _ = READERS[which]
    rows = messages.where(F.col(label_col).isin(*labels) & F.col(text_col).contains(mark)).select(F.col(id_col), F.trim(F.col(text_col), F.lit(" \t\r\n")).alias("text"), F.col(label_col).alias("label"))
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [read_one(which, t, label) for t, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            keep = [i for i, m in enumerate(made) if m is not None]
            texts = [as_json(made[i]) for i in keep]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array([which] * len(keep), pa.string()), pa.array(texts, pa.string())], [id_col, "result_type", "result"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, result_type string, result string")


PRIORITIES = {"adsc": 10, "cpdlc": 50, "envelope": 100}
RECORD = T.ArrayType(T.StructType([T.StructField("ord", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in ("parser", "result_type", "result")]]))


def dispatch_every(messages: DataFrame, decoders: list[Decoder], keep: tuple[str, ...] = ("delivery_id",), first: bool = False, text_col: str = "raw_text", label_col: str = "label") -> DataFrame:
    """What `dispatch` gives, with the records of the binary readers in their places."""
    ordered = sorted([(d.priority, d.name) for d in decoders] + [(p, n) for n, p in PRIORITIES.items()])
    places = {name: i for i, (_, name) in enumerate(ordered)}
    marked = {x for labels, _, _ in READERS.values() for x in labels}
    able = [d for d in decoders if not d.labels or marked & set(d.labels)]  # the others see nothing of these labels
    wrapped = F.coalesce(F.col(label_col).isin(*sorted(marked)), F.lit(False))
    plain = dispatch(messages.where(~wrapped), decoders, keep, first, text_col, label_col, places)
    text = F.trim(F.col(text_col), F.lit(" \t\r\n"))
    rows = messages.where(wrapped).select(*keep, text.alias("__text"), F.col(label_col).alias("__label"), records(able, text_col, label_col, places).alias("some"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = []
            for text, label in zip(batch.column(batch.num_columns - 3).to_pylist(), batch.column(batch.num_columns - 2).to_pylist()):
                made = [(n, read_one(n, text, label)) for n, (labels, mark, _) in READERS.items() if label in labels and text and mark in text]
                more.append([{"ord": places[n], "parser": n, "result_type": n, "result": as_json(m)} for n, m in made if m is not None])
            kept = list(range(len(keep)))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], batch.column(batch.num_columns - 1), pa.array(more, _arrow)], [*keep, "some", "more"])

    shape = T.StructType([*[rows.schema[k] for k in keep], T.StructField("some", RECORD), T.StructField("more", RECORD)])
    every = F.array_sort(F.concat("some", "more"))  # by place
    read = rows.mapInArrow(run, shape).select(*keep, F.explode(F.slice(every, 1, 1) if first else every).alias("r")).select(*keep, "r.*")
    return plain.unionByName(read)


_arrow = pa.list_(pa.struct([("ord", pa.int32()), ("parser", pa.string()), ("result_type", pa.string()), ("result", pa.string())]))


# Controller-pilot messages: the frame; `controller` reads the elements.

FRAMES = {"AT1": "cpdlc", "CR1": "connect_request", "CC1": "connect_confirm", "DR1": "disconnect"}
_frame = re.compile(r"/([A-Z0-9]{4,7})\.([A-Z]{2,3}[0-9])\.(.+)")


def split_registration(rest: str) -> tuple[str, str]:
    """The registration and the digits behind it: six characters if what follows are whole bytes, else five, seven, eight, else any."""
    rest = rest.upper()
    whole = re.compile(r"(?:[0-9A-F]{2})+").fullmatch
    for n in (6, 5, 7, 8, *range(1, len(rest))):
        if n < len(rest) and whole(rest[n:]) and (n == 6 or re.search("[A-Z]", rest[:n])):
            return rest[:n], rest[n:]
    return rest, ""


def direction(label: str | None, block: str | None = None, link: str | None = None) -> str:
    if link in ("uplink", "downlink"):
        return link
    if block and block[0].isdigit():
        return "downlink"
    if block and "A" <= block[0] <= "Z":
        return "uplink"
    return "downlink" if label == "AA" else "uplink"


def controller(text: str, label: str | None = None, block: str | None = None, link: str | None = None) -> dict | None:
    """The frame of a controller-pilot message; one that can't be read is a record with its error."""
    m = _frame.fullmatch(text)
    if not m:
        return None
    way = direction(label, block, link)
    out: dict = {"direction": way}
    registration, digits = split_registration(m[3])
    if not digits:
        return out | {"error": "parse_failed"}
    payload = bytes.fromhex(digits)
    if len(payload) < 2:
        return out | {"error": "message_too_short"}
    if not checked(m[2] + f".{registration}".ljust(7)[:7], payload):
        return out | {"error": "crc_failed"}
    out |= {"ground_station": m[1], "registration": registration, "raw_hex": digits, "message_type": FRAMES.get(m[2], "unknown")}
    if out["message_type"] == "cpdlc":
        try:
            out |= elements_of(payload[:-2], way)
        except ValueError:
            out["error"] = "decode_failed"
    return out


READERS["cpdlc"] = (("AA", "BA"), ".", controller)
