"""Named formats as column expressions.

A format is a regular expression with named groups and {NAME} placeholders. It is
translated to Java's dialect once, on the driver; all of its groups come from one
match, which a lambda binds so that no field runs the expression again. A decoder
is a function from a text column to a struct column that is null where the text is
none of its messages; Catalyst sees nothing but built-in expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUT = "\x01"  # between captures; texts that hold it are not decoded

# The components that formats are built from.
BASE = {
    "ICAO": r"[KYEPCZLRVOSWUABDFGHMNT][A-Z]{3}",
    "IATA": r"[A-Z]{3}",
    "FLIGHT": r"[A-Z]{2,3}\d{1,4}[A-Z]{0,2}",
    "TIME4": r"\d{4}",
    "TIME6": r"\d{6}",
    "LAT_DIR": r"[NS]",
    "LAT_5D": r"\d{5}",
    "LAT_DMS": r"\d{6}",
    "LAT_DEC": r"[-\d.]+",
    "LON_DIR": r"[EW]",
    "LON_5D": r"\d{5}",
    "LON_6D": r"\d{6}",
    "LON_DMS": r"\d{6,7}",
    "LON_DEC": r"[-\d.]+",
    "HEADING": r"\d{3}",
    "TEMP_SIGN": r"[MP]",
    "TEMP": r"\d{1,3}",
    "WIND_DIR": r"\d{3}",
    "WIND_SPD": r"\d{2,3}",
    "RUNWAY": r"\d{1,2}[LRC]?",
    "ATIS": r"[A-Z]",
}


def to_java(pattern: str) -> tuple[str, list[str]]:
    """The pattern in Java's dialect, with plain groups, and the groups' names in order."""
    names = re.findall(r"\(\?P<(\w+)>", pattern)
    out = re.sub(r"\(\?P<\w+>", "(", pattern)
    out = re.sub(r"(?<!\\)\$$", r"\\z", out)  # the end of the text, not the last line's
    in_class, made, i = False, [], 0
    while i < len(out):  # \s is five characters here, also inside a class
        c = out[i]
        if c == "\\" and i + 1 < len(out):
            made.append({"s": r" \t\n\f\r" if in_class else r"[ \t\n\f\r]"}.get(out[i + 1], out[i : i + 2]))
            i += 2
            continue
        in_class = c == "[" or in_class and c != "]"
        made.append(c)
        i += 1
    return "(?d)" + "".join(made), names


@dataclass(frozen=True)
class Format:
    name: str
    pattern: str
    parts: Mapping[str, str] = field(default_factory=dict)

    def java(self) -> tuple[str, list[str]]:
        known = {**BASE, **self.parts}
        return to_java(re.sub(r"\{([A-Z_0-9]+)\}", lambda m: known.get(m[1], m[0]), self.pattern))

    def matches(self, text: Column) -> Column:
        return text.rlike(self.java()[0]) & ~text.contains(CUT)

    def captures(self, text: Column, build: Callable[[Callable[[str], Column]], Column], sure: bool = False) -> Column:
        """What `build` makes of the captures (a function from a name to '' or the capture); null where there is no match, unless that is sure."""
        pattern, names = self.java()
        body = pattern.removeprefix("(?d)")
        marks = CUT.join(f"${i + 1}" for i in range(len(names)))
        groups = F.split(F.regexp_replace(text, rf"(?d)(?s:\A.*?)(?:{body})(?s:.*\z)", marks), CUT, -1)
        bound = bind(groups, lambda g: build(lambda name: F.get(g, F.lit(names.index(name)))))
        return bound if sure else F.when(self.matches(text), bound)


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def first_of(text: Column, formats: list[tuple[Format, Callable]]) -> Column:
    """The result of the first format that matches, whatever it makes of the text."""
    out = None
    for form, build in formats:
        out = (F.when if out is None else out.when)(form.matches(text), form.captures(text, build, sure=True))
    return out


# Values


# Each reads its argument once: nested conditions would run an expensive extract again and again.


def text_of(c: Column) -> Column:
    return bind(c, lambda x: F.when(x != "", x))


def unless_zero(c: Column) -> Column:
    return bind(c, lambda x: F.when(x != 0, x))


def whole(c: Column) -> Column:
    """A plain integer without blanks; anything else is null."""
    return F.regexp_extract(c, r"\A([+-]?[0-9]{1,18})\z", 1).try_cast("bigint")


def count_of(c: Column) -> Column:
    """An integer field that is left out where it is 0."""
    return F.regexp_extract(c, r"\A([+-]?0*[1-9][0-9]{0,17})\z", 1).try_cast("bigint")


def number(c: Column) -> Column:
    return F.regexp_extract(c, r"\A([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))\z", 1).try_cast("double")


def groups_of(text: Column, pattern: str, build: Callable[[Callable[[int], Column]], Column]) -> Column:
    """What `build` makes of the groups (a function from a number to the group or null) of the first match, found once."""
    java = to_java(pattern)[0]
    body = java.removeprefix("(?d)")
    n = re.compile(re.sub(r"\(\?>", "(?:", body).replace(r"\z", r"\Z")).groups
    marks = CUT.join(f"${i + 1}" for i in range(n + 1))  # group 1 is the whole match
    found = F.when(text.rlike(java) & ~text.contains(CUT), F.split(F.regexp_replace(text, rf"(?d)(?s:\A.*?)({body})(?s:.*\z)", marks), CUT, -1))
    return bind(found, lambda g: build(lambda i: F.nullif(F.get(g, F.lit(i)), F.lit(""))))


def signed(value: Column, side: Column) -> Column:
    return F.when(side.isin("S", "W"), -value).otherwise(value)


def decimal(digits: Column, side: Column) -> Column:
    """A decimal coordinate; 0 where it can't be read."""
    return F.coalesce(signed(number(digits), side), F.lit(0.0))


def degrees(digits: Column, side: Column, longitude: bool) -> Column:
    """A coordinate in degrees with minutes or seconds by its length, or with decimal minutes; 0 where it can't be read."""
    n = 3 if longitude else 2
    part = lambda a, size: F.substring(digits, a, size).try_cast("double")
    dotted = part(1, n) + F.substring(digits, n + 1, 20).try_cast("double") / 60
    tenths = part(1, n) + F.substring(digits, n + 1, 3).try_cast("double") / 10 / 60
    seconds = part(1, n) + part(n + 1, 2) / 60 + part(n + 3, 2) / 3600
    plain = F.when(F.abs(number(digits)) <= 180, number(digits))
    size = F.length(digits)
    value = F.when(digits.contains("."), dotted).when(size == n + 3, tenths).when(size == n + 4, seconds).otherwise(plain)
    return F.coalesce(signed(value, side), F.lit(0.0))


def onward(text: Column, start: Column | int) -> Column:
    """A text from a place (from 1) to its end."""
    return F.substr(text, F.lit(start) if isinstance(start, int) else start)


def onward_items(items: Column, start: int) -> Column:
    """An array from a place (from 1) to its end."""
    return bind(items, lambda x: F.slice(x, F.lit(start), F.greatest(F.size(x), F.lit(0))))


# Decoders


@dataclass(frozen=True)
class Decoder:
    """`quick` rejects cheaply before any pattern runs; `build` makes the struct."""

    name: str
    kind: str
    labels: tuple[str, ...]
    priority: int
    quick: Callable[[Column], Column]
    build: Callable[[Column], Column]
    standard: bool = True
    upper: bool = True
    by_label: bool = False  # whether `build` takes the label as well
    formats: tuple[Format, ...] = ()  # for the explanation of a decode

    def column(self, text: Column, label: Column) -> Column:
        raw = F.trim(text, F.lit(" \t\r\n"))
        there = F.coalesce(text != "", F.lit(False)) & self.quick(text)  # without labels, a decoder looks at every message
        return F.when(label.isin(*self.labels) & there if self.labels else there, self.build(*((F.upper(raw) if self.upper else raw,) + ((label,) if self.by_label else ()))))


_built: dict[tuple, Column] = {}


def expression(decoder: Decoder, text_col: str, label_col: str) -> Column:
    """A decoder's column over named columns; building one takes seconds where formats are many, so it is kept while the session's JVM lives."""
    key = (id(SparkContext._gateway), decoder.name, text_col, label_col)
    if key not in _built:
        _built[key] = decoder.column(F.col(text_col), F.col(label_col))
    return _built[key]


def decode(messages: DataFrame, decoder: Decoder, keep: tuple[str, ...] = ("delivery_id",), text_col: str = "raw_text", label_col: str = "label") -> DataFrame:
    """The typed records of one decoder; the label filter reaches the scan."""
    rows = messages.where(F.col(label_col).isin(*decoder.labels)) if decoder.labels else messages
    # A generated column keeps the optimizer from decoding once to filter and again to project.
    return rows.select(*keep, F.explode_outer(F.array(expression(decoder, text_col, label_col))).alias("r")).where("r IS NOT NULL").select(*keep, "r.*")


def records(decoders: list[Decoder], text_col: str, label_col: str, places: Mapping[str, int]) -> Column:
    """The records that the decoders make of a message, in order of priority and name, each with its decoder's place."""

    def tagged(d: Decoder) -> Column:
        return bind(expression(d, text_col, label_col), lambda r: F.when(r.isNotNull(), F.struct(F.lit(places[d.name]).alias("ord"), F.lit(d.name).alias("parser"), F.lit(d.kind).alias("result_type"), F.to_json(r).alias("result"))))

    return F.array_compact(F.array(*[tagged(d) for d in sorted(decoders, key=lambda x: places[x.name])]))


def dispatch(messages: DataFrame, decoders: list[Decoder], keep: tuple[str, ...] = ("delivery_id",), first: bool = False, text_col: str = "raw_text", label_col: str = "label", places: Mapping[str, int] | None = None) -> DataFrame:
    """Every record that any decoder makes of a message, in order of priority and name, in one pass over the log."""
    ordered = sorted(decoders, key=lambda x: (x.priority, x.name))
    some = records(decoders, text_col, label_col, places or {d.name: i for i, d in enumerate(ordered)})
    # The outer form keeps the optimizer from copying the whole array into a filter on its size.
    rows = messages.select(*keep, F.explode_outer(F.slice(some, 1, 1) if first else some).alias("r"))
    return rows.where("r IS NOT NULL").select(*keep, "r.*")


def explain(messages: DataFrame, decoders: list[Decoder], keep: tuple[str, ...] = ("delivery_id",), text_col: str = "raw_text", label_col: str = "label") -> DataFrame:
    """Why a message was decoded or not: for each decoder of its label the quick check, and for each declared format whether it matches and its captures."""
    text = F.col(text_col)
    raw = F.trim(text, F.lit(" \t\r\n"))

    def format_trace(form: Format, t: Column) -> Column:
        names = form.java()[1]
        captured = form.captures(t, lambda g: F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[g(n) for n in names])) if names else F.expr("CAST(map() AS MAP<STRING, STRING>)"))
        return F.struct(F.lit(form.name).alias("format"), form.matches(t).alias("matched"), F.lit(form.java()[0]).alias("pattern"), captured.alias("captures"))

    traces = []
    for d in sorted(decoders, key=lambda x: (x.priority, x.name)):
        t = F.upper(raw) if d.upper else raw
        formats = F.array(*[format_trace(f, t) for f in d.formats]) if d.formats else F.expr("CAST(array() AS ARRAY<STRUCT<format: STRING, matched: BOOLEAN, pattern: STRING, captures: MAP<STRING, STRING>>>)")
        trace = F.struct(F.lit(d.name).alias("parser"), F.coalesce(d.quick(text), F.lit(False)).alias("quick_check"), formats.alias("formats"))
        traces.append(F.when(F.col(label_col).isin(*d.labels), trace) if d.labels else trace)
    return messages.select(*keep, F.explode_outer(F.array_compact(F.array(*traces))).alias("t")).where("t IS NOT NULL").select(*keep, "t.*")
