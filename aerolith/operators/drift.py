"""Problem 4: one table from files whose fields drift, and a report of each change.

While scanning, each field of each file gets a profile of fixed size that merges by
sums and minima: how often it was seen with each type, a histogram of its values'
kinds (shapes of strings, magnitudes of numbers, keys of objects) in HIST bins, and
a MinHash of its values in MINS registers. Profiles are merged in the JVM, then each
file is set against the one before it in its feed. Fields of one file only are
matched: candidates are pairs under the same parent with the same type whose
profiles and names agree, and a maximum-weight bipartite matching picks the renames;
the rest was added or removed.

Defined results: a field is present if one valid line has it non-null. Its type in a
file is the most frequent one (of equals, the first by name). Null, empty and broken
payloads, and records without the profiled part, count for no field; a file in which
no line is valid is passed over. Null feed_id and file_seq count as '' and -1.
Repeated rows change counts only. Empty tables give no changes. Of a key given twice
the last value counts. Only the named columns are read.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolith.operators.shred import parse

HIST, MINS = 32, 16
_digit, _letter = re.compile(r"\d"), re.compile(r"[^\W\d_]")
TYPES = ("array", "boolean", "number", "object", "string")
FAR = (1 << 62) - 1
PARTS = {"wrapper": "airframe", "log": "parsed_json"}


def type_of(value) -> str:
    if isinstance(value, bool):
        return "boolean"
    return {str: "string", int: "number", float: "number", dict: "object", list: "array"}[type(value)]


def places(record, part: str) -> Iterator[tuple[str, str, object]]:
    """(path, place, value) of the non-null fields of one part of a record, with those of objects inside arrays, whose place is that in each array: `[0]`."""
    inner = record.get(part) if isinstance(record, dict) else None
    if isinstance(inner, str):
        inner = parse(inner)
    if not isinstance(inner, dict):
        return
    todo = [(f"{part}.{k}", "", v) for k, v in inner.items()]
    while todo:
        path, place, value = todo.pop()
        if value is None:
            continue
        yield path, place, value
        if isinstance(value, list):
            for i, item in enumerate(value):
                if isinstance(item, dict):
                    todo += [(f"{path}.{k}", f"{place}[{i}]", v) for k, v in item.items()]


def fields(record, part: str) -> Iterator[tuple[str, object]]:
    return ((path, value) for path, _, value in places(record, part))


def kind_of(value) -> str:
    """What values of one field have in common: the shape of a string, the magnitude of a number, the keys of an object."""
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, str):
        return _letter.sub("A", _digit.sub("9", value))
    if isinstance(value, dict):
        return "{" + ",".join(sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + (kind_of(value[0]) if value else "") + "]"
    size = "-" if value < 0 else "+"
    whole = "i" if float(value).is_integer() else "f"
    return f"{size}{whole}{math.floor(math.log2(abs(value) + 1)) if math.isfinite(float(value)) else 'x'}"


def _hashes(texts: list[str]) -> np.ndarray:
    """MINS hash values of each text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    low = np.array([zlib.crc32(t) for t in raw], np.uint64)[:, None]
    high = np.array([zlib.adler32(t[::-1]) | 1 for t in raw], np.uint64)[:, None]
    with np.errstate(over="ignore"):
        x = low * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, MINS + 1, dtype=np.uint64) * high * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ x >> np.uint64(32)) & np.uint64(FAR)).astype(np.int64)


def profiles(records: DataFrame, parts: dict[str, str] = PARTS) -> DataFrame:
    """One row a feed, file and field, and one with path '' a file with valid lines."""
    keys = ["feed_id", "file_seq", "file_name", "path"]
    counters = [f"t{i}" for i in range(len(TYPES))] + [f"h{i}" for i in range(HIST)]
    mins = [f"m{i}" for i in range(MINS)]
    schema = "feed_id string, file_seq bigint, file_name string, path string, " + ", ".join(f"{c} bigint" for c in counters + mins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(TYPES) + HIST
        for batch in batches:
            groups: dict[tuple, int] = {}
            known: dict[tuple[str, object], tuple[int, int, int]] = {}  # a value's type, bin and number
            texts: dict[str, int] = {}
            group, kind, value = [], [], []
            for feed, seq, name, record_kind, text in zip(*(c.to_pylist() for c in batch.columns)):
                record = parse(text)
                if record is None:
                    continue
                groups.setdefault((feed, seq, name, ""), len(groups))
                for path, v in fields(record, parts.get(record_kind, "")):
                    what = type_of(v)
                    plain = v if what == "string" else json.dumps(v)
                    found = known.get((what, plain))
                    if found is None:
                        found = known[what, plain] = (TYPES.index(what), len(TYPES) + zlib.crc32(kind_of(v).encode("utf-8", "surrogatepass")) % HIST, texts.setdefault(plain, len(texts)))
                    g = groups.setdefault((feed, seq, name, path), len(groups))
                    group += (g, g)
                    kind += found[:2]
                    value.append(found[2])
            n = len(groups)
            counts = np.bincount(np.array(group, np.int64) * width + np.array(kind, np.int64), minlength=n * width).reshape(n, width)
            least = np.full((n, MINS), FAR, np.int64)
            if value:
                pairs = np.unique(np.array(group[::2], np.int64) * len(texts) + np.array(value, np.int64))
                at = pairs // len(texts)
                starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                least[at[starts]] = np.minimum.reduceat(_hashes(list(texts))[pairs % len(texts)], starts, axis=0)
            named = list(zip(*groups)) or [()] * 4
            types = [pa.string(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array(c, t) for c, t in zip(named, types)] + [pa.array(counts[:, i]) for i in range(width)] + [pa.array(least[:, i]) for i in range(MINS)]
            yield pa.RecordBatch.from_arrays(columns, [*keys, *counters, *mins])

    narrow = records.select(
        F.coalesce("feed_id", F.lit("")).alias("feed_id"), F.coalesce(F.col("file_seq").cast("bigint"), F.lit(-1)).alias("file_seq"), F.coalesce("file_name", F.lit("")).alias("file_name"), "record_kind", F.col("payload").cast("string").alias("payload")
    )
    merged = narrow.mapInArrow(run, schema).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters], *[F.min(c).alias(c) for c in mins])
    major = F.array_max(F.array(*[F.struct(F.col(f"t{i}").alias("n"), F.lit(-i).alias("i"), F.lit(t).alias("type")) for i, t in enumerate(TYPES)]))["type"]
    return merged.select(*keys, major.alias("type"), F.array(*[f"h{i}" for i in range(HIST)]).alias("kinds"), F.array(*mins).alias("mins"))


def _words(name: str) -> list[str]:
    return re.findall(r"[a-z]+|\d+", re.sub(r"([a-z])([A-Z])", r"\1_\2", name).lower())


def name_similarity(a: str, b: str) -> float:
    """0 to 1: alike spelling, one an abbreviation or the initials of the other, or a shared word."""
    x, y = _words(a), _words(b)
    if not x or not y:
        return float(a == b)
    best = SequenceMatcher(None, "".join(x), "".join(y)).ratio()
    for p, q in ((x, y), (y, x)):
        initials = "".join(w[0] for w in q)
        if len(initials) > 1 and p[0] == initials:
            best = max(best, 0.8)
        if any(len(w) > 1 and v.startswith(w) for w in p for v in q if w != v):
            best = max(best, 0.7)
    if set(x) & set(y):
        best = max(best, 0.6)
    return best


def similarity(old: dict, new: dict) -> float:
    """0 if the two fields can't be one, else the weight of taking them for one."""
    if old["type"] != new["type"] or old["path"].rpartition(".")[0] != new["path"].rpartition(".")[0]:
        return 0.0
    a, b = sum(old["kinds"]) or 1, sum(new["kinds"]) or 1
    kinds = sum(min(x / a, y / b) for x, y in zip(old["kinds"], new["kinds"]))
    values = sum(x == y and x != FAR for x, y in zip(old["mins"], new["mins"])) / MINS
    names = name_similarity(old["path"].rpartition(".")[2], new["path"].rpartition(".")[2])
    if old["type"] in ("string", "array", "object"):
        like = kinds >= 0.6 or values >= 0.25
    else:  # small numbers and booleans look alike anywhere
        like = kinds >= 0.4 and names >= 0.3
    return 0.5 * max(kinds, values) + 0.2 * values + 0.5 * names if like else 0.0


def matching(weights: dict[tuple[int, int], float]) -> list[tuple[int, int]]:
    """A maximum-weight matching of a sparse bipartite graph, component by component."""
    left: dict[int, list[int]] = {}
    right: dict[int, list[int]] = {}
    for i, j in weights:
        left.setdefault(i, []).append(j)
        right.setdefault(j, []).append(i)
    out, done = [], set()
    for start in left:
        if start in done:
            continue
        rows, cols, todo = [], set(), [start]
        done.add(start)
        while todo:
            i = todo.pop()
            rows.append(i)
            for j in left[i]:
                cols.add(j)
                for k in right[j]:
                    if k not in done:
                        done.add(k)
                        todo.append(k)
        names = sorted(cols)
        cost = [[-weights.get((i, j), 0.0) for j in names] + [0.0] * len(rows) for i in rows]
        for row, col in enumerate(_assign(cost)):
            if col < len(names) and weights.get((rows[row], names[col]), 0.0) > 0:
                out.append((rows[row], names[col]))
    return out


def _assign(cost: list[list[float]]) -> list[int]:
    """The column of each row in a cheapest assignment (shortest augmenting paths); there are at least as many columns as rows."""
    n, m = len(cost), len(cost[0])
    u, v, owner = [0.0] * (n + 1), [0.0] * (m + 1), [-1] * (m + 1)
    for i in range(n):
        owner[m], at = i, m
        least, came, used = [math.inf] * m, [m] * m, [False] * (m + 1)
        while owner[at] != -1:
            used[at] = True
            row, step, nxt = owner[at], math.inf, -1
            for j in range(m):
                if not used[j]:
                    if (slack := cost[row][j] - u[row] - v[j]) < least[j]:
                        least[j], came[j] = slack, at
                    if least[j] < step:
                        step, nxt = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[owner[j]] += step
                    v[j] -= step
                elif j < m:
                    least[j] -= step
            at = nxt
        while at != m:
            owner[at] = owner[came[at]]
            at = came[at]
    out = [0] * n
    for j in range(m):
        if owner[j] != -1:
            out[owner[j]] = j
    return out


CHANGES = "feed_id string, file_seq bigint, file_name string, change_kind string, old_path string, new_path string"


def changes(profiled: DataFrame) -> DataFrame:
    """feed_id, file_seq, file_name, change_kind, old_path, new_path of each change of a field, at the file it begins in.

    Every profile goes to its own file and, as what was before, to the next one, so that profiles are read once.
    """
    order = Window.partitionBy("feed_id").orderBy("file_seq")  # over profiles, not rows
    placed = profiled.withColumn("place", F.dense_rank().over(order))
    sides = F.explode(F.array(F.struct(F.col("place").alias("at"), F.lit(True).alias("is_new")), F.struct((F.col("place") + 1).alias("at"), F.lit(False).alias("is_new"))))
    both = placed.select("feed_id", "file_seq", "file_name", "path", "type", "kinds", "mins", sides.alias("side")).select("*", "side.*").drop("side")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        names = ["feed_id", "file_seq", "file_name", "change_kind", "old_path", "new_path"]
        side = {}
        for is_new, rows in pdf.sort_values("file_name").groupby("is_new"):
            side[bool(is_new)] = {p: {"path": p, "type": t, "kinds": k, "mins": m} for p, t, k, m in zip(rows["path"], rows["type"], rows["kinds"], rows["mins"])}  # of several names, the last one's
        if len(side) < 2 or "" not in side[True] or "" not in side[False]:
            return pd.DataFrame([], columns=names)
        first = pdf[pdf["is_new"] & (pdf["path"] == "")].sort_values("file_name").iloc[0]
        old, new = side[False], side[True]
        rows = [("type_changed", p, p) for p in new if p and p in old and old[p]["type"] != new[p]["type"]]
        olds, news = [old[p] for p in sorted(old) if p not in new], [new[p] for p in sorted(new) if p not in old]
        weights = {(i, j): w for i, o in enumerate(olds) for j, n in enumerate(news) if (w := similarity(o, n)) > 0}
        pairs = matching(weights)
        gone, come = {i for i, _ in pairs}, {j for _, j in pairs}
        rows += [("renamed", olds[i]["path"], news[j]["path"]) for i, j in pairs]
        rows += [("removed", o["path"], "") for i, o in enumerate(olds) if i not in gone]
        rows += [("added", "", n["path"]) for j, n in enumerate(news) if j not in come]
        return pd.DataFrame([(first["feed_id"], first["file_seq"], first["file_name"], *r) for r in rows], columns=names)

    return both.groupBy("feed_id", "at").applyInPandas(compare, CHANGES)


def canonical(changed: DataFrame) -> DataFrame:
    """(feed_id, from_seq, to_seq, path, name): the first name of each renamed field, for the files in which it has another one."""

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, now = [], {}  # now: path -> (first name, since)
        for r in pdf.sort_values("file_seq").itertuples():
            if r.change_kind == "renamed":
                first, since = now.pop(r.old_path, (r.old_path, None))
                if since is not None:
                    rows.append((r.feed_id, since, int(r.file_seq), r.old_path, first))
                now[r.new_path] = (first, int(r.file_seq))
            elif r.change_kind == "removed" and r.old_path in now:
                first, since = now.pop(r.old_path)
                rows.append((r.feed_id, since, int(r.file_seq), r.old_path, first))
        rows += [(pdf["feed_id"].iloc[0], since, None, path, first) for path, (first, since) in now.items()]
        rows = [r for r in rows if r[3] != r[4]]
        return pd.DataFrame(rows, columns=["feed_id", "from_seq", "to_seq", "path", "name"]).astype({"from_seq": "Int64", "to_seq": "Int64"})

    return changed.where("change_kind IN ('renamed', 'removed')").groupBy("feed_id").applyInPandas(chain, "feed_id string, from_seq bigint, to_seq bigint, path string, name string")


def unified(records: DataFrame, id_col: str = "record_id", parts: dict[str, str] = PARTS) -> DataFrame:
    """One row a record and field under the field's first name: (id, feed_id, file_seq, name, place, path, type, common_type, value).

    Fields of objects inside arrays have rows of their own, with their place; the array's row has no value then.
    common_type is the type if the field has only one in all files of its feed, else string; value is the value as text
    of that type. A record without any field has one row with null name.
    """
    profiled = profiles(records, parts)
    renames = canonical(changes(profiled)).select("feed_id", "path", "from_seq", "to_seq", "name")

    def named(rows: DataFrame) -> DataFrame:
        seq = F.col("file_seq")
        on = (rows.feed_id == renames.feed_id) & (rows.path == renames.path) & (seq >= renames.from_seq) & (renames.to_seq.isNull() | (seq < renames.to_seq))
        return rows.join(renames, on, "left").select(*[rows[c] for c in rows.columns], F.coalesce(renames.name, rows.path).alias("name"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for rid, feed, seq, kind, text in zip(*(c.to_pylist() for c in batch.columns)):
                before = len(rows)
                for path, place, value in places(parse(text), parts.get(kind, "")):
                    split = isinstance(value, list) and any(isinstance(x, dict) for x in value)
                    rows.append((rid, feed, seq, path, place, type_of(value), None if split else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)))
                if len(rows) == before:
                    rows.append((rid, feed, seq, None, None, None, None))
            columns = list(zip(*rows)) or [()] * 7
            types = [pa.int64(), pa.string(), pa.int64(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["record_id", "feed_id", "file_seq", "path", "place", "type", "value"])

    narrow = records.select(F.col(id_col).cast("bigint"), F.coalesce("feed_id", F.lit("")), F.coalesce(F.col("file_seq").cast("bigint"), F.lit(-1)), "record_kind", F.col("payload").cast("string"))
    long = narrow.mapInArrow(run, "record_id bigint, feed_id string, file_seq bigint, path string, place string, type string, value string")
    types = named(profiled.where("path <> ''").select("feed_id", "file_seq", "path", "type")).groupBy("feed_id", "name").agg(F.when(F.count_distinct("type") == 1, F.first("type")).otherwise(F.lit("string")).alias("common_type"))
    return named(long).join(types, ["feed_id", "name"], "left").select("record_id", "feed_id", "file_seq", "name", "place", "path", "type", "common_type", "value")
