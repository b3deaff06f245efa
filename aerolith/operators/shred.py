"""Problem 2: nested records into related flat tables, by Dewey labels.

Every JSON object of a record becomes a node. Its Dewey label is the list of
ordinals that lead to it from the record's root: the place of the key in its
object, then, inside an array, the place of the element. The label of the parent
object is the label cut to `parent_len` ordinals, so parent and child tables join
on (owner, owner_id, label) without any generated key. Nodes with the same schema
path (their keys without places) form one table.

Whether an object stands where other records have an array can only be told from
all records: a first pass gathers the distinct schema paths, deduplicated within
each batch before they are shuffled, and marks the paths seen as arrays. As long
as there are no more than MAX_PATHS of them they are broadcast, beyond that they
are joined.

Defined results: null, empty, blank and invalid texts (NaN and Infinity, as well
as nesting beyond the parser's recursion limit, are invalid) have no nodes; a text
that encodes an object or array counts as what it encodes, at the root as well; of
a key given twice the last value counts; elements of arrays inside arrays carry
both places; a root array's elements have paths that start with their place. Rows
with equal ids give equal nodes; null ids stay null. Only the named columns are
read. Empty tables give no nodes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.sources.tables import spread

MAX_PATHS = 100_000
GLUE = "\x01"  # between the keys of a schema path, as keys may hold dots


def _refuse(constant: str) -> None:
    raise ValueError(constant)


_decoder = json.JSONDecoder(parse_constant=_refuse)


def parse(text: str | None):
    """The value of a JSON text, through any number of encodings; None if there is none."""
    if not text or text.isspace():
        return None
    try:
        value = _decoder.decode(text)
    except (ValueError, RecursionError):
        return None
    return unwrap(value)


def unwrap(value):
    """What a text encodes if it encodes an object or array, else the value itself."""
    while isinstance(value, str) and value.lstrip()[:1] in ("{", "["):
        try:
            value = _decoder.decode(value)
        except (ValueError, RecursionError):
            break
    return value


def walk(root) -> Iterator[tuple]:
    """(kind, keys, places, label, parent_len, value) of each object and array, parents first.

    places has, for each key, '' or the places inside its array as '[i]'.
    """
    todo = [(root, (), (), (), 0)]
    while todo:
        value, keys, places, label, parent_len = todo.pop()
        if isinstance(value, dict):
            yield "object", keys, places, label, parent_len, value
            children = []
            for i, (key, child) in enumerate(value.items()):
                child = unwrap(child)
                if isinstance(child, (dict, list)):
                    children.append((child, (*keys, key), (*places, ""), (*label, i), len(label)))
            todo += reversed(children)
        elif isinstance(value, list):
            yield "array", keys, places, label, parent_len, value
            children = []
            for i, child in enumerate(value):
                child = unwrap(child)
                if isinstance(child, (dict, list)):
                    if keys:
                        at = (keys, (*places[:-1], f"{places[-1]}[{i}]"))
                    else:  # the root is an array
                        at = (("",), (f"[{i}]",))
                    children.append((child, *at, (*label, i), parent_len))
            todo += reversed(children)


def schema_paths(records: DataFrame, text_col: str, owner_col: str) -> DataFrame:
    """(owner, schema_path, is_array): each path of objects and arrays in the records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, str], bool] = {}
            for owner, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for kind, keys, *_ in walk(parse(text)):
                    if keys:
                        at = (owner, GLUE.join(keys))
                        if kind == "array" or at not in seen:
                            seen[at] = seen.get(at, False) or kind == "array"
            yield pa.RecordBatch.from_arrays(
                [pa.array([o for o, _ in seen], pa.string()), pa.array([p for _, p in seen], pa.string()), pa.array(list(seen.values()), pa.bool_())], ["owner", "schema_path", "is_array"]
            )

    narrow = records.select(F.col(owner_col), F.col(text_col))
    return narrow.mapInArrow(run, "owner string, schema_path string, is_array boolean").groupBy("owner", "schema_path").agg(F.max("is_array").alias("is_array"))


def _prefixes(paths: DataFrame) -> DataFrame:
    """(owner, schema_path, array_at): for each key of a path, whether the path so far is an array somewhere."""
    spark = paths.sparkSession
    rows = paths.limit(MAX_PATHS + 1).collect()
    if len(rows) <= MAX_PATHS:
        arrays = {(r.owner, r.schema_path) for r in rows if r.is_array}
        out = []
        for r in rows:
            keys = r.schema_path.split(GLUE)
            out.append((r.owner, r.schema_path, [(r.owner, GLUE.join(keys[: i + 1])) in arrays for i in range(len(keys))]))
        return F.broadcast(spark.createDataFrame(out, "owner string, schema_path string, array_at array<boolean>"))  # at most MAX_PATHS rows
    steps = paths.select("owner", "schema_path", F.posexplode(F.split("schema_path", GLUE)).alias("i", "key")).withColumn(
        "prefix", F.array_join(F.slice(F.split("schema_path", GLUE), F.lit(1), F.col("i") + 1), GLUE)
    )
    arrays = paths.where("is_array").select("owner", F.col("schema_path").alias("prefix"), F.lit(True).alias("hit"))
    found = steps.join(arrays, ["owner", "prefix"], "left")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("i", F.coalesce("hit", F.lit(False)).alias("hit")))), lambda x: x["hit"])
    return found.groupBy("owner", "schema_path").agg(ordered.alias("array_at"))


def nodes(records: DataFrame, id_col: str, text_col: str, owner_col: str, attributes: bool = True) -> DataFrame:
    """One row an object: owner, owner_id, label, parent_label, schema_path, node_path, is_empty and, if asked for, attributes (its own scalars and arrays of scalars, as JSON)."""
    records = records.select(F.col(f"`{owner_col}`").cast("string").alias("owner"), F.col(f"`{id_col}`").cast("bigint").alias("owner_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    records = spread(records)
    known = _prefixes(schema_paths(records, "text", "owner"))

    def own(value: dict) -> str:
        plain = {}
        for key, child in value.items():
            child = unwrap(child)
            if isinstance(child, dict) or isinstance(child, list) and any(isinstance(x, (dict, list)) for x in child):
                continue
            plain[key] = child
        return json.dumps(plain, ensure_ascii=False)

    fields = [("owner", pa.string()), ("owner_id", pa.int64()), ("schema_path", pa.string()), ("places", pa.list_(pa.string())), ("label", pa.list_(pa.int32())), ("parent_len", pa.int32()), ("is_empty", pa.bool_()), ("attributes", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                rows = []
                part = batch.slice(start, 1000)
                for owner, owner_id, text in zip(*(c.to_pylist() for c in part.columns)):
                    for kind, keys, places, label, parent_len, value in walk(parse(text)):
                        if kind == "object":
                            rows.append((owner, owner_id, GLUE.join(keys), places, label, parent_len, not value, own(value) if attributes else None))
                columns = list(zip(*rows)) or [()] * len(fields)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])

    raw = records.mapInArrow(run, "owner string, owner_id bigint, schema_path string, places array<string>, label array<int>, parent_len int, is_empty boolean, attributes string")
    step = lambda key, i: F.concat(key, F.when((F.get("places", i) == "") & F.get("array_at", i), F.lit("[0]")).otherwise(F.get("places", i)))
    return raw.join(known, ["owner", "schema_path"], "left").select(
        "owner",
        "owner_id",
        "label",
        F.when(F.size("label") > 0, F.slice("label", F.lit(1), F.col("parent_len"))).alias("parent_label"),
        F.replace(F.col("schema_path"), F.lit(GLUE), F.lit(".")).alias("schema_path"),
        F.when(F.size("label") > 0, F.array_join(F.transform(F.split("schema_path", GLUE), step), ".")).alias("node_path"),
        "is_empty",
        *(["attributes"] if attributes else []),
    )


def table_of(all_nodes: DataFrame, schema_path: str, fields: dict[str, str]) -> DataFrame:
    """The flat table of one schema path: keys to the parent, the place, and the named fields cast to the given types."""
    return all_nodes.where((F.col("schema_path") == schema_path) & ~F.col("is_empty")).select(
        "owner",
        "owner_id",
        F.array_join(F.col("label").cast("array<string>"), ".").alias("node_label"),
        F.array_join(F.col("parent_label").cast("array<string>"), ".").alias("parent_label"),
        F.regexp_extract("node_path", r"\[(\d+)\]\z", 1).try_cast("int").alias("place"),
        *[F.get_json_object("attributes", f"$['{name}']").try_cast(kind).alias(name) for name, kind in fields.items()],
    )
