"""Upserts as folds: the state that a sequence of keyed updates leaves, in one aggregation by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(column: str, order: Column, keep_empty: bool = False) -> Column:
    """The last value that is given: nulls, and empty texts unless kept, leave the value before."""
    value = F.col(column) if keep_empty else F.nullif(F.col(column), F.lit(""))
    return F.max_by(value, F.when(value.isNotNull(), order))


def numeric_latest(column: str, order: Column) -> Column:
    return F.max_by(F.col(column), F.when(F.col(column).isNotNull(), order))


def fold(updates: DataFrame, keys: list[str], order: list[str], texts: list[str] = (), numbers: list[str] = (), whole: list[str] = (), count: str = "msg_count", seen: str | None = None) -> DataFrame:
    """The state by key: texts and numbers coalesce, `whole` columns are overwritten as they are, every update counts.

    All aggregates merge, so partial states are combined before the shuffle and one hot key doesn't pile up.
    """
    at = F.struct(*order)
    rows = updates
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    if keys and dict(rows.dtypes)[keys[0]] == "string":
        rows = rows.where(F.col(keys[0]) != "")
    out = [latest(c, at).alias(c) for c in texts] + [numeric_latest(c, at).alias(c) for c in numbers] + [F.max_by(c, at).alias(c) for c in whole] + [F.count("*").alias(count)]
    if seen:
        out += [F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen")]
    return rows.groupBy(*keys).agg(*out)


def merge(state: DataFrame, batch: DataFrame, keys: list[str], texts: list[str] = (), numbers: list[str] = (), whole: list[str] = (), count: str = "msg_count") -> DataFrame:
    """An older state with a newer one folded in: the step of a stream."""
    old = state.select(*keys, *[F.col(c).alias(f"__{c}") for c in state.columns if c not in keys])
    joined = old.join(batch, keys, "full")
    out = [F.coalesce(c, f"__{c}").alias(c) for c in (*texts, *numbers, *whole)]
    times = [f(F.col(c), F.col(f"__{c}")).alias(c) for c, f in (("first_seen", F.least), ("last_seen", F.greatest)) if c in state.columns]
    return joined.select(*keys, *out, (F.coalesce(count, F.lit(0)) + F.coalesce(f"__{count}", F.lit(0))).alias(count), *times)


def trailing_digits(column: Column) -> Column:
    return F.regexp_extract(column, r"([0-9]+)\z", 1)


def normal_flight(column: Column) -> Column:
    """A flight number without zeros before its first other digit; one zero stays where there is nothing else."""
    return F.regexp_replace(F.trim(column), r"(?s)^([^0-9]*)0+(?=.)", "$1")


def suffix_matches(stored: DataFrame, asked: DataFrame) -> DataFrame:
    """Pairs of equal aircraft and day whose stored callsign ends with the digits asked for, or is equal where there are none."""
    number = trailing_digits(F.col("asked_callsign"))
    return stored.join(asked, ["icao_hex", "flight_date"]).where(F.when(number != "", F.endswith(F.col("callsign"), number)).otherwise(F.col("callsign") == F.col("asked_callsign")))
