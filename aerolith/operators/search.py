"""Searching the message log: conjunctive filters, point lookups, pages, annotations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The columns a page may be ordered by, and those that may be listed.
ORDERS = ("timestamp", "parser_type", "confidence", "label", "flight")
LISTED = ("label", "parser_type", "flight", "tail", "origin", "destination", "source")


@dataclass
class Search:
    id: int | None = None
    parser_type: str | None = None
    label: str | None = None
    flight: str | None = None
    text: str | None = None
    missing: str | None = None
    has_missing: bool = False
    order: str = "id"
    descending: bool = False
    limit: int = 100
    offset: int = 0


def _contains(column: str, part: str) -> Column:
    """LIKE %part%; wildcards in the part keep their meaning, as users rely on them."""
    return F.col(column).contains(part) if not set("%_\\") & set(part) else F.col(column).like(f"%{part}%")


def matching(messages: DataFrame, search: Search) -> DataFrame:
    """The rows that meet all given conditions; equalities reach the scan as pushed filters."""
    out = messages
    for column, value in (("id", search.id), ("parser_type", search.parser_type), ("label", search.label)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if search.flight:
        out = out.where(_contains("flight", search.flight))
    if search.text:
        out = out.where(_contains("raw_text", search.text))
    if search.missing:
        out = out.where(_contains("missing_fields", search.missing))
    if search.has_missing:
        out = out.where("missing_fields <> ''")
    return out


def page(messages: DataFrame, search: Search, ties: tuple[str, ...] = ("id", "delivery_id")) -> DataFrame:
    """One page of the matching rows; an unknown order is by id, a limit of 0 or less is 100."""
    order = search.order if search.order in ORDERS else "id"
    key = F.col(order).desc() if search.descending else F.col(order).asc()
    return matching(messages, search).orderBy(key, *[t for t in ties if t != order]).offset(search.offset).limit(search.limit if search.limit > 0 else 100)


def distinct_values(messages: DataFrame, column: str) -> DataFrame:
    if column not in LISTED:
        raise ValueError(f"{column} can't be listed")
    return messages.where(F.col(column) != "").select(F.col(column).alias("value")).distinct()


def with_term(messages: DataFrame, term: str, text_col: str = "raw_text") -> DataFrame:
    """Rows whose text has the term as a whole word; `contains` rejects most before texts are split."""
    lowered = F.lower(text_col)
    return messages.where(lowered.contains(term.lower()) & F.array_contains(F.split(lowered, "[^a-z0-9_]+"), term.lower()))


def valid_json(column: str) -> Column:
    return F.try_parse_json(column).isNotNull()


def annotated_page(page_rows: DataFrame, annotations: DataFrame, golden_only: bool = False) -> DataFrame:
    """A page with its annotations; the golden filter follows the paging, so such pages can be short."""
    joined = page_rows.join(annotations.withColumnRenamed("message_id", "id"), "id", "left").withColumn("is_golden", F.coalesce("is_golden", F.lit(False)))
    return joined.where("is_golden") if golden_only else joined


def golden_export(messages: DataFrame, annotations: DataFrame) -> DataFrame:
    """Golden annotations with their messages; the expected record, where there is one, stands for the parsed one."""
    golden = annotations.where("is_golden").select(F.col("message_id").alias("id"), "expected_json", "annotation")
    return messages.join(golden, "id").withColumn("expected", F.coalesce(F.nullif("expected_json", F.lit("")), "parsed_json"))
