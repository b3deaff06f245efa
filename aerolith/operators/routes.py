"""Routes from their legs, and their exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def airports(legs: Column) -> Column:
    """The airports of legs (sequence, origin, destination): the first origin, then each destination."""
    ordered = F.sort_array(legs)
    return F.concat(F.array(F.element_at(ordered, 1)["origin"]), F.transform(ordered, lambda leg: leg["destination"]))


def sequences(legs: DataFrame, key: str) -> DataFrame:
    """(key, airports) for each route of at least one leg."""
    return legs.groupBy(key).agg(airports(F.collect_list(F.struct("sequence", "origin", "destination"))).alias("airports"))


def csv_lines(routes: DataFrame, pattern: str = "pattern") -> DataFrame:
    """Lines of uneven width: the pattern and its airports."""
    return routes.where(F.size("airports") >= 2).select(F.concat_ws(",", F.col(pattern), "airports").alias("value"))


def buckets(column: Column, bounds: list[tuple[int, str]], rest: str) -> Column:
    out = None
    for upto, name in bounds:
        out = (F.when if out is None else out.when)(column <= upto, F.lit(name))
    return out.otherwise(F.lit(rest))


def kml(places: DataFrame, name: str = "name") -> DataFrame:
    """One placemark a place, with six decimals."""
    escaped = F.replace(F.replace(F.replace(F.col(name), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return places.select(F.concat(F.lit("<Placemark><name>"), escaped, F.lit("</name><Point><coordinates>"), F.format_string("%.6f,%.6f,0", "longitude", "latitude"), F.lit("</coordinates></Point></Placemark>")).alias("value"))
