"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from aerolith.plans import decode, log, problems, state, streams

QUERIES: dict = {**log.QUERIES, **state.QUERIES, **decode.QUERIES, **streams.QUERIES, **problems.QUERIES}
SQL: dict[str, str] = {**log.SQL, **state.SQL, **decode.SQL, **streams.SQL, **problems.SQL}


def flagship(spark, sf_dir):
    """Latest position and frequency of each squitter's side, decoded from text: ingest, quick check, pattern, coordinates, keyed fold."""
    from pyspark.sql import functions as F

    rows = decode.QUERIES["decode_sq"](spark, sf_dir)
    order = F.struct("l_orderkey", "l_linenumber", "latitude", "longitude")
    return rows.groupBy("icao_code").agg(F.count("*").alias("reports"), F.max_by(F.struct("latitude", "longitude", "freq_mhz"), order).alias("last")).select("icao_code", "reports", "last.*")
