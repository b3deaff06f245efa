"""A stream leaves the state that a batch leaves, and a batch run twice counts once."""

from pyspark.sql import functions as F

from aerolith.operators import folds
from aerolith.sources.tables import table
from aerolith.streaming import live


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_fold_in_pieces_equals_one_fold(spark, data, tmp_path):
    updates = table(spark, data, "flight_updates")
    columns = {"texts": ["origin", "destination"], "numbers": ["altitude"], "seen": "update_id"}
    sink = live.folding(str(tmp_path / "state"), ["icao_hex"], ["update_id"], **columns)
    # Arrival order is by update_id within each piece and between pieces, as the log is.
    pieces = [updates.where(f"update_id >= {a} AND update_id < {b}") for a, b in ((0, 200), (200, 400), (400, 10**9))]
    for i, piece in enumerate(pieces):
        sink(piece, i)
    expected = folds.fold(updates, ["icao_hex"], ["update_id"], **columns)
    found = live.state(spark, str(tmp_path / "state")).select(*expected.columns)
    assert _rows(found) == _rows(expected)
    sink(pieces[2], 2)  # run again after a failure
    assert _rows(live.state(spark, str(tmp_path / "state")).select(*expected.columns)) == _rows(expected)


def test_checksum_column(spark):
    import binascii

    from aerolith.functions.crc import crc16, text_bytes

    rows = spark.createDataFrame([("123456789",), ("FPN/X",), ("A",)], "t string").select("t", crc16(text_bytes(F.col("t"))).alias("c")).collect()
    assert all(r.c == binascii.crc_hqx(r.t.encode(), 0xFFFF) for r in rows)
