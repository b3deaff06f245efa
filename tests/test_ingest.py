"""Both message shapes, ids of any kind, the log by month, explanations and differences of two runs."""

import json
from datetime import datetime

from aerolith.decoders import registry
from aerolith.decoders.engine import explain
from aerolith.sources import ingest


def _lines(spark, records):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in records], "line string")


def test_flat_and_wrapped(spark):
    flat = [{"id": 5, "text": "a", "tail": "N1"}, {"id": "6", "label": "H1"}, {"id": ""}, {"id": "x7"}, {}, "{broken", "", {"id": " 8"}]
    assert [(r.id, r.text, r.tail) for r in ingest.flat_messages(_lines(spark, flat)).collect()] == [(5, "a", "N1"), (6, None, None), (0, None, None), (0, None, None), (0, None, None), (0, None, None)]
    wrapped = [{"message": {"id": "9", "text": "t", "tail": ""}, "airframe": {"tail": "N9"}, "source": {"name": "s"}}, {"airframe": {"tail": "N1"}}, {"message": None}, "nonsense"]
    assert [(r.id, r.text, r.tail, r.source) for r in ingest.wrapped_messages(_lines(spark, wrapped)).collect()] == [(9, "t", "N9", "s")]


def test_log_by_month(spark, tmp_path):
    rows = [(i, i, datetime(2025, 6 + i % 2, 1), "a", "H1", "t") for i in range(10)]
    log = spark.createDataFrame(rows, "delivery_id long, id long, timestamp timestamp_ntz, parser_type string, label string, raw_text string")
    path = str(tmp_path / "log")
    ingest.write_log(log.limit(0), path)
    ingest.write_log(log, path)
    ingest.write_log(log, path)
    assert ingest.read_log(spark, path).count() == 20 and ingest.read_log(spark, path, "202507").count() == 10 and ingest.read_log(spark, path, "202506", "202506").count() == 10


def test_explanation(spark):
    rows = spark.createDataFrame([(1, "SQ", "02XAORDKORD04158N08754WV136975"), (2, "SQ", "00XS"), (3, "99", "x")], "delivery_id long, label string, raw_text string")
    found = {r.delivery_id: r for r in explain(rows, [d for d in registry() if d.name == "sq"]).collect()}
    assert set(found) == {1, 2} and found[1].quick_check and not found[2].quick_check
    assert [f.matched for f in found[1].formats] == [True, False] and found[1].formats[0].captures["icao"] == "KORD" and found[1].formats[1].captures is None


def test_differences(spark):
    shape = "delivery_id long, result_type string, result string"
    old = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", "x")], shape)
    new = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (4, "a", "x")], shape)
    assert {r.delivery_id: r.change for r in ingest.reparse_diff(old, new).collect()} == {1: "same", 2: "changed", 3: "regression", 4: "improvement"}
