"""The general data problems against brute force on small tables, and their defined cases."""

import json
from datetime import datetime, timedelta

import numpy as np
import pytest

from aerolith.operators import drift, instants, once, shred, spikes, stays

T0 = datetime(2025, 6, 1)
MESSAGE = "delivery_id long, id long, timestamp timestamp_ntz, raw_text string, created_at timestamp_ntz"
UPDATE = "update_id long, message_id long, icao_hex string, registration string, latitude double, longitude double, altitude int, ground_speed int"


def messages(spark, rows):
    return spark.createDataFrame(rows, MESSAGE)


# 3


def _keep(rows):
    best = {}
    for r in rows:
        key = ("i", r[1]) if r[1] else ("t", r[2], r[3])
        rank = (r[4] is None, r[4] or T0, r[0])
        if key not in best or rank < best[key][0]:
            best[key] = (rank, r[0])
    return {r[0] for r in rows} - {d for _, d in best.values()}


def test_repeats_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(6000):
        hot = rng.random() < 0.33
        ident = 7 if hot else int(rng.integers(0, 900))
        rows.append((i, ident if rng.random() > 0.02 else None, T0 + timedelta(minutes=int(rng.integers(0, 3))), str(rng.integers(0, 5)) if rng.random() > 0.1 else None, T0 + timedelta(hours=int(rng.integers(0, 2000))) if rng.random() > 0.02 else None))
    found = [r.delivery_id for r in once.repeats(messages(spark, rows)).collect()]
    assert len(found) == len(set(found)) and set(found) == _keep(rows)


def test_repeats_of_nothing(spark):
    assert once.repeats(messages(spark, [])).count() == 0
    assert once.unique(messages(spark, [(1, 5, T0, "a", T0), (2, 5, T0, "b", T0)])).collect()[0].delivery_id == 1


def test_bloom_never_forgets():
    rng = np.random.default_rng(1)
    seen, other = (rng.integers(0, 1 << 63, 20_000).astype(np.uint64) for _ in range(2))
    bloom = once.Bloom(1000)
    bloom.add(seen)
    assert bloom.has(seen).all() and bloom.has(other).mean() < 0.02


# 2


def test_nodes(spark):
    texts = ['{"a":[{"b":1},null,{},{"c":{"d":2}}],"e":{"f":{}}}', '{"a":{"b":3},"e":"{\\"g\\":[{\\"h\\":1}]}"}', "{broken", None, "", '[{"x":1}]', '{"n": NaN}', '"{\\"a\\":[]}"', '{"k.l":[[{"m":1}]]}']
    rows = spark.createDataFrame([("o", i, t) for i, t in enumerate(texts)] + [("o", 0, texts[0])], "owner string, owner_id long, text string")
    nodes = shred.nodes(rows, "owner_id", "text", "owner")
    found = sorted((r.owner_id, r.node_path) for r in nodes.where("NOT is_empty AND parent_label IS NOT NULL").collect())
    one = [(0, "a[0]"), (0, "a[3]"), (0, "a[3].c"), (0, "e")]
    assert found == sorted(one * 2 + [(1, "a[0]"), (1, "e"), (1, "e.g[0]"), (5, "[0]"), (8, "k.l[0][0]")])
    every = {(r.owner_id, tuple(r.label)) for r in nodes.collect()}
    assert all(r.parent_label is None or (r.owner_id, tuple(r.parent_label)) in every or r.owner_id == 5 for r in nodes.collect())
    flat = shred.table_of(nodes, "a", {"b": "int"}).where("owner_id = 1").collect()
    assert [(r.b, r.parent_label) for r in flat] == [(3, "")]
    assert shred.nodes(rows.limit(0), "owner_id", "text", "owner").count() == 0


# 4


def _feed(spark, files):
    rows, n = [], 0
    for seq, lines in enumerate(files, 1):
        for line in lines:
            n += 1
            rows.append((n, "f", f"f/{seq}", seq, "log", line if isinstance(line, (str, type(None))) else json.dumps({"id": n, "parsed_json": line})))
    return spark.createDataFrame(rows, "record_id long, feed_id string, file_name string, file_seq int, record_kind string, payload string")


def test_changes(spark):
    a = [{"latitude": 10.5 + i, "name": f"ABC{i}", "on": True} for i in range(20)]
    b = [{"lat": 11.5 + i, "name": f"ABC{i}", "on": True, "extra": {"x": 1}} for i in range(20)] + ["{bad", None, ""]
    c = [{"lat": str(i), "name": f"ABD{i}", "list": [{"p": 1}]} for i in range(20)]
    feed = _feed(spark, [a, b, c])
    found = {(r.file_name, r.change_kind, r.old_path, r.new_path) for r in drift.changes(drift.profiles(feed)).collect()}
    p = "parsed_json."
    assert found == {
        ("f/2", "renamed", p + "latitude", p + "lat"), ("f/2", "added", "", p + "extra"), ("f/3", "type_changed", p + "lat", p + "lat"), ("f/3", "removed", p + "on", ""),
        ("f/3", "removed", p + "extra", ""), ("f/3", "added", "", p + "list"), ("f/3", "added", "", p + "list.p"),
    }
    names = {r.name for r in drift.unified(feed).collect()}
    assert p + "latitude" in names and p + "lat" not in names
    assert drift.changes(drift.profiles(feed.limit(0))).count() == 0


def test_matching_is_best():
    assert sorted(drift.matching({(0, 0): 0.9, (0, 1): 0.8, (1, 0): 0.8})) == [(0, 1), (1, 0)]


# 5


@pytest.mark.parametrize(
    "value, zone, at, expected",
    [
        ("2025-03-30T02:30:00", "Europe/Berlin", None, None),
        ("2025-10-26T02:30:00", "Europe/Berlin", None, "2025-10-26T00:30:00"),
        ("03/04/2025 10:00:00", "America/Chicago", None, "2025-03-04T16:00:00"),
        ("03/04/2025 10:00:00", "Europe/London", None, "2025-04-03T09:00:00"),
        ("4/27/2023 12:05:01 am", "America/Phoenix", None, "2023-04-27T07:05:01"),
        ("1708696061.071", None, None, "2024-02-23T13:47:41.071"),
        ("1743865093224753", None, None, "2025-04-05T14:58:13.224"),
        ("15SEP25 0503Z", None, None, "2025-09-15T05:03:00"),
        ("Thu, 22 Jun 2023 07:08:24 -0400", None, None, "2023-06-22T11:08:24"),
        ("2025-09-21 21:26:27 AEST", None, None, "2025-09-21T11:26:27"),
        ("0628", "Asia/Tokyo", "2025-01-31T07:00:00", "2025-02-01T06:28:00"),
        ("1253L", "America/Chicago", "2025-01-31T07:00:00", "2025-01-31T18:53:00"),
        ("31/0600", None, "2025-01-31T07:00:00", "2025-03-31T06:00:00"),
        ("010600Z", None, "2025-01-31T07:00:00", "2025-02-01T06:00:00"),
        ("2500", None, "2025-01-31T07:00:00", None),
        ("32/0600", None, "2025-01-31T07:00:00", None),
        ("0628", None, None, None),
        ("2023-13-15T18:11:07Z", None, None, None),
        ("TBA", None, None, None),
        ("x" * 1000, None, None, None),
    ],
)
def test_interpretations(value, zone, at, expected):
    us = None if at is None else instants._us(datetime.fromisoformat(at))
    found = instants.viterbi([instants.interpretations(value, zone, us, station_zone=zone)])[0]
    assert (None if found is None else found // 1000) == (None if expected is None else instants._us(datetime.fromisoformat(expected)) // 1000)


def test_instants(spark):
    schema = "id long, source string, station_ident string, timestamp string, origin string, destination string, departure_time string, eta string"
    rows = [(1, "s", "A", "2025-01-01 10:00", "X", "Y", "1200L", "0930"), (2, None, "?", "2025-01-01 10:00", None, None, None, ""), (None, "s", "A", " 2025-01-01T10:00:00Z ", "X", "Y", "----", "2025-01-02 00:30")]
    stations = spark.createDataFrame([("A", "Europe/Berlin")], "ident string, tz string")
    airports = spark.createDataFrame([("X", "Asia/Tokyo"), ("Y", "UTC")], "icao string, tz string")
    found = {(r.id, r.field_name): r.utc_ms for r in instants.instants(spark.createDataFrame(rows, schema), stations, airports).collect()}
    ms = lambda s: instants._us(datetime.fromisoformat(s)) // 1000
    assert found == {
        (1, "timestamp"): ms("2025-01-01T09:00:00"), (1, "departure_time"): ms("2025-01-02T03:00:00"), (1, "eta"): ms("2025-01-01T09:30:00"), (None, "timestamp"): ms("2025-01-01T10:00:00"), (None, "eta"): ms("2025-01-02T00:30:00"),
    }
    assert instants.instants(spark.createDataFrame([], schema), stations, airports).count() == 0


def test_viterbi_prefers_the_same_format():
    both = [(100, "a", 0.0), (90, "b", 0.0)]
    assert instants.viterbi([[(50, "b", 0.0)], both, [(120, "b", 0.0)]]) == [50, 90, 120]


def test_viterbi_decides_what_no_rule_settles(spark):
    """Slash dates with a zone of their own from stations of unknown zone: the records around them tell the order."""
    schema = "id long, source string, station_ident string, timestamp string, tail string, label string, origin string, destination string, departure_time string, eta string"
    places = "ident string, icao string, tz string"
    none = spark.createDataFrame([], places)
    stamps = {"a": ["25/03/2025 10:00Z", "04/04/2025 10:00Z", "05/04/2025 10:00Z"], "b": ["03/25/2025 10:00Z", "04/04/2025 10:00Z", "04/05/2025 10:00Z"]}
    rows = [(100 * j + i, source, None, t, None, None, None, None, None, None) for j, (source, ts) in enumerate(stamps.items()) for i, t in enumerate(ts)]
    found = {r.id: r.utc_ms for r in instants.instants(spark.createDataFrame(rows, schema), none, none).collect()}
    ms = lambda d: instants._us(datetime.fromisoformat(d)) // 1000
    expected = [ms("2025-03-25T10:00"), ms("2025-04-04T10:00"), ms("2025-04-05T10:00")]
    assert [found[i] for i in range(3)] == expected and [found[100 + i] for i in range(3)] == expected
    alone = [instants.viterbi([instants.interpretations(t, None, own=True)])[0] // 1000 for t in stamps["a"]]
    assert alone != expected  # the value alone doesn't tell


def test_padded_values_and_the_date_order_of_the_station():
    assert instants.viterbi([instants.interpretations(" " * 80 + "2025-03-01T10:00:00Z" + " " * 80, None)])[0] is not None
    day_first = instants.viterbi([instants.interpretations("04/05/2025 10:00", "America/Chicago", station_zone="Europe/Paris")])[0]
    assert day_first == instants._us(datetime(2025, 5, 4, 15, 0))


# 1 and 6


def _track(spark, points, hexcode="ABCDEF"):
    """points: (minutes, lat, lon, alt, gs)."""
    updates = [(i, 1000 + i, hexcode, None, p[1], p[2], p[3], p[4]) for i, p in enumerate(points)]
    log = [(i, 1000 + i, T0 + timedelta(minutes=p[0]), "x", T0) for i, p in enumerate(points)]
    return spark.createDataFrame(updates, UPDATE), messages(spark, log)


def _register(spark):
    return spark.createDataFrame([("ABCDEF", "N1")], "icao_hex string, registration string")


def test_spikes_and_stuck_values(spark):
    rng = np.random.default_rng(5)
    points = [[3 * i, 40 + 0.2 * i, 10.0 + 0.1 * i, int(35000 + rng.normal(0, 20)), int(450 + rng.normal(0, 5))] for i in range(120)]
    points[20][3] = 3500
    points[40][4] = 0
    points[60][1] = -points[60][1]
    points[70][3] = 99999
    for i in range(80, 90):
        points[i][3] = points[80][3]
    points[100][3], points[100][4] = None, None
    for i in range(110, 120):  # reached and kept
        points[i][3] -= 6000
    updates, log = _track(spark, points)
    found = {(r.update_id, r.field_name) for r in spikes.flagged(updates, log, _register(spark)).collect()}
    assert found == {(20, "altitude"), (40, "ground_speed"), (60, "latitude"), (70, "altitude")} | {(i, "altitude") for i in range(81, 90)}


def test_small_position_spikes_by_own_noise(spark):
    rng = np.random.default_rng(6)
    points = [[5 * i, 40 + rng.normal(0, 0.001), 10 + rng.normal(0, 0.001), 300, 0] for i in range(60)]
    points += [[400 + i / 3, 40 + 0.04 * i, 10 + 0.01 * i, int(35000 + rng.normal(0, 20)), int(430 + rng.normal(0, 3))] for i in range(60)]
    points[20][1] += 0.2
    points[40][2] -= 0.15
    points[90][2] += 0.3
    updates, log = _track(spark, points)
    found = {(r.update_id, r.field_name) for r in spikes.flagged(updates, log, _register(spark)).collect()}
    assert found == {(20, "latitude"), (40, "longitude"), (90, "longitude")}


def test_holding_pattern_is_no_case():
    t = np.arange(60) * 240.0
    lat = 50 + 0.12 * np.sin(np.arange(60) * 2.4)  # at 210 knots at most
    speed = np.full(60, 210.0)
    assert not spikes.spikes("latitude", t, lat, lat, speed, np.full(60, 9000.0)).any()


def test_spikes_are_removed_until_none_is_left():
    x = 35000 + np.random.default_rng(0).normal(0, 10, 300)
    x[100:140] += 12000 * (-0.95) ** np.arange(40)
    t, still, speed = np.arange(300) * 60.0, np.zeros(300), np.full(300, 450.0)
    found = spikes.spikes("altitude", t, x, still, speed, x)
    assert found[100:140:2].sum() + found[101:140:2].sum() > 8
    left = ~found
    assert not spikes.spikes("altitude", t[left], x[left], still[left], speed[left], x[left]).any()


def test_spikes_beside_silences_and_of_sparse_reports():
    rng = np.random.default_rng(1)
    t = np.arange(60) * 180.0
    t[31:] += 4 * 3600
    x, speed, still = 35000 + rng.normal(0, 20, 60), 450 + rng.normal(0, 3, 60), np.zeros(60)
    x[30], speed[31] = 3500, 20
    assert np.flatnonzero(spikes.spikes("altitude", t, x, still, speed, x)).tolist() == [30]
    assert np.flatnonzero(spikes.spikes("ground_speed", t, speed, still, speed, x)).tolist() == [31]
    sparse = np.arange(60) * 2 * 3600.0
    assert np.flatnonzero(spikes.spikes("altitude", sparse, x, still, np.full(60, 450.0), x)).tolist() == [30]
    climb = x.copy()
    climb[30], t[30] = 21000, t[30] + 400  # reached within minutes
    assert not spikes.spikes("altitude", t, climb, still, np.full(60, 450.0), climb).any()


def test_impossible_without_identity_and_copies(spark):
    updates = spark.createDataFrame([(1, None, None, None, 95.0, float("nan"), None, -5), (2, None, None, None, None, None, None, None)], UPDATE)
    found = {(r.update_id, r.field_name) for r in spikes.flagged(updates, messages(spark, []), _register(spark)).collect()}
    assert found == {(1, "latitude"), (1, "longitude"), (1, "ground_speed")}
    assert spikes.flagged(updates.limit(0), messages(spark, []), _register(spark)).count() == 0


def test_coarse_sensor_is_no_case():
    t = np.arange(100) * 180.0
    x = np.repeat([35000.0, 36000.0, 35000.0, 34000.0], 25)
    moving = np.full(100, 450.0)
    assert not spikes.stuck("altitude", t, x, t, 40 + t / 9000, np.full(100, 10.0), moving).any()


def test_stops_and_trips(spark):
    points = [(5 * i, 50.0 + 0.001 * (i % 2), 8.0, 300, 0) for i in range(8)]
    points += [(40 + 5 * i, 50.3 + 0.3 * i, 8.1 + 0.1 * i, 30000, 400) for i in range(6)]
    points += [(75 + 5 * i, 52.0, 8.7, 300, 0) for i in range(6)]
    points += [(1000, 52.0, 8.7, 300, 0), (1010, 52.4, 8.8, 3000, 300)]
    updates, log = _track(spark, points)
    extra = spark.createDataFrame([(900, 1003, "abcdef", None, 50.001, 8.0, 300, 0), (901, 1003, None, "n1", 50.001, 8.0, 300, 0)], UPDATE)
    found = sorted((r.first_message_id, r.last_message_id, r.kind, round(r.duration_s / 60)) for r in stays.stays(updates.unionByName(extra), log, _register(spark)).collect())
    assert found == [(1000, 1007, "stop", 35), (1008, 1013, "trip", 25), (1014, 1019, "stop", 25), (1020, 1021, "trip", 10)]
    assert stays.stays(updates.limit(0), log, _register(spark)).count() == 0


def test_blocks_agree_with_one_block(spark, data, monkeypatch):
    from aerolith.sources.tables import table

    tables = [table(spark, data, n) for n in ("flight_updates", "messages", "aircraft")]
    whole, wrong = {tuple(r) for r in stays.stays(*tables).collect()}, {tuple(r) for r in spikes.flagged(*tables).collect()}
    monkeypatch.setattr(spikes, "BLOCK", 150)
    assert {tuple(r) for r in spikes.flagged(*tables).collect()} == wrong
    assert {tuple(r) for r in stays.stays(*tables).collect()} == whole


def _brute_stops(rows):
    """Stops by definition: the anchor moves behind the last position that is too far."""
    out, window = [], []
    for r in rows:
        far = [i for i, w in enumerate(window) if stays.kilometres(r[3], r[4], w[3], w[4]) > stays.RADIUS]
        if far and window[-1][2] - window[0][2] >= stays.STAY:
            out.append((window[0][0], window[-1][0]))
            window = []
        elif far:
            window = window[far[-1] + 1 :]
        window.append(r)
    return out + ([(window[0][0], window[-1][0])] if window and window[-1][2] - window[0][2] >= stays.STAY else [])


@pytest.mark.parametrize("lat,lon", [(50.0, 8.0), (89.99, 0.0), (0.0, 179.999)])
def test_hulls_against_brute_force(lat, lon):
    rng = np.random.default_rng(int(lat))
    rows, at, x, y = [], 0, 0.0, 0.0
    for i in range(1500):
        at += int(rng.integers(30, 400)) * 1_000_000
        step = 2.0 if rng.random() < 0.1 else 0.3
        x, y = x + rng.normal(0, step), y + rng.normal(0, step)
        place = (min(90.0, lat + y / 111.2) if lat < 80 else 90 - abs(y) / 111.2, (lon + x / 111.2 / max(0.01, np.cos(np.radians(lat))) + 180) % 360 - 180)
        rows.append((i, 0, at, *map(float, place)))
    window, found = stays.Anchored(), []
    for r in rows:
        found.append(window.put(*r))
    found.append(window.stop())
    assert [f[:2] for f in found if f] == _brute_stops(rows)


def test_long_stops_take_linear_time():
    import time

    def seconds(n):
        rng = np.random.default_rng(n)
        places = np.stack([50 + rng.normal(0, 0.001, n), 8 + rng.normal(0, 0.001, n)], axis=1).tolist()
        window, began = stays.Anchored(), time.process_time()
        assert all(window.put(i, 0, i * 60_000_000, *p) is None for i, p in enumerate(places))
        return time.process_time() - began

    assert seconds(8000) < 0.5 and seconds(100_000) < 8
