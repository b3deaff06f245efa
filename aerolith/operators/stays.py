"""Problem 6: stops and trips from position reports.

Per aircraft the positions are ordered in blocks of bounded size. No stop crosses two
successive positions more than RADIUS apart or a silence of more than SILENCE, so the
track falls apart into segments at these; each is read as a stream, in order: from an
anchor the window grows while every position in it is within RADIUS of the new one,
else the anchor moves behind the last position that is too far. A window of at least
STAY is a stop. What lies between stops and silences are trips.

The farthest position of a window from any other is a corner of the window's convex
hull, and a position inside the hull is near to all of it. So a window keeps its hull
only, and its positions themselves just while it is shorter than STAY. Hulls are those
of the gnomonic projection about the window's first position, in which great circles
are straight and circles convex, so that the test is exact at the poles and at 180
degrees as well.

The blocks are those in which problem 1 judges the readings; stops are set against the
blocks they touch, and each block gives its runs. Of a whole aircraft only the ends of
its blocks are set in order.

Defined results: each message counts once; reports without identity, time or a right
position (null, or flagged by problem 1) are passed over. A single position in no stop
is a trip of its own with no duration. Equal times are ordered by message id. Empty
tables give empty results; further columns are passed by.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.operators.spikes import judged
from aerolith.operators.tracks import identified, tracks
from aerolith.session import checkpoint_dir
from aerolith.sources.tables import shuffle_width

RADIUS = 3.0  # km
STAY = 20 * 60 * 1_000_000
SILENCE = 6 * 3600 * 1_000_000
EARTH = 6371.0


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def kilometres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a, b = math.radians(lat1), math.radians(lat2)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH * math.asin(math.sqrt(min(h, 1.0)))


class Hull:
    """The convex hull of positions near each other, counterclockwise, as (x, y, latitude, longitude)."""

    def __init__(self) -> None:
        self.corners: list[tuple[float, float, float, float]] = []

    def flat(self, lat: float, lon: float) -> tuple[float, float, float, float]:
        """A position with its place on the plane that touches the globe at the first one."""
        a, o = math.radians(lat), math.radians(lon)
        p = (math.cos(a) * math.cos(o), math.cos(a) * math.sin(o), math.sin(a))
        if not self.corners:
            self.up = p
            self.east = (-math.sin(o), math.cos(o), 0.0)
            self.north = (-math.sin(a) * math.cos(o), -math.sin(a) * math.sin(o), math.cos(a))
        depth = sum(u * v for u, v in zip(p, self.up))
        return (sum(u * v for u, v in zip(p, self.east)) / depth, sum(u * v for u, v in zip(p, self.north)) / depth, lat, lon)

    def holds(self, at: tuple[float, float, float, float]) -> bool:
        """Whether a place lies inside or on the hull."""
        x, y = at[0], at[1]
        if len(self.corners) < 3:
            return any(c[2] == at[2] and c[3] == at[3] for c in self.corners)
        px, py = self.corners[-1][:2]
        for qx, qy, _, _ in self.corners:
            if (qx - px) * (y - py) - (qy - py) * (x - px) < 0:
                return False
            px, py = qx, qy
        return True

    def near(self, lat: float, lon: float) -> bool:
        """Whether all positions are within RADIUS of a place outside of the hull."""
        return all(kilometres(lat, lon, c[2], c[3]) <= RADIUS for c in self.corners)

    def add(self, at: tuple[float, float, float, float]) -> None:
        points = sorted({*self.corners, at})
        if len(points) < 3:
            self.corners = points
            return
        half = []
        for run in (points, points[::-1]):
            side: list[tuple[float, float, float, float]] = []
            for p in run:
                while len(side) > 1 and (side[-1][0] - side[-2][0]) * (p[1] - side[-2][1]) - (side[-1][1] - side[-2][1]) * (p[0] - side[-2][0]) <= 0:
                    side.pop()
                side.append(p)
            half += side[:-1]
        self.corners = half


class Anchored:
    """The growing window of one segment: its hull, its ends, and its positions while it is no stop yet."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.recent: list[tuple[int, int, int, float, float]] = []  # rank, block, time, place; dropped once the window is a stop
        self.hull = Hull()
        self.first = self.last = None
        self.grown = False

    def put(self, rank: int, block: int, at: int, lat: float, lon: float) -> tuple | None:
        """Takes the next position; gives the stop that ended before it, if one did: ranks and blocks of its ends."""
        ended = None
        if self.first is not None:
            place = self.hull.flat(lat, lon) if kilometres(lat, lon, self.first[3], self.first[4]) <= RADIUS else None
            if place is None or not (self.hull.holds(place) or self.hull.near(lat, lon)):
                if self.grown:
                    ended = self.stop()
                    self.clear()
                else:
                    self.cut(lat, lon)
        row = (rank, block, at, lat, lon)
        if self.first is None:
            self.first = row
        place = self.hull.flat(lat, lon)
        if not self.hull.corners or not self.hull.holds(place):
            self.hull.add(place)
        self.last = row
        self.grown = self.grown or at - self.first[2] >= STAY
        if self.grown:
            self.recent = []
        else:
            self.recent.append(row)
        return ended

    def cut(self, lat: float, lon: float) -> None:
        """Moves the anchor behind the last position that is too far from a place."""
        keep = len(self.recent)
        while keep and kilometres(lat, lon, self.recent[keep - 1][3], self.recent[keep - 1][4]) <= RADIUS:
            keep -= 1
        kept = self.recent[keep:]
        self.clear()
        self.recent = kept
        if kept:
            self.first, self.last = kept[0], kept[-1]
            for row in kept:
                place = self.hull.flat(row[3], row[4])
                if not self.hull.corners or not self.hull.holds(place):
                    self.hull.add(place)

    def stop(self) -> tuple | None:
        return (self.first[0], self.last[0], self.first[1], self.last[1]) if self.grown else None


def stop_ranges(rows: DataFrame) -> DataFrame:
    """(hex, block, first_rank, last_rank) of each stop, once for each block it touches, from rows hex, segment, rank, block, at, latitude, longitude."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, window, found = None, Anchored(), []

        def note(stop: tuple | None) -> None:
            if stop is not None:
                found.extend((key[0], b, stop[0], stop[1]) for b in range(stop[2], stop[3] + 1))

        def out() -> pa.RecordBatch:
            columns = list(zip(*found)) or [()] * 4
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *[pa.array(c, pa.int64()) for c in columns[1:]]], ["hex", "block", "first_rank", "last_rank"])

        for batch in batches:
            for hexcode, segment, rank, block, at, lat, lon in zip(*(c.to_pylist() for c in batch.columns)):
                if (hexcode, segment) != key:
                    note(window.stop())
                    window.clear()
                    key = (hexcode, segment)
                note(window.put(rank, block, at, lat, lon))
            if len(found) > 10_000:
                yield out()
        note(window.stop())
        yield out()

    narrow = rows.select("hex", "segment", "rank", "block", "at", "latitude", "longitude")
    spread = narrow.repartition(shuffle_width(rows.sparkSession), "hex", "segment").sortWithinPartitions("hex", "segment", "rank")
    return spread.mapInArrow(run, "hex string, block bigint, first_rank bigint, last_rank bigint")


PIECE = "hex string, kind string, run bigint, first_rank bigint, first_report bigint, first_at bigint, last_report bigint, last_at bigint, positions bigint, hops double, lead double"


def pieces(rows: pd.DataFrame, stops: pd.DataFrame) -> pd.DataFrame:
    """The runs of one block. A stop is named by its first position, a trip by the last stop's last position or the first one after a silence up to it; of `stops`, the row without first_rank has that of the blocks before."""
    names = [c.split()[0] for c in PIECE.split(", ")]
    if not len(rows):
        return pd.DataFrame({n: [] for n in names})
    rows = rows.sort_values("rank")
    rank, quiet, hop = rows["rank"].to_numpy(), rows["quiet"].to_numpy(bool), np.nan_to_num(rows["hop"].to_numpy(float))
    own = stops[stops["first_rank"].notna()].sort_values("first_rank")
    first, last = own["first_rank"].to_numpy(np.int64), own["last_rank"].to_numpy(np.int64)
    before = stops.loc[stops["first_rank"].isna(), "last_rank"].max()
    stop, ended = np.full(len(rank), -1), np.full(len(rank), -1)
    if len(first):
        i = np.searchsorted(first, rank, "right") - 1
        stop = np.where((i >= 0) & (rank <= last[i]), first[i], -1)
        ended = np.where(i >= 0, last[i], -1)
    bound = np.maximum(np.maximum.accumulate(np.where(quiet, rank, -1)), np.maximum(ended, -1 if pd.isna(before) else int(before)))
    begins = np.concatenate([[True], (stop[1:] != stop[:-1]) | ((stop[1:] < 0) & quiet[1:])])
    a = np.flatnonzero(begins)
    b = np.append(a[1:], len(rank)) - 1
    trip = stop[a] < 0
    total = np.concatenate([[0.0], np.cumsum(hop)])
    report, at = rows["report"].to_numpy(), rows["at"].to_numpy()
    return pd.DataFrame(
        {
            "hex": rows["hex"].iloc[0], "kind": np.where(trip, "trip", "stop"), "run": np.where(trip, bound[a], stop[a]), "first_rank": rank[a], "first_report": report[a], "first_at": at[a],
            "last_report": report[b], "last_at": at[b], "positions": b - a + 1, "hops": total[b + 1] - total[a + 1], "lead": hop[a],
        }
    )[names]


STEP = "report bigint, hex string, at bigint, latitude double, longitude double, rank bigint, block bigint, hop double, quiet boolean, head boolean, segment bigint, alone boolean"


def steps(pdf: pd.DataFrame, wrong: dict[str, np.ndarray]) -> pd.DataFrame:
    """The right positions of one block with the way and the silence since the one before; for its first one (`head`) that is not known here, nor is the segment up to the first break."""
    lat, lon = pdf["latitude"].to_numpy(float), pdf["longitude"].to_numpy(float)
    good = pdf["is_core"].to_numpy(bool) & ~np.isnan(lat) & ~np.isnan(lon) & ~wrong["latitude"] & ~wrong["longitude"]
    rows = pdf[good]
    lat, lon, at, rank = lat[good], lon[good], rows["at"].to_numpy(np.int64), rows["rank"].to_numpy(np.int64)
    n = len(at)
    a, o = np.radians(lat), np.radians(lon)
    h = np.sin((a[1:] - a[:-1]) / 2) ** 2 + np.cos(a[:-1]) * np.cos(a[1:]) * np.sin((o[1:] - o[:-1]) / 2) ** 2
    hop = np.concatenate([[np.nan], 2 * EARTH * np.arcsin(np.sqrt(np.minimum(h, 1.0)))])[:n]
    quiet = np.concatenate([[False], np.diff(at) > SILENCE])[:n]
    apart = quiet | (hop > RADIUS)
    segment = np.maximum.accumulate(np.where(apart, rank, -1)) if n else rank
    return pd.DataFrame(
        {
            "report": rows["report"], "hex": rows["hex"], "at": at, "latitude": lat, "longitude": lon, "rank": rank, "block": rows["block"], "hop": hop, "quiet": quiet, "head": np.arange(n) == 0,
            "segment": pd.Series(segment, index=rows.index).where(segment >= 0).astype("Int64"), "alone": apart & np.append(apart[1:], False)[:n],
        }
    )


def stays(updates: DataFrame, messages: DataFrame, register: DataFrame) -> DataFrame:
    """Stops and trips: icao_hex, kind, first_message_id, last_message_id, start_us, end_us, duration_s, distance_km, positions."""
    checkpoint_dir(updates.sparkSession)
    width = shuffle_width(updates.sparkSession)
    # Read by each step below, which would else judge the readings anew.
    placed = judged(tracks(identified(updates, register), messages), steps, STEP).repartition(width, "hex", "block").checkpoint()
    # What the first position of a block needs from the blocks before: only the ends of blocks are set in order over an aircraft.
    ends = placed.groupBy("hex", "block").agg(
        F.min(F.struct("rank", "at", "latitude", "longitude")).alias("f"), F.max(F.struct("rank", "at", "latitude", "longitude")).alias("l"), F.max("segment").alias("cut"), F.max(F.when(F.col("quiet"), F.col("rank"))).alias("still")
    )
    along = Window.partitionBy("hex").orderBy("block")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    hop = distance(F.col("p.latitude"), F.col("p.longitude"), F.col("f.latitude"), F.col("f.longitude"))
    heads = (
        ends.withColumn("p", F.lag("l").over(along))
        .withColumns({"head_hop": hop, "head_quiet": F.col("p").isNull() | (F.col("f.at") - F.col("p.at") > SILENCE)})
        .withColumn("opened", F.when(F.col("head_quiet") | (F.col("head_hop") > RADIUS), F.col("f.rank")))
        .select("hex", "block", "head_hop", "head_quiet", F.coalesce("opened", F.max(F.coalesce("cut", "opened")).over(before)).alias("carried"), F.coalesce("still", F.when(F.col("head_quiet"), F.col("f.rank"))).alias("still"))
    )
    whole = placed.join(heads.drop("still"), ["hex", "block"]).select(
        "hex", "block", "rank", "report", "at", "latitude", "longitude", "alone", *[F.when(F.col("head"), F.col(f"head_{c}")).otherwise(F.col(c)).alias(c) for c in ("hop", "quiet")], F.coalesce("segment", "carried").alias("segment")
    )
    stops = stop_ranges(whole.where("NOT alone"))  # positions apart from both neighbours are in no stop
    ended = heads.select("hex", "block", "still").join(stops.groupBy("hex", "block").agg(F.max("last_rank").alias("ended")), ["hex", "block"], "left")
    named = ended.select("hex", "block", F.lit(None).cast("bigint").alias("first_rank"), F.max(F.greatest("still", "ended")).over(before).alias("last_rank"))
    found = whole.select("hex", "block", "rank", "report", "at", "hop", "quiet").groupBy("hex", "block").cogroup(stops.unionByName(named).repartition(width, "hex", "block").groupBy("hex", "block")).applyInPandas(pieces, PIECE)
    first, last = F.min(F.struct("first_rank", "first_report", "first_at", "lead")), F.max(F.struct("first_rank", "last_report", "last_at"))
    return (
        found.groupBy("hex", "kind", "run")
        .agg(first.alias("f"), last.alias("l"), F.sum("positions").alias("positions"), F.sum(F.col("hops") + F.col("lead")).alias("hops"))
        .select(
            F.col("hex").alias("icao_hex"),
            "kind",
            F.col("f.first_report").alias("first_message_id"),
            F.col("l.last_report").alias("last_message_id"),
            F.col("f.first_at").alias("start_us"),
            F.col("l.last_at").alias("end_us"),
            ((F.col("l.last_at") - F.col("f.first_at")) / 1e6).alias("duration_s"),
            F.round(F.col("hops") - F.col("f.lead"), 3).alias("distance_km"),
            "positions",
        )
    )
