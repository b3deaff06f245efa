"""Problem 1: impossible readings, spikes and stuck values, per aircraft.

Readings outside BOUNDS are impossible in themselves. The others are put in time
order per aircraft (blocks of bounded size with a halo, see `ordered`) and, field by
field, decomposed by an undecimated lifting wavelet: the detail of a reading is its
distance from the mean of its neighbours. The details' median absolute deviation is
the noise of that aircraft and field, the lesser of that over all and over local extremes, once in motion and once at rest. A spike is a
reading with a detail of more than K noises that lies outside both neighbours by as
much while these agree; the largest of adjacent ones is taken out and the details are
computed anew, until none is left, so that details of all widths are tested. What is usual
for an aircraft (noise, steps, gaps, top speed) is counted over all of its blocks first. Neighbours over a longer gap than is usual for the
aircraft must agree the better, and the reading be out of reach at any climb. A position in motion must besides be out of reach at
the aircraft's own top speed, as holding patterns go out and back too.
Runs of zero first-level detail (equal readings) of RUN and more show sticking, if
the aircraft moves on and the sensor doesn't report in steps as coarse as its noise.

Defined results: null readings are never cases, NaN and infinite ones always. Reports
without identity or time can only be impossible in themselves. All rows of a flagged
report are cases where they have a reading. Equal times are ordered by message id.
Empty tables give no cases; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.operators.ordered import blocks
from aerolith.operators.tracks import identified, tracks
from aerolith.sources.tables import shuffle_width

BOUNDS = {"altitude": (-1500.0, 60000.0), "ground_speed": (0.0, 1000.0), "latitude": (-90.0, 90.0), "longitude": (-180.0, 180.0)}
K = {"altitude": 3.5, "ground_speed": 5.0, "latitude": 3.5, "longitude": 3.5}
LEAST = {"altitude": 300.0, "ground_speed": 25.0, "latitude": 0.02, "longitude": 0.02}  # what a spike must be off at least
AWAY = 0.5  # degrees; what is off by more is tested however noisy the positions are
SLACK = 1.5  # by which an aircraft may exceed its usual top speed between two positions
MOVING = 60.0  # knots
FASTEST = 800.0  # knots
RUN = 7
BLOCK, HALO = 20_000, 64
HOUR = 3600.0
NEAR = 1.5 * HOUR  # within which an aircraft's three successive reports belong together, or 1.5 times the usual, if that is more
STEPS = (1000.0, 500.0, 250.0, 100.0, 50.0, 25.0, 20.0, 10.0, 5.0, 2.0)
FIELDS = tuple(BOUNDS)
REACH = {"altitude": (1000.0, 5000.0 / 60), "ground_speed": (120.0, 1.0)}  # feet and knots that may be gained at once, and a second


def log_bin(x: np.ndarray) -> np.ndarray:
    """Bins of half a percent; 0 for zero."""
    return np.where(x > 0, np.round(128 * np.log2(np.maximum(x, 1e-9))) + 10_000, 0).astype(np.int64)


def span_bin(seconds: np.ndarray) -> np.ndarray:
    """0 within an hour, then bins of less than a percent."""
    return np.where(seconds < HOUR, 0, 1 + np.floor(100 * np.log2(np.maximum(seconds, HOUR) / HOUR))).astype(np.int64)


FAST, EXTREME, VALUES, STEP, SPEED = 1, 2, 8, 9, 10  # what is counted: details (by motion, and of local extremes), readings, multiples of a step, speeds


def tally(t: np.ndarray, readings: dict[str, np.ndarray], core: np.ndarray) -> pd.DataFrame:
    """Counts, of the core rows of one block, from which an aircraft's usual behaviour follows: field, what, span, bin and n. They add up over blocks."""
    parts = []

    def count(field: int, what, span: np.ndarray, bins: np.ndarray) -> None:
        keys, n = np.unique((np.asarray(what, np.int64) << 48) + (span << 24) + bins, return_counts=True)
        parts.append(np.stack([np.full(len(keys), field), keys >> 48, keys >> 24 & 0xFFFFFF, keys & 0xFFFFFF, n], axis=1))

    speed = readings["ground_speed"]
    for k, f in enumerate(FIELDS):
        i = np.flatnonzero(~np.isnan(readings[f]))
        x, s, own = readings[f][i], t[i], core[i]
        parts.append(np.array([[k, VALUES, 0, 0, own.sum()], *[[k, STEP, j, 0, (x[own] % step == 0).sum()] for j, step in enumerate(STEPS)]]))
        if len(x) >= 3:
            p, v, n = x[:-2], x[1:-1], x[2:]
            mine = own[1:-1]
            what = moving(speed[i])[1:-1] * FAST + ((v - p) * (v - n) > 0) * EXTREME
            count(k, what[mine], span_bin(s[2:] - s[:-2])[mine], log_bin(np.abs(v - (p + n) / 2))[mine])
    known = np.round(speed[core & ~np.isnan(speed)]).astype(np.int64)
    count(0, np.full(len(known), SPEED), np.zeros(len(known), np.int64), known)
    return pd.DataFrame(np.concatenate(parts), columns=["field", "what", "span", "bin", "n"])


def _quantile(bins: np.ndarray, n: np.ndarray, q: float) -> int:
    order = np.argsort(bins)
    return int(bins[order][np.searchsorted(np.cumsum(n[order]), q * n.sum())])


USUAL = [f"{f}_{what}" for f in BOUNDS for what in ("span", "step", "fast", "rest", "all")] + ["top"]


def usual(counts: pd.DataFrame) -> dict[str, float]:
    """An aircraft's usual behaviour from all its counts: for each field the span of three successive reports, the coarsest step of which nine tenths of the readings are multiples, and
    the noise in motion, at rest and altogether; and the speed it can't have exceeded."""
    out = {}
    for k, f in enumerate(FIELDS):
        mine = counts[counts["field"] == k]
        what, span, bins, n = (mine[c].to_numpy() for c in ("what", "span", "bin", "n"))
        values = int(n[what == VALUES].sum())
        detail = what < VALUES
        middle = _quantile(span[detail], n[detail], 0.5) if n[detail].sum() >= 8 else 0
        out[f"{f}_span"] = NEAR if not middle else max(NEAR, 1.5 * HOUR * 2 ** ((middle - 0.5) / 100))
        out[f"{f}_step"] = next((step for j, step in enumerate(STEPS) if values and n[(what == STEP) & (span == j)].sum() >= 0.9 * values), 1.0)
        near = detail & (HOUR * 2 ** ((span - 1) / 100) < (HOUR if out[f"{f}_span"] == NEAR else out[f"{f}_span"]))
        for name, chosen in (("fast", what & FAST > 0), ("rest", what & FAST == 0), ("all", np.ones(len(what), bool))):
            some = near & chosen if n[near & chosen].sum() >= 10 else near
            found = []
            for m, least in ((some, 1), (some & (what & EXTREME > 0), 10)):
                if n[m].sum() >= least:
                    b = _quantile(bins[m], n[m], 0.5)
                    found.append(1.4826 * 2 ** ((b - 10_000) / 128) if b else 0.0)
            out[f"{f}_{name}"] = min(found, default=0.0) if values >= 5 else 0.0
    speeds = counts[counts["what"] == SPEED]
    n = speeds["n"].to_numpy()
    out["top"] = min(FASTEST, max(2 * MOVING, SLACK * _quantile(speeds["bin"].to_numpy(), n, 0.99))) if n.sum() >= 20 else FASTEST
    return out


def moving(gs: np.ndarray) -> np.ndarray:
    """Whether the middle one of each three successive speeds, as far as known, is that of motion."""
    known = np.where(np.isnan(gs), np.inf, gs)
    three = np.sort(np.stack([np.concatenate([[np.inf], known[:-1]]), known, np.concatenate([known[1:], [np.inf]])]), axis=0)
    n = np.isfinite(three).sum(axis=0)
    middle = np.where(n >= 2, np.where(n == 3, three[1], np.where(np.isfinite(three[1]), (three[0] + np.where(np.isfinite(three[1]), three[1], 0.0)) / 2, 0.0)), np.where(n == 1, three[0], np.inf))
    return middle > MOVING


def spikes(field: str, t: np.ndarray, x: np.ndarray, lat: np.ndarray, gs: np.ndarray, alt: np.ndarray, own: dict[str, float] | None = None) -> np.ndarray:
    """A mask of the spikes of one series; lat, gs and alt are those of the same reports, own is what is usual for the aircraft (by default, for this series)."""
    own = own or usual(tally(t, {"latitude": lat, "longitude": np.full(len(t), np.nan), "altitude": alt, "ground_speed": gs} | {field: x}, np.ones(len(t), bool)))
    out = np.zeros(len(x), bool)
    if len(x) < 3:
        return out
    place = field in ("latitude", "longitude")
    fast = moving(gs)
    scale = np.where(fast, own[f"{field}_fast"], own[f"{field}_rest"])
    limit = np.maximum(K[field] * scale, LEAST[field])
    if place:
        limit, fastest = np.minimum(limit, AWAY), own["top"]
    else:
        limit, together = np.maximum(limit, 2 * own[f"{field}_step"]), own[f"{field}_span"]
    while True:  # each round takes out a reading at least
        left = np.flatnonzero(~out)
        if len(left) < 3:
            break
        y, s = x[left], t[left]
        p, v, n = y[:-2], y[1:-1], y[2:]
        before, after = np.maximum(s[1:-1] - s[:-2], 1.0), np.maximum(s[2:] - s[1:-1], 1.0)
        off = np.abs(v - np.clip(v, np.minimum(p, n), np.maximum(p, n)))
        detail = np.abs(v - (p + n) / 2)
        apart = np.abs(p - n)
        at = left[1:-1]
        if place:
            km = 111.2 * (np.cos(np.radians(np.clip(np.nan_to_num(lat[at]), -85, 85))) if field == "longitude" else 1.0)
            knots = lambda d, dt: d * km / 1.852 / (dt / HOUR)
            impossible = np.maximum(knots(np.abs(v - p), before), knots(np.abs(v - n), after)) > fastest
            agree = (knots(apart, before + after) <= FASTEST) & (apart <= np.maximum(off, 0.05) * 2)
            # Holding patterns go out and back as well, so at less than AWAY only positions at rest count without a look at the speed.
            still = (apart < 0.05) & (before + after < 2 * HOUR) & (~fast[at] | (off > AWAY))
            hit = (off > limit[at]) & agree & (impossible | still)
        else:
            within = np.minimum(1.0, together / (before + after))
            agree = apart <= np.maximum(3 * scale[at], off / 3 * within)
            # Over longer gaps than usual much may happen unseen, but not faster than an aircraft climbs or gains speed.
            sudden = off > REACH[field][0] + REACH[field][1] * np.minimum(before, after)
            hit = (off > limit[at]) & (detail > limit[at]) & agree & ((within == 1.0) | sudden)
            if hit.any():  # a landing between two reports lowers speed and altitude together
                other = (gs if field == "altitude" else alt)[left]
                op, ov, on = other[:-2], other[1:-1], other[2:]
                with np.errstate(invalid="ignore"):
                    if field == "altitude":
                        landing = (ov < MOVING) & (np.minimum(op, on) > MOVING)
                    else:
                        landing = (v < MOVING) & (np.minimum(op, on) - ov > 500.0)
                hit &= ~(landing & (v < np.minimum(p, n)))
        if not hit.any():
            break
        score = np.where(hit, off, 0.0)
        padded = np.concatenate([[0.0], score, [0.0]])
        hit &= (score >= padded[:-2]) & (score >= padded[2:])
        out[at[hit]] = True
    return out


def stuck(field: str, t: np.ndarray, x: np.ndarray, every_t: np.ndarray, lat: np.ndarray, lon: np.ndarray, gs: np.ndarray, own: dict[str, float] | None = None) -> np.ndarray:
    """A mask of the repeats of long runs of equal readings; lat, lon and gs are those of all reports, with wrong ones as NaN."""
    out = np.zeros(len(x), bool)
    if len(x) < RUN:
        return out
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    ends = np.concatenate([starts[1:], [len(x)]])
    if not (ends - starts >= RUN).any():
        return out
    place = field in ("latitude", "longitude")
    if not place:
        own = own or usual(tally(t, {"latitude": np.full(len(t), np.nan), "longitude": np.full(len(t), np.nan), "altitude": np.full(len(t), np.nan), "ground_speed": np.full(len(t), np.nan)} | {field: x}, np.ones(len(t), bool)))
        if own[f"{field}_all"] <= 2.5 * own[f"{field}_step"]:  # steps as coarse as the noise
            return out
    for a, b in zip(starts, ends):
        if b - a < RUN:
            continue
        i, j = np.searchsorted(every_t, t[a], "left"), np.searchsorted(every_t, t[b - 1], "right")
        speeds = gs[i:j][~np.isnan(gs[i:j])]
        spread = 0.0
        for c in (lat[i:j], lon[i:j]):
            c = c[~np.isnan(c)]
            if len(c):
                spread = max(spread, float(np.ptp(c)))
        if place:
            moves = (len(speeds) > 0 and np.median(speeds) > 40.0) or spread > 0.05
        else:
            moves = spread > 0.1 or (field == "altitude" and len(speeds) > 0 and np.median(speeds) > 40.0)
        if moves:
            out[a + 1 : b] = True
    return out


def judge(t: np.ndarray, readings: dict[str, np.ndarray], own: dict[str, float]) -> dict[str, np.ndarray]:
    """For each field a mask of the wrong readings of one aircraft's reports in time order; nulls are NaN."""
    wrong = {f: np.zeros(len(t), bool) for f in FIELDS}
    for f in ("latitude", "longitude", "altitude", "ground_speed"):
        i = np.flatnonzero(~np.isnan(readings[f]))
        wrong[f][i[spikes(f, t[i], readings[f][i], readings["latitude"][i], readings["ground_speed"][i], readings["altitude"][i], own)]] = True
    good = {f: np.where(wrong[f], np.nan, readings[f]) for f in FIELDS}
    for f in FIELDS:
        i = np.flatnonzero(~np.isnan(good[f]))
        wrong[f][i[stuck(f, t[i], good[f][i], t, good["latitude"], good["longitude"], good["ground_speed"], own)]] = True
    return wrong


def possible(field: str):
    low, high = BOUNDS[field]
    return F.col(field).between(low, high) & ~F.isnan(field)


def judged(track: DataFrame, finish: Callable[[pd.DataFrame, dict[str, np.ndarray]], pd.DataFrame], schema: str) -> DataFrame:
    """What `finish` makes of each block of a track, its rows in order with is_core, and the masks of their wrong readings; those impossible in themselves count as missing.

    One pass over the blocks counts what is usual, a second one judges; only the counts are merged over an aircraft.
    """
    clean = track.select("report", "hex", "at", *[F.when(possible(f), F.col(f)).alias(f) for f in FIELDS])
    cut = blocks(clean, "hex", ["at", "report"], F.floor(F.col("at") / (86_400 * 1_000_000)), BLOCK, HALO).repartition(shuffle_width(track.sparkSession), "hex", "block")

    def series(pdf: pd.DataFrame) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        return pdf["at"].to_numpy(float) / 1e6, {f: pdf[f].to_numpy(float) for f in FIELDS}

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        return tally(*series(pdf), pdf["is_core"].to_numpy(bool)).assign(hex=pdf["hex"].iloc[0], block=pdf["block"].iloc[0])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        named = sorted({b for some in pdf["blocks"] if some is not None for b in some})
        return pd.DataFrame([{"hex": pdf["hex"].iloc[0], "usual": list(usual(pdf).values()), "blocks": named}])

    def run(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        return finish(pdf, judge(*series(pdf), dict(zip(USUAL, own["usual"].iloc[0]))))

    grouped = cut.groupBy("hex", "block")
    counts = grouped.applyInPandas(count, "hex string, block bigint, field bigint, what bigint, span bigint, bin bigint, n bigint")
    where = F.when((F.col("what") == VALUES) & (F.col("field") == 0), F.col("block"))
    whole = counts.groupBy("hex", "field", "what", "span", "bin").agg(F.sum("n").alias("n"), F.collect_set(where).alias("blocks")).repartition(shuffle_width(track.sparkSession), "hex")
    held = whole.groupBy("hex").applyInPandas(merge, "hex string, usual array<double>, blocks array<bigint>").select("hex", "usual", F.explode("blocks").alias("block"))
    return grouped.cogroup(held.groupBy("hex", "block")).applyInPandas(run, schema)


def wrong_reports(track: DataFrame) -> DataFrame:
    """(report, field_name): spikes and stuck readings."""

    def finish(pdf: pd.DataFrame, masks: dict[str, np.ndarray]) -> pd.DataFrame:
        core, report = pdf["is_core"].to_numpy(bool), pdf["report"].to_numpy()
        found = [(f, report[masks[f] & core]) for f in FIELDS]
        return pd.DataFrame({"report": np.concatenate([r for _, r in found]), "field_name": np.repeat([f for f, _ in found], [len(r) for _, r in found])})

    return judged(track, finish, "report bigint, field_name string")


def flagged(updates: DataFrame, messages: DataFrame, register: DataFrame) -> DataFrame:
    """(update_id, field_name) of each wrong reading."""
    reports = identified(updates, register)
    value = F.col("value")
    low = F.create_map(*[x for f, (lo, _) in BOUNDS.items() for x in (F.lit(f), F.lit(lo))])
    high = F.create_map(*[x for f, (_, hi) in BOUNDS.items() for x in (F.lit(f), F.lit(hi))])
    long = reports.select("update_id", "report", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in FIELDS])).alias("x")).select("update_id", "report", "x.*").where("value IS NOT NULL")
    sure = F.isnan(value) | (value < low[F.col("field_name")]) | (value > high[F.col("field_name")])
    bad = wrong_reports(tracks(reports, messages)).withColumn("hit", F.lit(True))
    return long.join(bad, ["report", "field_name"], "left").where(sure | F.col("hit")).select("update_id", "field_name")
