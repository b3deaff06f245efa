"""Message decoders and their registry."""

from __future__ import annotations

from aerolith.decoders import briefs, clearances, flight_plans, loadsheets, notes, reports, weather

EVERY = [*reports.DECODERS, *notes.DECODERS, *flight_plans.DECODERS, *weather.DECODERS, *loadsheets.DECODERS, *clearances.DECODERS, *briefs.DECODERS]


def registry(which: str = "default"):
    """The decoders in use: `default` leaves out those that are not registered by default, `all` has every one."""
    return [d for d in EVERY if d.standard or which == "all"]
