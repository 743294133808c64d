"""First passage: how many bars after an entry a move of any size is first reached.

Each bar keeps the highest high and the lowest low of the 1, 2, 4, ... bars that begin with it, each
level made from the one before.  A search for the first bar at or beyond a price skips the largest
stretch that stays short of it, then half of that, and so on: a threshold costs one lookup per level
(log of the horizon) whatever its size, so any number of targets and stops is one search.

``reach``, ``entries`` and ``touches`` are tables that a run stores.  Spark's text only; the oracle joins bars.
"""

from __future__ import annotations

from patternloom.operators.features import frame
from patternloom.plans.blocks import ORDER, split
from patternloom.plans.dual import SPARK

HORIZON = 12
#: Moves in per cent that are targets and stops.
MOVES = (5.0, 10.0, 20.0, 40.0)


def depth(horizon: int) -> int:
    """Levels that a search over ``horizon`` bars needs."""
    return max(1, horizon.bit_length())


def reach(bars: str, horizon: int = HORIZON) -> str:
    """Rows (dataset_id, bar_index, hi0, lo0, hi1, lo1, ...): extremes of the 2^k bars from a bar on."""

    def doubled(b: str) -> str:
        rows = f"SELECT dataset_id, bar_index, high AS hi0, low AS lo0 FROM {b}"
        for k in range(1, depth(horizon)):
            half = 1 << (k - 1)
            rows = f"SELECT *, greatest(hi{k - 1}, lead(hi{k - 1}, {half}) OVER ({ORDER})) AS hi{k}, least(lo{k - 1}, lead(lo{k - 1}, {half}) OVER ({ORDER})) AS lo{k} FROM ({rows}) r{k}"
        return rows

    return split(SPARK, bars, 0, doubled, ahead=1 << (depth(horizon) - 1))


def entries(bars: str, horizon: int = HORIZON) -> str:
    """Rows (dataset_id, bar_index, entry, scale, last, move, up, dn): a bar's outcome over the horizon, cut at the last bar."""
    windows = lambda b: f"SELECT dataset_id, bar_index, close AS entry, lead(close, {horizon}) OVER ({ORDER}) AS leaves, max(high) OVER ({frame(1, horizon)}) AS top, min(low) OVER ({frame(1, horizon)}) AS bottom FROM {b}"
    ends = f"SELECT dataset_id AS ds, max(bar_index) AS last, max_by(close, bar_index) AS final FROM {bars} GROUP BY dataset_id"
    moved = "(coalesce(leaves, final) - entry) / scale * 100"
    return f"""
    SELECT dataset_id, bar_index, entry, scale, last, {moved} AS move, greatest(0e0, (top - entry) / scale * 100) AS up, greatest(0e0, (entry - bottom) / scale * 100) AS dn
    FROM (SELECT w.*, e.last, e.final, greatest(abs(entry), 1e-9) AS scale FROM ({split(SPARK, bars, 0, windows, ahead=horizon)}) w JOIN ({ends}) e ON w.dataset_id = e.ds) x WHERE bar_index < last"""


def touches(entries_: str, reach_: str, horizon: int = HORIZON, moves: tuple[float, ...] = MOVES) -> str:
    """Rows (dataset_id, bar_index, side, pct, bars): bars to the first touch of each move up (1) and down (-1), if any."""
    sizes = ", ".join(f"struct({s} AS side, {m}e0 AS pct)" for m in moves for s in (1, -1))
    rows = f"SELECT dataset_id, bar_index, entry, scale, bar_index + 1 AS at, side, pct FROM (SELECT dataset_id, bar_index, entry, scale, inline(array({sizes})) FROM {entries_}) e"
    short = lambda k: f"CASE WHEN s.side = 1 THEN (r.hi{k} - s.entry) / s.scale * 100 < s.pct ELSE (s.entry - r.lo{k}) / s.scale * 100 < s.pct END"
    for k in reversed(range(depth(horizon))):
        rows = f"SELECT s.dataset_id, s.bar_index, s.entry, s.scale, CASE WHEN coalesce({short(k)}, true) THEN s.at + {1 << k} ELSE s.at END AS at, s.side, s.pct FROM ({rows}) s LEFT JOIN (SELECT dataset_id, bar_index, hi{k}, lo{k} FROM {reach_}) r ON s.dataset_id = r.dataset_id AND s.at = r.bar_index"
    return f"SELECT t.dataset_id, t.bar_index, t.side, t.pct, CASE WHEN t.at <= least(t.bar_index + {horizon}, e.last) THEN t.at - t.bar_index END AS bars FROM ({rows}) t JOIN (SELECT dataset_id, bar_index, last FROM {entries_}) e ON t.dataset_id = e.dataset_id AND t.bar_index = e.bar_index"
