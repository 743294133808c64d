"""Sessions with the daily ATR known at their open, and which dataset serves another as its daily or inner source."""

from __future__ import annotations

from itertools import combinations

from patternloom.operators import align
from patternloom.operators.catalogue import long_columns
from patternloom.operators.features import CLOSE, OPEN, clocked, frame
from patternloom.operators.patterns import feature_row
from patternloom.plans.blocks import ORDER, split
from patternloom.plans.dual import Dialect
from patternloom.sources.bars import DAY, facts

#: Bars of the daily ATR, fewest bars of a session, shortest interval of a daily source.
LENGTH, LEAST_BARS, DAILY_MS = 14, 6, 20 * 3_600_000


def daily_atr(d: Dialect, daily: str, n: int = LENGTH) -> str:
    """Mean true range of the last ``n`` daily bars, null before there are as many."""
    return split(d, daily, n, lambda b: f"""
    SELECT dataset_id, bar_index, ts_ms, CASE WHEN bar_index >= {n - 1} THEN avg(tr) OVER ({frame(-(n - 1), 0)}) END AS atr
    FROM (SELECT *, CASE WHEN p IS NULL THEN high - low ELSE greatest(high - low, abs(high - p), abs(low - p)) END AS tr FROM (SELECT *, lag(close) OVER ({ORDER}) AS p FROM {b}) a) c""")


def opens(d: Dialect, bars: str) -> str:
    """Regular-hours sessions: local day, first bar's time, bars."""
    local = f"cast({d.local('ts_ms', 'America/New_York')} AS date)"
    return f"SELECT dataset_id, {local} AS local_day, min(ts_ms) AS open_ms, count(*) AS bars FROM ({clocked(d, bars)}) c WHERE minute_of_day >= {OPEN} AND minute_of_day < {CLOSE} GROUP BY dataset_id, {local}"


def prior_atr(d: Dialect, bars: str, daily: str, strict: bool = False) -> str:
    """The last known daily ATR before each session's open.

    By default the daily bar must have started before the open; with ``strict`` it must have ended by then.
    """
    moment = f"ts_ms + {DAY} - 1" if strict else "ts_ms"
    over = "PARTITION BY dataset_id ORDER BY moment, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return f"""
    SELECT dataset_id, local_day, open_ms, bars, prior_atr FROM (
      SELECT *, {d.last('atr', over)} AS prior_atr
      FROM (
        SELECT dataset_id, local_day, open_ms, bars, open_ms AS moment, 0 AS side, cast(NULL AS double) AS atr FROM ({opens(d, bars)}) o
        UNION ALL SELECT dataset_id, cast(NULL AS date), cast(NULL AS bigint), cast(NULL AS bigint), {moment}, 1, atr FROM ({daily_atr(d, daily)}) a
      ) u
    ) w WHERE side = 0"""


def usable_sessions(d: Dialect, bars: str, daily: str) -> str:
    """Sessions of at least six bars with a known prior daily ATR, and the one that a strict reading knows."""
    return f"""
    SELECT p.dataset_id, p.open_ms, p.bars, p.prior_atr, s.prior_atr AS completed_atr
    FROM ({prior_atr(d, bars, daily)}) p JOIN ({prior_atr(d, bars, daily, True)}) s ON p.dataset_id = s.dataset_id AND p.local_day = s.local_day
    WHERE p.bars >= {LEAST_BARS} AND p.prior_atr IS NOT NULL"""


def measured(d: Dialect, **bars: str) -> str:
    """Instrument, dataset (``instrument@name``), rows and measured interval of bars of several intervals."""
    return " UNION ALL ".join(f"SELECT dataset_id AS instrument, concat(dataset_id, '@{name}') AS dataset_id, row_count, interval_ms FROM ({facts(d, b)}) f_{name}" for name, b in bars.items())


def source_choice(d: Dialect, measured_: str) -> str:
    """Per dataset: its instrument's shortest daily source (20 hours or more), and its shortest source below the dataset's interval."""
    least = lambda test: f"min(CASE WHEN {test} THEN interval_ms END)"
    return f"""
    SELECT m.dataset_id, m.interval_ms, min(CASE WHEN o.interval_ms = c.daily_ms THEN o.dataset_id END) AS daily_source, min(CASE WHEN o.interval_ms = c.inner_ms AND o.interval_ms < m.interval_ms THEN o.dataset_id END) AS inner_source
    FROM ({measured_}) m JOIN ({measured_}) o ON m.instrument = o.instrument
    JOIN (SELECT instrument, {least(f'interval_ms >= {DAILY_MS}')} AS daily_ms, min(interval_ms) AS inner_ms FROM ({measured_}) x GROUP BY instrument) c ON m.instrument = c.instrument
    GROUP BY m.dataset_id, m.interval_ms"""


def universe_totals(d: Dialect, measured_: str, bars: str) -> str:
    """One row: instruments, datasets, rows, links between adjacent intervals, distinct input columns."""
    return f"""
    SELECT i.instruments, i.datasets, i.rows_total, i.links, c.input_columns
    FROM (SELECT count(*) AS instruments, sum(n) AS datasets, sum(total) AS rows_total, sum(kinds - 1) AS links FROM (SELECT instrument, count(*) AS n, sum(row_count) AS total, count(DISTINCT interval_ms) AS kinds FROM ({measured_}) m GROUP BY instrument) g) i
    CROSS JOIN (SELECT count(DISTINCT label) AS input_columns FROM ({long_columns(d, bars)}) l WHERE value IS NOT NULL) c"""


#: Columns whose values are conditions in a confluence of intervals.
STATES = ("candle_direction", "box_event", "rvol_bucket", "structure_state")


def confluence(d: Dialect, lower: str, higher: str, lower_ms: int, higher_ms: int, least: int = 2) -> str:
    """Pairs of conditions on bars and their last completed higher bars: matches, distinct origins, whether these suffice."""
    wide = f"""
      SELECT f.dataset_id, {', '.join(f'f.{c} AS lo_{c}, h.{c} AS hi_{c}' for c in STATES)}
      FROM ({feature_row(d, lower)}) f JOIN ({align.completed(d, lower, higher, lower_ms, higher_ms)}) t ON f.dataset_id = t.dataset_id AND f.bar_index = t.bar_index LEFT JOIN ({feature_row(d, higher)}) h ON t.dataset_id = h.dataset_id AND t.src_index = h.bar_index"""
    cells = [(f"{side}_{c}", side) for side in ("lo", "hi") for c in STATES]
    pairs = [(f"concat('{x}=', {x})", f"concat('{y}=', {y})", len({a, b})) for (x, a), (y, b) in combinations(cells, 2)]
    if d.duck:
        given = lambda e: e[len("concat("):-1].replace(", ", " || ")
        values = ", ".join(f"({given(x)}, {given(y)}, cast({n} AS bigint))" for x, y, n in pairs)
        rows = f"SELECT w.dataset_id, v.a, v.b, v.origins FROM ({wide}) w, LATERAL (SELECT * FROM (VALUES {values}) AS t(a, b, origins)) v"
    else:
        rows = f"SELECT dataset_id, inline(array({', '.join(f'struct({x} AS a, {y} AS b, cast({n} AS bigint) AS origins)' for x, y, n in pairs)})) FROM ({wide}) w"
    return f"SELECT dataset_id, a, b, origins, origins >= {least} AS accepted, count(*) AS n FROM ({rows}) r WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY dataset_id, a, b, origins"
