"""Bar features: candles, structure, volume, volatility, levels, box, bands, trend, sequences.

Every feature of bar t uses bars up to t only.  Bounded frames run in blocks of bars, running
states are carried from block to block (``plans/blocks.py``), so a dataset is many tasks.
"""

from __future__ import annotations

from patternloom.plans.blocks import ORDER, bounded, carried, split
from patternloom.plans.dual import SPARK as _SPARK
from patternloom.plans.dual import Dialect


def frame(lo: int, hi: int) -> str:
    side = lambda k: "CURRENT ROW" if k == 0 else f"{abs(k)} {'PRECEDING' if k < 0 else 'FOLLOWING'}"
    return f"{ORDER} ROWS BETWEEN {side(lo)} AND {side(hi)}"


#: A range of zero counts as this.
GUARD = "CASE WHEN high = low THEN 1e-9 ELSE high - low END"


def candle(d: Dialect, bars: str) -> str:
    """Wick, body and range measures and the candle's direction (body under 5 per cent: Doji)."""
    return f"""
    SELECT dataset_id, bar_index, (high - greatest(open, close)) / rng * 100 AS candle_upper_wick_pct, (least(open, close) - low) / rng * 100 AS candle_lower_wick_pct,
      abs(close - open) / rng * 100 AS candle_body_pct, abs(close - open) AS candle_body_size, rng AS candle_range,
      CASE WHEN abs(close - open) < rng * 0.05e0 THEN 'Doji' WHEN close >= open THEN 'Up' ELSE 'Down' END AS candle_direction
    FROM (SELECT *, {GUARD} AS rng FROM {bars}) b"""


def pivots(d: Dialect, bars: str) -> str:
    """Two-left, two-right pivots, known two bars later: their prices, kinds and the levels so far."""
    lag = lambda c, k: f"lag({c}, {k}) OVER ({ORDER})"
    lags = ", ".join(f"{lag('high', k)} AS h{k}, {lag('low', k)} AS l{k}" for k in (1, 2, 3, 4))
    found = split(d, bars, 4, lambda b: f"""
        SELECT *, CASE WHEN h2 > h3 AND h2 >= h4 AND h2 > h1 AND h2 >= high THEN h2 END AS ph, CASE WHEN l2 < l3 AND l2 <= l4 AND l2 < l1 AND l2 <= low THEN l2 END AS pl
        FROM (SELECT *, {lags}, {lag('close', 1)} AS prev_close FROM {b}) a""")
    seen = carried(d, found, prev_high=("last", "ph", "before"), prev_low=("last", "pl", "before"), swing_high=("last", "ph"), swing_low=("last", "pl"))
    return f"""
    SELECT *, CASE WHEN ph IS NOT NULL THEN CASE WHEN prev_high IS NULL OR ph > prev_high THEN 'HH' ELSE 'LH' END END AS high_kind,
      CASE WHEN pl IS NOT NULL THEN CASE WHEN prev_low IS NULL OR pl > prev_low THEN 'HL' ELSE 'LL' END END AS low_kind
    FROM ({seen}) c"""


def structure(d: Dialect, bars: str) -> str:
    """Pivot event, swing sequence, state, break of structure, sweep and the last two structure events."""
    return f"""
    SELECT dataset_id, bar_index,
      CASE WHEN ph IS NOT NULL AND pl IS NOT NULL THEN 'Both' WHEN ph IS NOT NULL THEN 'Swing High' WHEN pl IS NOT NULL THEN 'Swing Low' ELSE 'None' END AS pivot_event,
      coalesce(low_kind, high_kind, 'None') AS swing_sequence,
      CASE WHEN last_high_kind = 'HH' AND last_low_kind = 'HL' THEN 'Bullish' WHEN last_high_kind = 'LH' AND last_low_kind = 'LL' THEN 'Bearish' ELSE 'Range / Transition' END AS structure_state,
      break_of_structure, liquidity_sweep, coalesce(before_event || ' → ' || last_event, 'None') AS structure_event_sequence
    FROM ({_structure(d, bars)}) s"""


def _structure(d: Dialect, bars: str) -> str:
    up = "prev_close <= swing_high AND close > swing_high"
    down = "prev_close >= swing_low AND close < swing_low"
    event = "coalesce(low_kind, high_kind)"
    seen = carried(d, pivots(d, bars), last_event=("last", event), earlier_event=("last", event, "before"), last_high_kind=("last", "high_kind"), last_low_kind=("last", "low_kind"))
    # the events of a bar are its high kind, then its low kind; the one before the last may lie in the same bar
    second = "CASE WHEN low_kind IS NOT NULL AND high_kind IS NOT NULL THEN high_kind WHEN low_kind IS NOT NULL OR high_kind IS NOT NULL THEN earlier_event END"
    held = carried(d, seen, before_held=("last", second))
    return f"""
    SELECT *, CASE WHEN low_kind IS NOT NULL AND high_kind IS NOT NULL THEN high_kind WHEN low_kind IS NOT NULL OR high_kind IS NOT NULL THEN earlier_event ELSE before_held END AS before_event,
      CASE WHEN {down} THEN 'Bearish BOS' WHEN {up} THEN 'Bullish BOS' ELSE 'None' END AS break_of_structure,
      CASE WHEN prev_close IS NOT NULL AND low < swing_low AND close > swing_low AND NOT ({down}) THEN 'Swept Low'
           WHEN prev_close IS NOT NULL AND high > swing_high AND close < swing_high AND NOT ({up}) THEN 'Swept High' ELSE 'None' END AS liquidity_sweep,
      coalesce({up}, false) AS bull_break, coalesce({down}, false) AS bear_break,
      coalesce(prev_close IS NOT NULL AND high > swing_high AND close < swing_high AND NOT ({up}), false) AS high_sweep,
      coalesce(prev_close IS NOT NULL AND low < swing_low AND close > swing_low AND NOT ({down}), false) AS low_sweep
    FROM ({held}) r"""


#: Session: zone, regular hours in minutes after midnight, start of the trading day.
ZONE, OPEN, CLOSE, DAY_START, OPENING = "America/New_York", 570, 960, 1080, 120


def clocked(d: Dialect, bars: str) -> str:
    """Bars with local minute, trading day (the local date shifted by the day's start) and its ordinal."""
    local, shifted = d.local("ts_ms", ZONE), d.local(f"ts_ms + {(1440 - DAY_START) * 60000}", ZONE)
    dated = f"(SELECT *, cast({shifted} AS date) AS day, cast(hour({local}) * 60 + minute({local}) AS bigint) AS minute_of_day FROM {bars}) a"
    changes = split(d, dated, 1, lambda b: f"SELECT *, coalesce(day <> lag(day) OVER ({ORDER}), true) AS changed FROM {b}")
    return carried(d, changes, day_no=("sum", "CASE WHEN changed THEN 1 ELSE 0 END"))


def calendar(d: Dialect, bars: str) -> str:
    """Half-hour bucket, session phase, weekday and month."""
    t = d.text_type
    stamp = lambda m: f"concat(cast({d.div(m, '60')} AS {t}), ':', lpad(cast(({m}) % 60 AS {t}), 2, '0'))"
    start = f"({OPEN} + {d.div(f'(minute_of_day - {OPEN})', '30')} * 30)"
    inside = f"minute_of_day >= {OPEN} AND minute_of_day < {CLOSE}"
    names = lambda xs, of: f"CASE {of} " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in xs) + " END"
    days = [(2, "Mon"), (3, "Tue"), (4, "Wed"), (5, "Thu"), (6, "Fri"), (1, "Mon"), (7, "Mon")]
    months = list(enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1))
    return f"""
    SELECT dataset_id, bar_index, CASE WHEN {inside} THEN concat({stamp(start)}, '-', {stamp(f'({start} + 30)')}) ELSE 'Outside RTH' END AS time_of_day,
      CASE WHEN NOT ({inside}) THEN 'Overnight' WHEN minute_of_day - {OPEN} < 30 THEN 'Open' WHEN minute_of_day - {OPEN} < 120 THEN 'Morning' WHEN minute_of_day - {OPEN} < 210 THEN 'Lunch'
           WHEN {CLOSE} - minute_of_day > 60 THEN 'Afternoon' ELSE 'Close' END AS session_phase,
      {names(days, d.weekday('day'))} AS weekday, {names(months, 'month(day)')} AS month
    FROM ({clocked(d, bars)}) c"""


def vwap(d: Dialect, bars: str) -> str:
    """Distance to and side of the volume-weighted price of the trading day so far."""
    over = "PARTITION BY dataset_id, day_no ORDER BY bar_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return f"""
    SELECT dataset_id, bar_index, CASE WHEN v <> 0 THEN (close - v) / v * 100 END AS vwap_distance_pct, CASE WHEN close >= v THEN 'Above' ELSE 'Below' END AS vwap_side, v AS exit_vwap
    FROM (
      SELECT *, CASE WHEN vs = 0 THEN (high + low + close) / 3 ELSE pv / vs END AS v
      FROM (SELECT *, sum((high + low + close) / 3 * volume) OVER ({over}) AS pv, sum(volume) OVER ({over}) AS vs FROM ({clocked(d, bars)}) c) a
    ) b"""


def days(d: Dialect, bars: str) -> str:
    """Trading days: ordinal, first and last bar, open, high, low, close and the day before's levels."""
    lo, hi = ("arg_min", "arg_max") if d.duck else ("min_by", "max_by")
    over = "PARTITION BY dataset_id ORDER BY day_no"
    return f"""
    SELECT *, lag(day_high) OVER ({over}) AS pdh, lag(day_low) OVER ({over}) AS pdl, lag(day_close) OVER ({over}) AS pdc
    FROM (
      SELECT dataset_id, cast(day_no AS bigint) AS day_no, min(bar_index) AS first_bar, max(bar_index) AS last_bar, {lo}(open, bar_index) AS day_open, max(high) AS day_high, min(low) AS day_low, {hi}(close, bar_index) AS day_close
      FROM ({clocked(d, bars)}) c GROUP BY dataset_id, day_no
    ) a"""


@bounded(20)
def volume(d: Dialect, bars: str) -> str:
    """Volume against the mean of the 20 bars before: relative volume and spike buckets."""
    return f"""
    SELECT dataset_id, bar_index, round(rvol, 4) AS rvol, CASE WHEN rvol <= 0.5e0 THEN 'Low' WHEN rvol <= 1.5e0 THEN 'Normal' WHEN rvol <= 3 THEN 'High' ELSE 'Extreme' END AS rvol_bucket,
      CASE WHEN rvol <= 1.5e0 THEN 'None' WHEN rvol <= 2.5e0 THEN 'Mild' ELSE 'Strong' END AS volume_spike
    FROM (
      SELECT *, CASE WHEN base > 0 THEN volume / base ELSE 1e0 END AS rvol
      FROM (SELECT *, CASE WHEN bar_index >= 20 THEN avg(volume) OVER ({frame(-20, -1)}) ELSE volume END AS base FROM {bars}) a
    ) b"""


def _ranges(d: Dialect, bars: str) -> str:
    """Bars with true range, 14-bar ATR (none before bar 14) and the ATR that stands in before."""
    return f"""
    SELECT *, coalesce(atr, tr) AS current_atr
    FROM (
      SELECT *, CASE WHEN bar_index >= 14 THEN avg(tr) OVER ({frame(-13, 0)}) END AS atr
      FROM (
        SELECT *, CASE WHEN prev IS NULL THEN {GUARD} ELSE greatest(high - low, abs(high - prev), abs(low - prev)) END AS tr
        FROM (SELECT *, lag(close) OVER ({ORDER}) AS prev FROM {bars}) a
      ) b
    ) c"""


ranges = bounded(14)(_ranges)


def atr(d: Dialect, bars: str) -> str:
    return f"SELECT dataset_id, bar_index, tr AS true_range, atr AS atr_14, current_atr FROM ({ranges(d, bars)}) r"


def atr_percentile(d: Dialect, bars: str) -> str:
    """Share of the ATR history, the current included, strictly below the current.

    The history grows, so a bar's rank is counted over a binary tree of its dataset's bars.  Bars of one
    tile are compared with each other; above tiles, a node's later half counts the smaller values of its
    earlier half by a running sum in the order of values.  That is n log n rows in all, and a node of very
    many bars is dealt out by ranges of values.
    """
    if d.duck:
        return f"""
        SELECT a.dataset_id, a.bar_index, sum(CASE WHEN b.atr < a.atr THEN 1e0 ELSE 0e0 END) / count(*) * 100 AS atr_percentile
        FROM ({ranges(d, bars)}) a JOIN ({ranges(d, bars)}) b ON a.dataset_id = b.dataset_id AND b.bar_index <= a.bar_index
        WHERE a.atr IS NOT NULL AND b.atr IS NOT NULL GROUP BY a.dataset_id, a.bar_index"""
    known = f"SELECT dataset_id, bar_index, bar_index - 14 AS place, atr AS x FROM ({ranges(d, bars)}) r WHERE atr IS NOT NULL"
    return f"SELECT dataset_id, bar_index, smaller * 1e0 / (place + 1) * 100 AS atr_percentile FROM ({earlier_smaller(known)}) c"


#: Bars of a tile whose values are compared directly, as a power of two; nodes of more bars than 2^17 are dealt out by values.
TILE_BITS, NODE_BITS, CUTS = 8, 16, 256


def earlier_smaller(rows: str) -> str:
    """Rows ``(dataset_id, bar_index, place, x)`` with ``smaller``, the number of earlier places of the dataset with a lesser ``x``.

    Spark's text only.  Places count from 0 without gaps; ``x`` is not null.
    """
    cuts = ", ".join(f"{k / CUTS}" for k in range(1, CUTS))
    facts = f"SELECT dataset_id, max(place) AS top, approx_percentile(x, array({cuts})) AS cuts FROM ({rows}) r GROUP BY dataset_id"
    tile = f"PARTITION BY dataset_id, shiftright(place, {TILE_BITS}) ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    own = f"SELECT *, cast(size(filter(w, v -> v < x)) AS bigint) AS here FROM (SELECT *, collect_list(x) OVER ({tile}) AS w FROM ({rows}) r) t"
    # a node of level k holds 2^(k+1) places; its earlier half has bit k off
    spread = f"""
    SELECT named_struct('own', r.dataset_id, 'level', k, 'node', shiftright(place, k + 1)) AS dataset_id, place, x, CASE WHEN k < {NODE_BITS} THEN 0 ELSE size(filter(cuts, v -> v < x)) END AS part, getbit(place, k) = 1 AS late
    FROM (SELECT r.*, f.cuts, explode(sequence({TILE_BITS}, 62)) AS k, f.top FROM ({rows}) r JOIN ({facts}) f ON r.dataset_id = f.dataset_id) r
    WHERE shiftleft(1L, k) <= top AND (getbit(place, k) = 1 OR shiftleft(shiftright(place, k) + 1, k) <= top)"""
    counted = carried(_SPARK, spread, at="struct(x, NOT late)", block="part", smaller=("sum", "CASE WHEN late THEN 0 ELSE 1 END"))
    above = f"SELECT dataset_id.own AS dataset_id, place, sum(smaller) AS above FROM ({counted}) c WHERE late GROUP BY dataset_id.own, place"
    return f"SELECT o.dataset_id, o.bar_index, o.place, o.here + coalesce(a.above, 0) AS smaller FROM ({own}) o LEFT JOIN ({above}) a ON o.dataset_id = a.dataset_id AND o.place = a.place"


@bounded(19)
def range_percentile(d: Dialect, bars: str) -> str:
    """Share of the last 20 raw ranges, the current included, strictly below the current."""
    return f"""
    SELECT dataset_id, bar_index, {d.count_in('w', 'v < r')} / 20e0 * 100 AS range_percentile
    FROM (SELECT dataset_id, bar_index, high - low AS r, {d.items('high - low')} OVER ({frame(-19, 0)}) AS w FROM {bars}) a WHERE bar_index >= 20"""


def _with_days(d: Dialect, bars: str) -> str:
    return f"""
    SELECT c.*, y.first_bar, y.day_open, y.pdh, y.pdl, y.pdc
    FROM (SELECT *, prev AS prev_close FROM ({clocked(d, f"({ranges(d, bars)}) rr")}) cc) c JOIN ({days(d, bars)}) y ON c.dataset_id = y.dataset_id AND c.day_no = y.day_no"""


_LEVEL_EVENT = """CASE WHEN pdh IS NULL THEN NULL WHEN high > pdh AND close < pdh THEN 'Swept PDH' WHEN low < pdl AND close > pdl THEN 'Swept PDL'
        WHEN prev_close <= pdh AND close > pdh THEN 'Broke PDH' WHEN prev_close >= pdl AND close < pdl THEN 'Broke PDL'
        WHEN prev_close > pdh AND close <= pdh THEN 'Reclaimed PDH' WHEN prev_close < pdl AND close >= pdl THEN 'Reclaimed PDL' ELSE 'None' END"""


def previous_day(d: Dialect, bars: str) -> str:
    """Location, state, ATR distances and level events against the previous trading day."""
    dist = lambda x: f"CASE WHEN current_atr > 1e-12 THEN (close - {x}) / current_atr END"
    return f"""
    SELECT dataset_id, bar_index, (close - pdl) / (CASE WHEN pdh = pdl THEN 1e-9 ELSE pdh - pdl END) * 100 AS prev_day_location,
      CASE WHEN close > pdh THEN 'Above PDH' WHEN close < pdl THEN 'Below PDL' ELSE 'Inside Previous Day' END AS prev_day_level_state,
      {dist('pdh')} AS distance_to_pdh_atr, {dist('pdl')} AS distance_to_pdl_atr, {dist('(pdh + pdl) / 2')} AS distance_to_pds_mid_atr, {_LEVEL_EVENT} AS prev_day_level_event,
      pdh AS exit_pdh, pdl AS exit_pdl, (pdh + pdl) / 2 AS exit_pd_mid
    FROM ({_with_days(d, bars)}) x WHERE pdh IS NOT NULL"""


def gap(d: Dialect, bars: str) -> str:
    """Opening gap of the trading day, the same for all of its bars."""
    return f"""
    SELECT dataset_id, bar_index, g AS gap_size_pct, CASE WHEN abs(g) < 0.05e0 THEN 'Flat' WHEN g > 0 THEN 'Up' ELSE 'Down' END AS gap_direction
    FROM (SELECT dataset_id, bar_index, CASE WHEN pdc > 0 THEN (day_open - pdc) / pdc * 100 ELSE 0e0 END AS g FROM ({_with_days(d, bars)}) x WHERE pdc IS NOT NULL) y"""


def previous_hour(d: Dialect, bars: str) -> str:
    """Location within the range of the hour before (earlier bars only)."""
    over = "PARTITION BY dataset_id ORDER BY ts_ms RANGE BETWEEN 3600000 PRECEDING AND 1 PRECEDING"
    seen = split(d, bars, 3_600_000, lambda b: f"SELECT *, max(high) OVER ({over}) AS ph, min(low) OVER ({over}) AS pl FROM {b}", at="ts_ms", unit=3_600_000)
    return f"""
    SELECT dataset_id, bar_index, (close - pl) / (CASE WHEN ph = pl THEN 1e-9 ELSE ph - pl END) * 100 AS prev_hour_location FROM ({seen}) a WHERE ph IS NOT NULL"""


@bounded(20)
def box(d: Dialect, bars: str) -> str:
    """Position in and events at the box of the 20 bars before."""
    return f"""
    SELECT dataset_id, bar_index, (close - bl) / (CASE WHEN bh = bl THEN 1e-9 ELSE bh - bl END) * 100 AS box_position,
      CASE WHEN high > bh AND close <= bh THEN 'Failed Breakout Up' WHEN low < bl AND close >= bl THEN 'Failed Breakout Down' WHEN close > bh THEN 'Breakout Up' WHEN close < bl THEN 'Breakout Down' ELSE 'Inside Box' END AS box_event,
      bh AS exit_box_high, bl AS exit_box_low, (bh + bl) / 2 AS exit_box_mid
    FROM (SELECT *, max(high) OVER ({frame(-20, -1)}) AS bh, min(low) OVER ({frame(-20, -1)}) AS bl FROM {bars}) a WHERE bar_index >= 20"""


def opening_range(d: Dialect, bars: str) -> str:
    """Range of the day's first regular minutes, known from the first bar after it to the close."""
    opening = f"minute_of_day >= {OPEN} AND minute_of_day < {OPEN + OPENING}"
    over = "PARTITION BY dataset_id, day_no"
    return f"""
    SELECT dataset_id, bar_index, CASE WHEN close > 0 THEN (hi - lo) / close * 100 ELSE 0e0 END AS or_size_pct,
      CASE WHEN high > hi AND low < lo THEN 'Both' WHEN high > hi THEN 'Up' WHEN low < lo THEN 'Down' ELSE 'None' END AS or_breakout, hi AS exit_or_high, lo AS exit_or_low, (hi + lo) / 2 AS exit_or_mid
    FROM (SELECT *, max(CASE WHEN {opening} THEN high END) OVER ({over}) AS hi, min(CASE WHEN {opening} THEN low END) OVER ({over}) AS lo FROM ({clocked(d, bars)}) c) a
    WHERE hi IS NOT NULL AND minute_of_day >= {OPEN + OPENING} AND minute_of_day < {CLOSE}"""


@bounded(118)
def bollinger(d: Dialect, bars: str) -> str:
    """20-bar bands of two population deviations: location, width, %B and the regime of the width."""
    return f"""
    SELECT dataset_id, bar_index, CASE WHEN close >= up THEN 'Above Upper' WHEN close >= mid THEN 'Upper Half' WHEN close >= dn THEN 'Lower Half' ELSE 'Below Lower' END AS bb_location, w AS bb_bandwidth,
      CASE WHEN up = dn THEN 50e0 ELSE (close - dn) / (up - dn) * 100 END AS bb_percent_b, p AS bb_bandwidth_percentile,
      CASE WHEN p <= 20 THEN 'Squeeze' WHEN p >= 80 THEN 'Expansion' ELSE 'Normal' END AS bb_regime, mid AS exit_bb_mid, up AS exit_bb_upper, dn AS exit_bb_lower
    FROM (
      SELECT *, {d.count_in('ws', 'v < w')} * 100e0 / {d.size('ws')} AS p
      FROM (
        SELECT *, {d.items('w')} OVER ({frame(-99, 0)}) AS ws
        FROM (
          SELECT *, round(CASE WHEN mid > 0 THEN (up - dn) / mid * 100 ELSE 0e0 END, 9) AS w
          FROM (
            SELECT *, m AS mid, m + 2 * s AS up, m - 2 * s AS dn
            FROM (SELECT *, avg(close) OVER ({frame(-19, 0)}) AS m, stddev_pop(close) OVER ({frame(-19, 0)}) AS s FROM {bars}) a WHERE bar_index >= 19
          ) b
        ) c
      ) e
    ) f"""


@bounded(34)
def trend(d: Dialect, bars: str) -> str:
    """Least-squares slope of 20 closes and its strength against the ATR."""
    return f"""
    SELECT dataset_id, bar_index, slope AS trend_slope, CASE WHEN x <= 0.05e0 THEN 'Choppy' WHEN x <= 0.12e0 THEN 'Weak' WHEN x <= 0.2e0 THEN 'Moderate' ELSE 'Strong' END AS trend_strength
    FROM (
      SELECT *, CASE WHEN current_atr > 1e-12 THEN abs(slope) / current_atr ELSE 0e0 END AS x
      FROM (SELECT *, {d.slope('close', 'cast(bar_index AS double)')} OVER ({frame(-19, 0)}) AS slope FROM ({_ranges(d, bars)}) r) a WHERE bar_index >= 20
    ) b"""


def streak(d: Dialect, bars: str) -> str:
    """Consecutive closes in one direction (an equal close counts as up)."""
    moves = split(d, bars, 1, lambda b: f"SELECT dataset_id, bar_index, close >= lag(close) OVER ({ORDER}) AS up FROM {b}")
    placed = carried(d, moves, earlier=("last", "up", "before"), place=("sum", "CASE WHEN up IS NOT NULL THEN 1 ELSE 0 END"))
    runs = carried(d, f"SELECT * FROM ({placed}) p WHERE up IS NOT NULL", opened=("last", "CASE WHEN coalesce(up <> earlier, true) THEN place END"))
    return f"""
    SELECT dataset_id, bar_index, n AS streak, CASE WHEN n <= 1 THEN 'Neutral' ELSE concat(CASE WHEN up THEN 'Up' ELSE 'Down' END, CASE WHEN n >= 3 THEN ' x3+' ELSE '' END) END AS consecutive_direction
    FROM (SELECT *, place - opened + 1 AS n FROM ({runs}) r) e"""


def sequences(d: Dialect, bars: str) -> str:
    """Sweep then reclaim, and break then retest, within one to five bars."""
    rows = f"""
        SELECT s.*, l.level_event,
          CASE WHEN x.box_event = 'Breakout Up' THEN x.exit_box_high WHEN l.level_event = 'Broke PDH' THEN l.pdh WHEN s.bull_break THEN s.swing_high END AS up_level,
          CASE WHEN x.box_event = 'Breakout Down' THEN x.exit_box_low WHEN l.level_event = 'Broke PDL' THEN l.pdl WHEN s.bear_break THEN s.swing_low END AS down_level
        FROM ({_structure(d, bars)}) s
        LEFT JOIN (SELECT dataset_id, bar_index, pdh, pdl, {_LEVEL_EVENT} AS level_event FROM ({_with_days(d, bars)}) w) l ON s.dataset_id = l.dataset_id AND s.bar_index = l.bar_index
        LEFT JOIN ({box(d, bars)}) x ON s.dataset_id = x.dataset_id AND s.bar_index = x.bar_index"""
    last = lambda test, x: ("last", f"CASE WHEN {test} THEN {x} END")
    seen = carried(
        d, rows, hs=last("high_sweep OR coalesce(level_event, '') = 'Swept PDH'", "bar_index"), ls=last("low_sweep OR coalesce(level_event, '') = 'Swept PDL'", "bar_index"),
        ub=last("up_level IS NOT NULL", "bar_index"), ul=("last", "up_level"), db=last("down_level IS NOT NULL", "bar_index"), dl=("last", "down_level"),
    )
    return f"""
    SELECT dataset_id, bar_index,
      CASE WHEN bar_index - hs BETWEEN 1 AND 5 AND (coalesce(level_event, '') = 'Reclaimed PDH' OR close > swing_high) THEN 'High Sweep → Reclaim'
           WHEN bar_index - ls BETWEEN 1 AND 5 AND (coalesce(level_event, '') = 'Reclaimed PDL' OR close > swing_low) THEN 'Low Sweep → Reclaim' ELSE 'None' END AS sweep_reclaim_sequence,
      CASE WHEN bar_index - ub BETWEEN 1 AND 5 AND low <= ul AND close >= ul THEN 'Bullish Break → Retest' WHEN bar_index - db BETWEEN 1 AND 5 AND high >= dl AND close <= dl THEN 'Bearish Break → Retest' ELSE 'None' END AS break_retest_sequence
    FROM ({seen}) b"""


def adjusted_box(d: Dialect, bars: str) -> str:
    """Previous-day box whose far side, after a gap beyond it, is replaced by the day's first confirmed pivot."""
    lo = "arg_min" if d.duck else "min_by"
    return f"""
    SELECT dataset_id, bar_index, state AS adjusted_pds_box_state, ah AS adjusted_pds_high, al AS adjusted_pds_low, (close - al) / (ah - al) * 100 AS adjusted_pds_box_position, CASE WHEN current_atr > 1e-12 THEN (close - (ah + al) / 2) / current_atr END AS distance_to_adjusted_pds_mid_atr,
      CASE WHEN high > ah AND close < ah THEN 'Rejected Upper' WHEN low < al AND close > al THEN 'Rejected Lower'
           WHEN bar_index > first_bar AND prev_close <= (ah + al) / 2 AND close > (ah + al) / 2 THEN 'Crossed Above Midpoint'
           WHEN bar_index > first_bar AND prev_close >= (ah + al) / 2 AND close < (ah + al) / 2 THEN 'Crossed Below Midpoint' ELSE 'None' END AS adjusted_pds_level_event
    FROM (
      SELECT w.*, CASE WHEN day_open > pdh AND w.bar_index >= v.high_at THEN v.high_pivot ELSE pdh END AS ah, CASE WHEN day_open < pdl AND w.bar_index >= v.low_at THEN v.low_pivot ELSE pdl END AS al,
        CASE WHEN day_open > pdh THEN CASE WHEN w.bar_index >= v.high_at THEN 'Gap Up Adjusted' ELSE 'Gap Up Awaiting Pivot' END
             WHEN day_open < pdl THEN CASE WHEN w.bar_index >= v.low_at THEN 'Gap Down Adjusted' ELSE 'Gap Down Awaiting Pivot' END ELSE 'Original Box' END AS state
      FROM ({_with_days(d, bars)}) w
      LEFT JOIN (
        SELECT p.dataset_id, c.day_no, min(CASE WHEN ph IS NOT NULL THEN p.bar_index END) AS high_at, {lo}(ph, CASE WHEN ph IS NOT NULL THEN p.bar_index END) AS high_pivot,
          min(CASE WHEN pl IS NOT NULL THEN p.bar_index END) AS low_at, {lo}(pl, CASE WHEN pl IS NOT NULL THEN p.bar_index END) AS low_pivot
        FROM ({pivots(d, bars)}) p JOIN ({clocked(d, bars)}) c ON p.dataset_id = c.dataset_id AND p.bar_index = c.bar_index JOIN ({days(d, bars)}) y ON y.dataset_id = c.dataset_id AND y.day_no = c.day_no
        WHERE p.bar_index - 4 >= y.first_bar GROUP BY p.dataset_id, c.day_no
      ) v ON w.dataset_id = v.dataset_id AND w.day_no = v.day_no
      WHERE pdh IS NOT NULL
    ) x WHERE ah > al"""
