"""Conditions, candidate conjunctions, outcomes and their statistics.

Everything about a bar that a search needs is one row of one table (``evaluated``): the true
conditions as an array, and the outcomes at every horizon.  It comes from one pass of window
functions over one sort of the bars; all operators below read it.  A pattern is one to three
conditions; a bar's patterns are combinations of its own array, so there is no join of
conditions with each other.  Patterns are evaluated per target dataset by one aggregation,
whatever their number; pattern 0 holds on every bar and is the baseline.

The operators take the relation ``ev`` and return one SELECT.  ``registry`` binds it to the
cached table in Spark; the oracles build it in DuckDB from joins.  Operators marked ``stored``
are small tables (one row per target and pattern) that a run computes once and names in braces.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from math import comb

from patternloom.operators import features as fx
from patternloom.operators.features import frame
from patternloom.plans.blocks import split as in_blocks
from patternloom.plans.dual import SPARK, Dialect
from patternloom.sources.bars import ORDER, tick_bars

HORIZON = 12
#: Hold windows that are compared.
HORIZONS = (1, 2, 3, 5, 8, 12, 21, 34)
#: Move in per cent whose first touch within the horizon is kept.
TOUCHES = (10, 20, 40)
#: The conditions of the registered queries: column, operator, value.
CONDITIONS = [
    ("candle_direction", "=", "Up"), ("candle_direction", "=", "Down"), ("box_event", "=", "Breakout Up"), ("box_event", "=", "Breakout Down"), ("box_event", "=", "Inside Box"), ("rvol_bucket", "=", "High"),
    ("rvol_bucket", "=", "Low"), ("structure_state", "=", "Bullish"), ("structure_state", "=", "Bearish"), ("box_position", ">=", 80.0), ("box_position", "<", 20.0), ("candle_body_pct", "between", (40.0, 80.0)),
]
#: A pattern's id has one digit of this base per condition (its number plus one).
BASE = 21
#: Combinations that a search of depth three tests.
TESTS = sum(comb(len(CONDITIONS), k) for k in (1, 2, 3))
LEAST, WIN, LIFT, FINAL_LIFT, ADDED = 30, 52.0, 3.0, 5.0, 0.5
COST_PCT = 0.05
FOLDS = 4


def compiled(column: str, op: str, value) -> str:
    """SQL of one condition; a missing value never matches."""
    lit = lambda v: f"'{v}'" if isinstance(v, str) else f"{v}e0"
    if op == "between":
        return f"coalesce({column} >= {lit(value[0])} AND {column} <= {lit(value[1])}, false)"
    return f"coalesce({column} {op} {lit(value)}, false)"


def feature_row(d: Dialect, bars: str) -> str:
    """The features that the registered conditions use, one row per bar."""
    if d.duck:
        on = "a.dataset_id = {0}.dataset_id AND a.bar_index = {0}.bar_index"
        return f"""
        SELECT a.dataset_id, a.bar_index, a.candle_direction, a.candle_body_pct, b.box_event, b.box_position, v.rvol_bucket, s.structure_state
        FROM ({fx.candle(d, bars)}) a LEFT JOIN ({fx.box(d, bars)}) b ON {on.format('b')} LEFT JOIN ({fx.volume(d, bars)}) v ON {on.format('v')} LEFT JOIN ({fx.structure(d, bars)}) s ON {on.format('s')}"""
    columns = "dataset_id, bar_index, candle_direction, candle_body_pct, box_event, box_position, rvol_bucket, structure_state"
    return f"SELECT {columns} FROM ({in_blocks(d, f'({fx._structure(d, bars)}) s', 20, _boxed)}) f"


def _boxed(structure: str) -> str:
    """All columns of the bars and the same features by one pass of window functions."""
    return f"""
    SELECT *, abs(close - open) / rng * 100 AS candle_body_pct, CASE WHEN abs(close - open) < rng * 0.05e0 THEN 'Doji' WHEN close >= open THEN 'Up' ELSE 'Down' END AS candle_direction,
      CASE WHEN bar_index >= 20 THEN (close - box_low) / (CASE WHEN box_high = box_low THEN 1e-9 ELSE box_high - box_low END) * 100 END AS box_position,
      CASE WHEN bar_index >= 20 THEN CASE WHEN high > box_high AND close <= box_high THEN 'Failed Breakout Up' WHEN low < box_low AND close >= box_low THEN 'Failed Breakout Down' WHEN close > box_high THEN 'Breakout Up' WHEN close < box_low THEN 'Breakout Down' ELSE 'Inside Box' END END AS box_event,
      CASE WHEN rvol <= 0.5e0 THEN 'Low' WHEN rvol <= 1.5e0 THEN 'Normal' WHEN rvol <= 3 THEN 'High' ELSE 'Extreme' END AS rvol_bucket,
      CASE WHEN last_high_kind = 'HH' AND last_low_kind = 'HL' THEN 'Bullish' WHEN last_high_kind = 'LH' AND last_low_kind = 'LL' THEN 'Bearish' ELSE 'Range / Transition' END AS structure_state
    FROM (
      SELECT *, {fx.GUARD} AS rng, max(high) OVER ({frame(-20, -1)}) AS box_high, min(low) OVER ({frame(-20, -1)}) AS box_low,
        CASE WHEN bar_index < 20 THEN 1e0 WHEN avg(volume) OVER ({frame(-20, -1)}) > 0 THEN volume / avg(volume) OVER ({frame(-20, -1)}) ELSE 1e0 END AS rvol
      FROM {structure}
    ) w"""


_SCALE = "CASE WHEN abs(close) <= 1e-9 THEN 1e0 ELSE abs(close) END"


def evaluated(d: Dialect, bars: str) -> str:
    """One row per bar: its true conditions, and per horizon return, up and down excursion in per cent.

    ``dx`` is the change of price over ``HORIZON``; ``hu10`` ... the bars to the first touch of a
    move up, ``hd10`` ... of a move down, within ``HORIZON``; ``c`` the bars of the dataset.
    """
    if d.duck:
        return _evaluated_by_joins(d, bars)
    conds = ", ".join(f"CASE WHEN {compiled(*x)} THEN cast({k} AS bigint) END" for k, x in enumerate(CONDITIONS))
    over = ", ".join(f"lead(close, {h}) OVER ({ORDER}) AS x{h}, max(high) OVER ({frame(1, h)}) AS top{h}, min(low) OVER ({frame(1, h)}) AS low{h}" for h in HORIZONS)
    moves = ", ".join(f"(x{h} - close) / scale * 100 AS r{h}, CASE WHEN x{h} IS NOT NULL THEN (greatest(close, top{h}) - close) / scale * 100 END AS u{h}, CASE WHEN x{h} IS NOT NULL THEN (close - least(close, low{h})) / scale * 100 END AS w{h}" for h in HORIZONS)
    touch = ", ".join(f"nullif(array_position(transform(highs, v -> (v - close) / scale * 100 >= {t}e0), true), 0) AS hu{t}, nullif(array_position(transform(lows, v -> (close - v) / scale * 100 >= {t}e0), true), 0) AS hd{t}" for t in TOUCHES)
    windows = lambda b: f"""
        SELECT *, {over}, collect_list(high) OVER ({frame(1, HORIZON)}) AS highs, collect_list(low) OVER ({frame(1, HORIZON)}) AS lows, avg(close) OVER ({frame(-49, 0)}) AS sma
        FROM ({_boxed(b)}) f"""  # noqa: E731
    reached = in_blocks(d, f"({fx._structure(d, bars)}) s", 49, windows, ahead=max(HORIZONS))
    return f"""
    SELECT h.dataset_id, bar_index, ts_ms, close, c, market, conds, x{HORIZON} - close AS dx, {moves}, {touch}
    FROM (SELECT *, {_SCALE} AS scale, CASE WHEN bar_index >= 50 AND close < sma THEN 'bear' ELSE 'bull' END AS market, array_compact(array({conds})) AS conds FROM ({reached}) g) h
    JOIN (SELECT dataset_id, count(*) AS c FROM {bars} GROUP BY dataset_id) n ON h.dataset_id = n.dataset_id"""


def _evaluated_by_joins(d: Dialect, bars: str) -> str:
    """The same table for DuckDB: conditions from joined features, touches from a range join."""
    flags = ", ".join(f"CASE WHEN {compiled(*x)} THEN cast({k} AS bigint) END" for k, x in enumerate(CONDITIONS))
    window = lambda h: f"PARTITION BY dataset_id ORDER BY bar_index ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING"
    moves = ", ".join(f"(lead(close, {h}) OVER o - close) / s * 100 AS r{h}, CASE WHEN lead(close, {h}) OVER o IS NOT NULL THEN greatest(0e0, (max(high) OVER ({window(h)}) - close) / s * 100) END AS u{h}, CASE WHEN lead(close, {h}) OVER o IS NOT NULL THEN greatest(0e0, (close - min(low) OVER ({window(h)})) / s * 100) END AS w{h}" for h in HORIZONS)
    touches = ", ".join(f"min(b.bar_index - a.bar_index) FILTER (WHERE (b.high - a.close) / a.s * 100 >= {t}) AS hu{t}, min(b.bar_index - a.bar_index) FILTER (WHERE (a.close - b.low) / a.s * 100 >= {t}) AS hd{t}" for t in TOUCHES)
    return f"""
    WITH base AS MATERIALIZED (SELECT *, {_SCALE} AS s FROM {bars}),
    f AS (SELECT dataset_id, bar_index, list_filter([{flags}], lambda v: v IS NOT NULL) AS conds FROM ({feature_row(d, 'base')}) x),
    m AS (SELECT *, CASE WHEN bar_index >= 50 AND close < avg(close) OVER (PARTITION BY dataset_id ORDER BY bar_index ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) THEN 'bear' ELSE 'bull' END AS market, lead(close, {HORIZON}) OVER o - close AS dx, {moves}, count(*) OVER (PARTITION BY dataset_id) AS c FROM base WINDOW o AS (PARTITION BY dataset_id ORDER BY bar_index)),
    t AS (SELECT a.dataset_id, a.bar_index, {touches} FROM base a JOIN base b ON a.dataset_id = b.dataset_id AND b.bar_index > a.bar_index AND b.bar_index <= a.bar_index + {HORIZON} GROUP BY a.dataset_id, a.bar_index)
    SELECT m.dataset_id, m.bar_index, m.ts_ms, m.close, m.c, m.market, f.conds, m.dx, {', '.join(f'm.r{h}, m.u{h}, m.w{h}' for h in HORIZONS)}, {', '.join(f't.hu{t}, t.hd{t}' for t in TOUCHES)}
    FROM m JOIN f USING (dataset_id, bar_index) LEFT JOIN t USING (dataset_id, bar_index)"""


def matches(d: Dialect, ev: str) -> str:
    """Rows (dataset_id, bar_index, cond) of the conditions that hold."""
    return f"SELECT dataset_id, bar_index, {'unnest' if d.duck else 'explode'}(conds) AS cond FROM {ev}"


def matched(d: Dialect, ev: str, columns: str = "bar_index, ts_ms, c, market, dx, r12 AS ret, u12 AS up, w12 AS dn", full: bool = True) -> str:
    """Rows (dataset_id, pattern_id, columns) of all patterns of one to three conditions that hold, and pattern 0."""
    whole = f" WHERE r{HORIZON} IS NOT NULL" if full else ""
    if d.duck:
        s = f"(SELECT dataset_id, bar_index AS b, unnest(conds) + 1 AS k FROM {ev})"
        same = lambda x, y: f"{x}.dataset_id = {y}.dataset_id AND {x}.b = {y}.b AND {x}.k < {y}.k"
        return f"""
        SELECT e.dataset_id, p.pattern_id, {columns} FROM {ev} e JOIN (
          SELECT dataset_id, bar_index AS b, cast(0 AS bigint) AS pattern_id FROM {ev} UNION ALL SELECT dataset_id, b, k FROM {s} i
          UNION ALL SELECT x.dataset_id, x.b, x.k * {BASE} + y.k FROM {s} x JOIN {s} y ON {same('x', 'y')}
          UNION ALL SELECT x.dataset_id, x.b, (x.k * {BASE} + y.k) * {BASE} + z.k FROM {s} x JOIN {s} y ON {same('x', 'y')} JOIN {s} z ON {same('y', 'z')}
        ) p ON e.dataset_id = p.dataset_id AND e.bar_index = p.b{whole}"""
    third = f"transform(slice(conds, i + j + 3, size(conds)), z -> ((x + 1) * {BASE} + y + 1) * {BASE} + z + 1)"
    second = f"flatten(transform(slice(conds, i + 2, size(conds)), (y, j) -> concat(array((x + 1) * {BASE} + y + 1), {third})))"
    own = f"concat(array(cast(0 AS bigint)), flatten(transform(conds, (x, i) -> concat(array(x + 1), {second}))))"
    return f"SELECT dataset_id, explode({own}) AS pattern_id, {columns} FROM {ev}{whole}"


#: Operators whose result a run keeps, by name.
STORED: dict[str, Callable[..., str]] = {}


def stored(operator: Callable[..., str]) -> Callable[..., str]:
    """Let the operator name its kept table where ``ev`` is the table that a run is bound to."""

    @wraps(operator)
    def named(d: Dialect, ev: str) -> str:
        return f"SELECT * FROM {{{operator.__name__}}}" if ev == "{ev}" else operator(d, ev)

    STORED[operator.__name__] = operator
    return named


def depth(p: str) -> str:
    return f"CASE WHEN {p} < {BASE} THEN 1 WHEN {p} < {BASE * BASE} THEN 2 ELSE 3 END"


def digits(d: Dialect, p: str) -> list[str]:
    """The condition numbers plus one of a pattern, last first; 0 where there is none."""
    return [f"({p} % {BASE})", f"({d.div(p, str(BASE))} % {BASE})", d.div(p, str(BASE * BASE))]


def rates(d: Dialect, ev: str) -> str:
    """Per target and pattern: samples, rising and falling outcomes, means; pattern 0 included."""
    return f"""
    SELECT dataset_id, pattern_id, count(*) AS n, sum(CASE WHEN ret > 0 THEN 1 ELSE 0 END) AS ups, sum(CASE WHEN ret < 0 THEN 1 ELSE 0 END) AS downs, avg(ret) AS move, avg(up) AS up, avg(dn) AS dn, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms
    FROM ({matched(d, ev)}) m GROUP BY dataset_id, pattern_id"""


@stored
def evaluate(d: Dialect, ev: str) -> str:
    """Per target and pattern: samples, direction, win rate, baseline, lift, mean move, excursions, their ratio."""
    return f"""
    SELECT *, win_rate - baseline AS lift, CASE WHEN mae > 0 THEN mfe / mae WHEN mfe > 0 THEN NULL ELSE 0e0 END AS excursion_ratio
    FROM (
      SELECT dataset_id, pattern_id, n, ups, downs, move AS avg_move, first_ms, last_ms, CASE WHEN ups >= downs THEN 'bullish' ELSE 'bearish' END AS direction, greatest(ups, downs) * 100e0 / n AS win_rate,
        CASE WHEN ups >= downs THEN base_up ELSE base_dn END AS baseline, CASE WHEN ups >= downs THEN up ELSE dn END AS mfe, CASE WHEN ups >= downs THEN dn ELSE up END AS mae
      FROM (SELECT *, max(CASE WHEN pattern_id = 0 THEN ups * 100e0 / n END) OVER (PARTITION BY dataset_id) AS base_up, max(CASE WHEN pattern_id = 0 THEN downs * 100e0 / n END) OVER (PARTITION BY dataset_id) AS base_dn FROM ({rates(d, ev)}) r) a
      WHERE pattern_id > 0
    ) b"""


def baseline(d: Dialect, ev: str) -> str:
    """Share of rising and falling outcomes over all bars of a dataset."""
    return f"SELECT dataset_id, n, ups * 100e0 / n AS bullish, downs * 100e0 / n AS bearish FROM ({rates(d, ev)}) r WHERE pattern_id = 0"


def signed(d: Dialect, ev: str, columns: str = "bar_index, ts_ms, c, market, dx, r12 AS ret, u12 AS up, w12 AS dn, hu20, hd20", full: bool = True) -> str:
    """Matches with their return in the pattern's direction."""
    move = "CASE e.direction WHEN 'bullish' THEN m.ret ELSE -m.ret END AS move, " if full else ""
    return f"SELECT m.*, {move}e.direction, e.n, e.win_rate FROM ({matched(d, ev, columns, full)}) m JOIN ({evaluate(d, ev)}) e ON m.dataset_id = e.dataset_id AND m.pattern_id = e.pattern_id"


_WON = "CASE WHEN move > 0 THEN 100e0 ELSE 0e0 END"


def trades(d: Dialect, ev: str) -> str:
    """Outcome summary of each pattern's direction-adjusted moves."""
    return f"SELECT dataset_id, pattern_id, count(*) AS n, avg({_WON}) AS win_pct, avg(move) AS mean_move, {d.quantile('move', 0.5)} AS median_move, stddev_samp(move) AS sd FROM ({signed(d, ev)}) s GROUP BY dataset_id, pattern_id"


def picked(d: Dialect, rows: str) -> str:
    """Rows (dataset_id, pattern_id, h, bar_index, move) with a flag of those that do not overlap, chosen greedily.

    The next row is at least ``h`` bars after the last chosen.
    """
    key = "dataset_id, pattern_id, h"
    if d.duck:
        return f"""
        SELECT w.*, g.bar_index IS NOT NULL AS picked FROM ({rows}) w LEFT JOIN (
          WITH RECURSIVE a AS MATERIALIZED (SELECT {key}, bar_index FROM ({rows}) q), nxt AS MATERIALIZED (SELECT x.{key.replace(', ', ', x.')}, x.bar_index, y.bar_index AS follow FROM a x ASOF JOIN a y ON x.dataset_id = y.dataset_id AND x.pattern_id = y.pattern_id AND x.h = y.h AND x.bar_index + x.h <= y.bar_index),
          r AS (SELECT {key}, min(bar_index) AS bar_index FROM a GROUP BY {key} UNION ALL SELECT r.dataset_id, r.pattern_id, r.h, nxt.follow FROM r JOIN nxt ON r.dataset_id = nxt.dataset_id AND r.pattern_id = nxt.pattern_id AND r.h = nxt.h AND r.bar_index = nxt.bar_index)
          SELECT * FROM r
        ) g ON w.dataset_id = g.dataset_id AND w.pattern_id = g.pattern_id AND w.h = g.h AND w.bar_index = g.bar_index"""
    return _picked_in_blocks(rows, key)


#: Bars of a block, and blocks of a stretch, in which a choice is carried.
PICK_BLOCK, PICK_STRETCH = 1024, 1024


def _picked_in_blocks(rows: str, key: str) -> str:
    """The greedy choice carried from block to block.

    What a block does to the choice is a function of how many of its first bars are still covered by
    the row chosen before (0 to h - 1), so each block is a list of h numbers: the cover that it leaves to
    the next one.  Lists of a stretch of blocks are composed, stretches are gone through in order, then
    each block is chosen from with the cover that reaches it.  No list is longer than a block, a stretch
    or the number of stretches (one for a million bars).
    """
    size, many = PICK_BLOCK, PICK_STRETCH
    on = lambda a, b, *more: " AND ".join(f"{a}.{k} = {b}.{k}" for k in (*key.split(", "), *more))
    step = "(free, v) -> transform(free, a -> CASE WHEN v.bar_index >= a THEN v.bar_index + h ELSE a END)"
    blocks = f"""
    SELECT *, transform(aggregate(chain, transform(sequence(0L, h - 1), e -> block * {size} + e), {step}), a -> greatest(a - (block + 1) * {size}, 0L)) AS leaves
    FROM (SELECT {key}, bar_index DIV {size} AS block, sort_array(collect_list(struct(bar_index, move))) AS chain FROM ({rows}) q GROUP BY {key}, bar_index DIV {size}) b"""
    # cover reaches the next block only; a missing block has no rows and leaves none
    apply = "named_struct('at', b.block, 'cover', transform(s.cover, e -> b.leaves[cast(CASE WHEN b.block = s.at + 1 THEN e ELSE 0L END AS int)]))"
    stretches = f"""
    SELECT {key}, stretch, list, CASE WHEN done.at % {many} = {many - 1} THEN done.cover ELSE transform(done.cover, e -> 0L) END AS leaves
    FROM (SELECT *, aggregate(list, named_struct('at', stretch * {many} - 1, 'cover', sequence(0L, h - 1)), (s, b) -> {apply}) AS done
      FROM (SELECT {key}, block DIV {many} AS stretch, sort_array(collect_list(struct(block, leaves))) AS list FROM ({blocks}) b GROUP BY {key}, block DIV {many}) c) e"""
    walk = lambda items, at, first: f"aggregate({items}, named_struct('at', {first}, 'cover', {{0}}, 'got', cast(array() AS array<struct<at: bigint, cover: bigint>>)), (s, b) -> named_struct('at', b.{at}, 'cover', b.leaves[cast(CASE WHEN b.{at} = s.at + 1 THEN s.cover ELSE 0L END AS int)], 'got', concat(s.got, array(named_struct('at', b.{at}, 'cover', CASE WHEN b.{at} = s.at + 1 THEN s.cover ELSE 0L END)))), s -> s.got)"
    entered = f"SELECT {key}, inline({walk('list', 'stretch', '-1L').format('0L')}) AS (stretch, cover) FROM (SELECT {key}, sort_array(collect_list(struct(stretch, leaves))) AS list FROM ({stretches}) t GROUP BY {key}) u"
    reached = f"SELECT {key}, inline({walk('list', 'block', f'stretch * {many} - 1').format('cover')}) AS (block, cover) FROM (SELECT t.*, n.cover FROM ({stretches}) t JOIN ({entered}) n ON {on('t', 'n', 'stretch')}) v"
    choice = "named_struct('free', CASE WHEN v.bar_index >= s.free THEN v.bar_index + h ELSE s.free END, 'got', concat(s.got, array(v.bar_index >= s.free)))"
    flags = f"aggregate(chain, named_struct('free', block * {size} + cover, 'got', cast(array() AS array<boolean>)), (s, v) -> {choice}, s -> s.got)"
    marked = f"zip_with(chain, {flags}, (v, p) -> named_struct('bar_index', v.bar_index, 'move', v.move, 'picked', p))"
    return f"SELECT {key}, inline({marked}) FROM (SELECT b.*, r.cover FROM ({blocks}) b JOIN ({reached}) r ON {on('b', 'r', 'block')}) w"


def spaced(d: Dialect, ev: str) -> str:
    """Non-overlapping matches of each pattern at the horizon: number, first and last."""
    rows = f"SELECT dataset_id, pattern_id, cast({HORIZON} AS bigint) AS h, bar_index, ret AS move FROM ({matched(d, ev)}) m WHERE pattern_id > 0"
    return f"SELECT dataset_id, pattern_id, count(*) AS n, min(bar_index) AS first_at, max(bar_index) AS last_at FROM ({picked(d, rows)}) s WHERE picked GROUP BY dataset_id, pattern_id"


def drawdown(d: Dialect, ev: str) -> str:
    """Sample deviation and the largest fall of the cumulative move from its running peak."""
    over = "PARTITION BY dataset_id, pattern_id ORDER BY bar_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return f"""
    SELECT dataset_id, pattern_id, stddev_samp(move) AS sd, max(greatest(peak, 0e0) - total) AS max_drawdown
    FROM (SELECT *, max(total) OVER ({over}) AS peak FROM (SELECT *, sum(move) OVER ({over}) AS total FROM ({signed(d, ev)}) s) a) b GROUP BY dataset_id, pattern_id"""


_ENTERED = "SELECT m.dataset_id, m.pattern_id, m.bar_index, e.direction FROM ({0}) m JOIN ({1}) e ON m.dataset_id = e.dataset_id AND m.pattern_id = e.pattern_id WHERE m.bar_index < m.c - 1"


def profile(d: Dialect, ev: str) -> str:
    """Medians of move and excursions and the failure rate over all matches with a bar behind them (stored ``entries``)."""
    rows = _ENTERED.format(matched(d, ev, "bar_index, c", False), evaluate(d, ev))
    signed_ = "CASE h.direction WHEN 'bullish' THEN x.move ELSE -x.move END AS move, CASE h.direction WHEN 'bullish' THEN x.up ELSE x.dn END AS f, CASE h.direction WHEN 'bullish' THEN x.dn ELSE x.up END AS a"
    return f"SELECT dataset_id, pattern_id, count(*) AS n, {d.quantile('move', 0.5)} AS median_move, {d.quantile('f', 0.5)} AS median_mfe, {d.quantile('a', 0.5)} AS median_mae, avg(CASE WHEN move <= 0 THEN 100e0 ELSE 0e0 END) AS failure_rate FROM (SELECT h.dataset_id, h.pattern_id, {signed_} FROM ({rows}) h JOIN {{entries}} x ON h.dataset_id = x.dataset_id AND h.bar_index = x.bar_index) y GROUP BY dataset_id, pattern_id"


def first_touches(d: Dialect, ev: str) -> str:
    """Per pattern, target and stop: hit rates, bars to the target, and how often the target comes before the stop (stored ``touches``)."""
    rows = _ENTERED.format(matched(d, ev, "bar_index, c", False), evaluate(d, ev))
    side = "CASE h.direction WHEN 'bullish' THEN {0} ELSE {1} END"
    both = f"SELECT h.dataset_id, h.pattern_id, t.pct AS target, s.pct AS stop, t.bars AS hit, s.bars AS lost FROM ({rows}) h JOIN {{touches}} t ON h.dataset_id = t.dataset_id AND h.bar_index = t.bar_index AND t.side = {side.format(1, -1)} JOIN {{touches}} s ON h.dataset_id = s.dataset_id AND h.bar_index = s.bar_index AND s.side = {side.format(-1, 1)}"
    return f"SELECT dataset_id, pattern_id, target, stop, count(*) AS n, avg(CASE WHEN hit IS NOT NULL THEN 100e0 ELSE 0e0 END) AS target_rate, {d.quantile('hit', 0.5)} AS median_bars, avg(CASE WHEN lost IS NOT NULL THEN 100e0 ELSE 0e0 END) AS stop_rate, avg(CASE WHEN hit IS NOT NULL AND (lost IS NULL OR hit < lost) THEN 100e0 ELSE 0e0 END) AS target_first FROM ({both}) b GROUP BY dataset_id, pattern_id, target, stop"


def p_values(d: Dialect, ev: str) -> str:
    """Two-sided normal-tail p-value of each win rate against its baseline."""
    # fixed values: the published polynomial of the normal tail, to seven digits
    t = "(1 / (1 + 0.2316419e0 * z))"
    tail = f"0.3989423e0 * exp(-z * z / 2) * {t} * (0.3193815e0 + {t} * (-0.3565638e0 + {t} * (1.781478e0 + {t} * (-1.821256e0 + {t} * 1.330274e0))))"
    return f"SELECT dataset_id, pattern_id, n, win_rate, z, least(1e0, greatest(0e0, 2 * {tail})) AS p FROM (SELECT *, abs(win_rate / 100 - b) / sqrt(b * (1 - b) / n) AS z FROM (SELECT *, least(0.999999e0, greatest(0.000001e0, baseline / 100)) AS b FROM ({evaluate(d, ev)}) e) a) c"


def q_values(d: Dialect, ev: str, tests: int = TESTS) -> str:
    """Benjamini-Hochberg per target: p times the combinations tested over rank, monotone from the largest rank down, 1 at most."""
    return f"""
    SELECT dataset_id, pattern_id, p, least(min(raw) OVER (PARTITION BY dataset_id ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1e0) AS q
    FROM (SELECT *, p * {tests} / rk AS raw FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY p, pattern_id) AS rk FROM ({p_values(d, ev)}) a) b) c"""


def adds_value(d: Dialect, ev: str, margin: float = ADDED) -> str:
    """Whether a pattern beats each pattern with one condition less by the margin, in its own direction."""
    z, y, x = digits(d, "pattern_id")
    pair = f"[{y}, {z}]" if d.duck else f"array({y}, {z})"
    parts = f"{x} * {BASE} + {y}, {x} * {BASE} + {z}, {y} * {BASE} + {z}"
    parents = f"CASE WHEN pattern_id < {BASE * BASE} THEN {pair} ELSE {'[' + parts + ']' if d.duck else 'array(' + parts + ')'} END"
    e = evaluate(d, ev)
    return f"""
    SELECT c.dataset_id, c.pattern_id, c.win_rate, max(CASE c.direction WHEN 'bullish' THEN s.ups ELSE s.downs END * 100e0 / s.n) AS best_part, c.win_rate >= max(CASE c.direction WHEN 'bullish' THEN s.ups ELSE s.downs END * 100e0 / s.n) + {margin}e0 AS adds_value
    FROM (SELECT *, {'unnest' if d.duck else 'explode'}({parents}) AS parent FROM ({e}) w WHERE pattern_id >= {BASE}) c JOIN ({e}) s ON c.dataset_id = s.dataset_id AND c.parent = s.pattern_id GROUP BY c.dataset_id, c.pattern_id, c.win_rate"""


def similarity(d: Dialect, ev: str) -> str:
    """Jaccard similarity of the match sets of the single patterns of a target."""
    m = f"SELECT dataset_id, bar_index, cond FROM ({matches(d, ev)}) m"
    return f"""
    SELECT i.dataset_id, i.a, i.b, i.both * 1e0 / (x.n + y.n - i.both) AS jaccard
    FROM (SELECT l.dataset_id, l.cond AS a, r.cond AS b, count(*) AS both FROM ({m}) l JOIN ({m}) r ON l.dataset_id = r.dataset_id AND l.bar_index = r.bar_index AND l.cond < r.cond GROUP BY l.dataset_id, l.cond, r.cond) i
    JOIN (SELECT dataset_id, cond, count(*) AS n FROM ({m}) c GROUP BY dataset_id, cond) x ON i.dataset_id = x.dataset_id AND i.a = x.cond JOIN (SELECT dataset_id, cond, count(*) AS n FROM ({m}) c GROUP BY dataset_id, cond) y ON i.dataset_id = y.dataset_id AND i.b = y.cond"""


def signatures(d: Dialect, ev: str) -> str:
    """Size of each match set and the first pattern of its family that has the same set.

    Spark compares sets by two independent 64-bit hash sums of their bars, DuckDB by the sets.
    """
    same = "list(bar_index ORDER BY bar_index) AS own" if d.duck else "named_struct('a', sum(cast(xxhash64(bar_index) AS decimal(38, 0))), 'b', sum(cast(xxhash64('set', bar_index) AS decimal(38, 0)))) AS own"
    return f"SELECT dataset_id, pattern_id, n, min(pattern_id) OVER (PARTITION BY dataset_id, {family(d)}, n, own) AS first_pattern FROM (SELECT dataset_id, pattern_id, count(*) AS n, {same} FROM ({matched(d, ev)}) m WHERE pattern_id > 0 GROUP BY dataset_id, pattern_id) a"


def log10(x: str) -> str:
    return f"(ln({x}) / ln(10e0))"


def scores(d: Dialect, ev: str) -> str:
    """Rank score from sample size and margin over the baseline, and the confidence band."""
    return f"""
    SELECT *, 0.4e0 * {log10('greatest(10, n)')} / 4 + 0.6e0 * greatest(0e0, lift) / 25 AS score, {confidence('lift', 'n')} AS confidence FROM ({evaluate(d, ev)}) e"""


def confidence(lift: str, n: str) -> str:
    return f"""CASE WHEN {n} < 30 THEN 'low' WHEN {n} < 100 THEN CASE WHEN {lift} >= 15 THEN 'moderate' ELSE 'low' END
      WHEN {n} < 300 THEN CASE WHEN {lift} >= 12 THEN 'high' WHEN {lift} >= 8 THEN 'moderate' ELSE 'low' END
      WHEN {lift} >= 15 THEN 'very high' WHEN {lift} >= 10 THEN 'high' WHEN {lift} >= 6 THEN 'moderate' ELSE 'low' END"""


@stored
def judged(d: Dialect, ev: str) -> str:
    """Every pattern with the first search filter that rejects it ('kept' if none does).

    Of patterns of one family (the columns of their conditions) with one match set the first stays.
    """
    return f"""
    SELECT s.*, CASE WHEN s.n < {LEAST} THEN '1 few samples' WHEN s.win_rate < {WIN}e0 THEN '2 win rate' WHEN s.lift < {LIFT}e0 THEN '3 lift' WHEN NOT coalesce(v.adds_value, true) THEN '4 redundant condition' WHEN g.first_pattern < s.pattern_id THEN '5 duplicate' ELSE 'kept' END AS reason
    FROM ({scores(d, ev)}) s LEFT JOIN ({adds_value(d, ev)}) v ON s.dataset_id = v.dataset_id AND s.pattern_id = v.pattern_id JOIN ({signatures(d, ev)}) g ON s.dataset_id = g.dataset_id AND s.pattern_id = g.pattern_id"""


def filtered(d: Dialect, ev: str) -> str:
    """How many patterns each search filter rejects, in filter order."""
    return f"SELECT dataset_id, reason, count(*) AS patterns FROM ({judged(d, ev)}) r GROUP BY dataset_id, reason"


def kept(d: Dialect, ev: str) -> str:
    return f"SELECT * FROM ({judged(d, ev)}) j WHERE reason = 'kept'"


def ratio_search(d: Dialect, ev: str, grid: tuple[float, ...] = (0.0, 0.5, 1.0, 1.25, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0)) -> str:
    """Set score of each excursion-ratio threshold per target, and the first threshold of the best score.

    The score is the sample-weighted win rate over 50, by the log of all samples, plus a count term.
    """
    return f"""
    SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY floor(set_score * 1e9) DESC, threshold) = 1 AS best
    FROM (
      SELECT dataset_id, threshold, patterns, CASE WHEN patterns = 0 THEN -1e0 ELSE greatest(0e0, weighted / samples - 50) * {log10('greatest(10e0, samples)')} + 0.01e0 * patterns END AS set_score
      FROM (
        SELECT dataset_id, t AS threshold, cast(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS bigint) AS patterns, sum(CASE WHEN ok THEN win_rate * n ELSE 0e0 END) AS weighted, cast(sum(CASE WHEN ok THEN n ELSE 0 END) AS double) AS samples
        FROM (SELECT k.*, g.t, coalesce(k.excursion_ratio, 1e9) >= g.t AS ok FROM ({kept(d, ev)}) k CROSS JOIN {d.values([(x,) for x in grid], 't')} g) a GROUP BY dataset_id, t
      ) b
    ) c"""


# ------------------------------------------------------------------ horizons and the final rank


def horizon_rows(d: Dialect, ev: str) -> str:
    """Matches of the kept patterns at every horizon: h, bar, direction-adjusted move (null without an exit)."""
    columns = ", ".join(["bar_index", "c", *[f"r{h}" for h in HORIZONS]])
    pick = "CASE h " + " ".join(f"WHEN {h} THEN r{h}" for h in HORIZONS) + " END"
    return f"""
    SELECT dataset_id, pattern_id, h, bar_index, CASE direction WHEN 'bullish' THEN {pick} ELSE -({pick}) END AS move
    FROM (SELECT m.*, k.direction, hs.h FROM ({matched(d, ev, columns, False)}) m JOIN ({kept(d, ev)}) k ON m.dataset_id = k.dataset_id AND m.pattern_id = k.pattern_id CROSS JOIN {d.values([(h,) for h in HORIZONS], 'h')} hs WHERE m.bar_index < m.c - 1) a"""


def horizon_baselines(d: Dialect, ev: str) -> str:
    parts = " UNION ALL ".join(f"SELECT dataset_id, cast({h} AS bigint) AS h, avg(CASE WHEN r{h} > 0 THEN 100e0 ELSE 0e0 END) AS base_up, avg(CASE WHEN r{h} < 0 THEN 100e0 ELSE 0e0 END) AS base_dn FROM {ev} WHERE r{h} IS NOT NULL GROUP BY dataset_id" for h in HORIZONS)
    return f"SELECT * FROM ({parts}) b"


@stored
def horizons(d: Dialect, ev: str) -> str:
    """Each kept pattern at each horizon: all matches, non-overlapping trades net of costs, score and eligibility.

    ``choice`` is 1 for the recommended horizon: the best score of the eligible ones, of all if none is.
    """
    by = "PARTITION BY dataset_id, pattern_id, h"
    run = f"{by} ORDER BY bar_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    half = lambda side: f"coalesce(avg(CASE WHEN trade = 1 AND rk {side} floor(k / 2e0) THEN CASE WHEN net > 0 THEN 100e0 ELSE 0e0 END END), 0e0)"
    per = f"""
    SELECT dataset_id, pattern_id, h, count(*) AS n, avg({_WON}) AS win_rate, avg(move) AS mean_move, sum(trade) AS trades, avg(CASE WHEN trade = 1 THEN {_WON} END) AS trade_win, avg(CASE WHEN trade = 1 THEN net END) AS avg_net,
      coalesce(stddev_samp(CASE WHEN trade = 1 THEN net END), 0e0) AS sd, max(greatest(peak, 0e0) - total) AS max_drawdown, abs({half('<=')} - {half('>')}) AS delta
    FROM (SELECT *, max(total) OVER ({run}) AS peak FROM (SELECT *, sum(CASE WHEN trade = 1 THEN net ELSE 0e0 END) OVER ({run}) AS total, sum(trade) OVER ({run}) AS rk, sum(trade) OVER ({by}) AS k FROM (SELECT *, move - {COST_PCT}e0 AS net, CASE WHEN picked THEN 1 ELSE 0 END AS trade FROM ({picked(d, horizon_rows(d, ev))}) g WHERE move IS NOT NULL) a) b) c
    GROUP BY dataset_id, pattern_id, h"""
    return f"""
    SELECT *, row_number() OVER (PARTITION BY dataset_id, pattern_id ORDER BY CASE WHEN eligible THEN 0 ELSE 1 END, floor(rec * 1e9) DESC, h) AS choice
    FROM (
      SELECT *, trades >= {max(10, LEAST)} AND avg_net > 0 AND trade_win - base >= {FINAL_LIFT}e0 AND trade_win >= {WIN}e0 AS eligible,
        CASE WHEN sd > 1e-6 THEN avg_net / sd WHEN avg_net > 0 THEN avg_net / 0.01e0 ELSE avg_net END * sqrt(greatest(1, trades)) / (1 + delta / 20) / (1 + max_drawdown / greatest(0.05e0, abs(avg_net))) / sqrt(h) + greatest(0e0, trade_win - base) / 100 AS rec
      FROM (
        SELECT e.dataset_id, e.pattern_id, e.h, e.n, e.win_rate, e.mean_move, cast(e.trades AS bigint) AS trades, e.trade_win, e.avg_net, e.sd, e.max_drawdown, e.delta, k.direction, k.score AS first_score, CASE k.direction WHEN 'bullish' THEN b.base_up ELSE b.base_dn END AS base
        FROM ({per}) e JOIN ({horizon_baselines(d, ev)}) b ON e.dataset_id = b.dataset_id AND e.h = b.h JOIN ({kept(d, ev)}) k ON e.dataset_id = k.dataset_id AND e.pattern_id = k.pattern_id
      ) x
    ) y"""


@stored
def ranked(d: Dialect, ev: str) -> str:
    """Kept patterns at their recommended horizon, blended score, filtered, in rank order per target, with q."""
    p = p_of("win_rate", "n", "base")
    return f"""
    SELECT dataset_id, pattern_id, h, n, trades, win_rate, win_rate - base AS lift, mean_move, avg_net, score, rk, {confidence('(win_rate - base)', 'n')} AS confidence,
      least(min(p * {TESTS} / pk) OVER (PARTITION BY dataset_id ORDER BY pk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1e0) AS q
    FROM (
      SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY floor(score * 1e9) DESC, n DESC, pattern_id) AS rk, row_number() OVER (PARTITION BY dataset_id ORDER BY p, pattern_id) AS pk
      FROM (SELECT *, 0.5e0 * first_score + 0.5e0 * tanh(rec / 10) AS score, {p} AS p FROM ({horizons(d, ev)}) h WHERE choice = 1 AND n >= {LEAST} AND win_rate >= {WIN}e0 AND win_rate - base >= {FINAL_LIFT}e0) a
    ) b"""


def p_of(win: str, n: str, base: str) -> str:
    """The p-value of a win rate as one expression."""
    b = f"least(0.999999e0, greatest(0.000001e0, {base} / 100))"
    z = f"(abs({win} / 100 - {b}) / sqrt({b} * (1 - {b}) / {n}))"
    t = f"(1 / (1 + 0.2316419e0 * {z}))"
    return f"least(1e0, greatest(0e0, 2 * 0.3989423e0 * exp(-{z} * {z} / 2) * {t} * (0.3193815e0 + {t} * (-0.3565638e0 + {t} * (1.781478e0 + {t} * (-1.821256e0 + {t} * 1.330274e0))))))"


# ------------------------------------------------------------------ further statistics


def coverage(d: Dialect, ev: str) -> str:
    """First and last match, share of history and consistency of the two halves."""
    return f"""
    SELECT dataset_id, pattern_id, count(*) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, count(*) * 100e0 / max(c) AS share, avg(CASE WHEN rk <= floor(n / 2e0) AND move > 0 THEN 100e0 WHEN rk <= floor(n / 2e0) THEN 0e0 END) AS early_win, avg(CASE WHEN rk > floor(n / 2e0) AND move > 0 THEN 100e0 WHEN rk > floor(n / 2e0) THEN 0e0 END) AS late_win
    FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, pattern_id ORDER BY bar_index) AS rk FROM ({signed(d, ev)}) s) a GROUP BY dataset_id, pattern_id"""


def by_symbol(d: Dialect, ev: str) -> str:
    """Occurrence-weighted and equal-weighted results over datasets, and whether they agree broadly."""
    return f"""
    SELECT pattern_id, count(*) AS symbols, sum(win_rate * n) / sum(n) AS pooled, avg(win_rate) AS equal, sum(avg_move * n) / sum(n) AS pooled_move, avg(avg_move) AS equal_move, count(*) >= 2 AND max(win_rate) - min(win_rate) <= 10 AS broad
    FROM ({evaluate(d, ev)}) a GROUP BY pattern_id"""


def histogram(d: Dialect, ev: str, bins: int = 21) -> str:
    """Return histogram of each pattern in equal bins, the last one closed."""
    return f"""
    SELECT dataset_id, pattern_id, bin, count(*) AS n FROM (
      SELECT a.dataset_id, a.pattern_id, CASE WHEN hi = lo THEN cast(0 AS bigint) ELSE cast(least(floor((ret - lo) / ((hi - lo) / {bins})), {bins - 1}) AS bigint) END AS bin
      FROM ({matched(d, ev)}) a JOIN (SELECT dataset_id, pattern_id, min(ret) AS lo, max(ret) AS hi FROM ({matched(d, ev)}) m WHERE pattern_id > 0 GROUP BY dataset_id, pattern_id) b ON a.dataset_id = b.dataset_id AND a.pattern_id = b.pattern_id
    ) c GROUP BY dataset_id, pattern_id, bin"""


def wilson(d: Dialect, ev: str) -> str:
    """Wilson 95 per cent interval of the win rate, within 0 and 100."""
    z = "1.959963984540054e0"
    return f"SELECT dataset_id, pattern_id, n, greatest(0e0, 100 * (c - r)) AS lo, least(100e0, 100 * (c + r)) AS hi FROM (SELECT dataset_id, pattern_id, n, (p + {z} * {z} / (2 * n)) / (1 + {z} * {z} / n) AS c, {z} * sqrt(p * (1 - p) / n + {z} * {z} / (4e0 * n * n)) / (1 + {z} * {z} / n) AS r FROM (SELECT *, win_rate / 100 AS p FROM ({evaluate(d, ev)}) e) a) b"


def costs(d: Dialect, ev: str, bps: float = 5.0) -> str:
    """Direction-adjusted move after costs, how many times it covers them, its band, and whether it is economic."""
    gross = "CASE direction WHEN 'bullish' THEN avg_move ELSE -avg_move END"
    return f"SELECT dataset_id, pattern_id, gross - {bps / 100}e0 AS net_move, gross / {bps / 100}e0 AS cost_multiple, CASE WHEN gross / {bps / 100}e0 >= 5 THEN 'strong' WHEN gross / {bps / 100}e0 >= 3 THEN 'adequate' WHEN gross / {bps / 100}e0 >= 2 THEN 'thin' ELSE 'fails' END AS cushion, gross > {bps / 100}e0 AS economic FROM (SELECT *, {gross} AS gross FROM ({evaluate(d, ev)}) e) a"


def attribution(d: Dialect, ev: str) -> str:
    """Each dataset's share of matches, its occurrence-weighted win rate and move, and how many patterns pass."""
    return f"SELECT dataset_id, n, n * 100e0 / sum(n) OVER () AS share, win, move, passed, degraded FROM (SELECT e.dataset_id, sum(e.n) AS n, sum(e.win_rate * e.n) / sum(e.n) AS win, sum(e.avg_move * e.n) / sum(e.n) AS move, sum(CASE WHEN h.status = 'held' THEN 1 ELSE 0 END) AS passed, sum(CASE WHEN h.status = 'degraded' THEN 1 ELSE 0 END) AS degraded FROM ({evaluate(d, ev)}) e JOIN ({held_up(d, ev)}) h ON e.dataset_id = h.dataset_id AND e.pattern_id = h.pattern_id GROUP BY e.dataset_id) a"


def frozen(d: Dialect, ev: str, direction: str = "bullish") -> str:
    """Share of matches that move in a given direction."""
    return f"SELECT dataset_id, pattern_id, {'ups' if direction == 'bullish' else 'downs'} * 100e0 / n AS win_rate FROM ({rates(d, ev)}) m WHERE pattern_id > 0"


def thresholds(d: Dialect, bars: str, x: str) -> str:
    """20, 40, 60 and 80 per cent cuts of a column: the value at floor(n * q / 5) in order."""
    at = lambda q: f"max(CASE WHEN k = cast(floor(n * {q} / 5e0) AS bigint) + 1 THEN v END) AS q{20 * q}"
    return f"SELECT dataset_id, {', '.join(at(q) for q in (1, 2, 3, 4))} FROM (SELECT dataset_id, {x} AS v, row_number() OVER (PARTITION BY dataset_id ORDER BY {x}) AS k, count(*) OVER (PARTITION BY dataset_id) AS n FROM {bars} WHERE {x} IS NOT NULL) a GROUP BY dataset_id"


def screening(d: Dialect, bars: str) -> str:
    """Strength of columns: absolute correlation with the next bar's return."""
    cols = ["close", "volume", "avg_value", "users"]
    return f"""
    SELECT dataset_id, {', '.join(f'abs(corr({c}, nxt)) AS {c}_strength' for c in cols)}
    FROM (SELECT *, (lead(close) OVER ({ORDER}) - close) / ({_SCALE}) AS nxt FROM {bars}) a WHERE nxt IS NOT NULL GROUP BY dataset_id"""


def group_spread(d: Dialect, ev: str) -> str:
    """Strength of a categorical feature: spread of its groups' mean next returns."""
    return f"SELECT cond, max(m) - min(m) AS spread FROM (SELECT cond, dataset_id, avg(r1) AS m FROM (SELECT dataset_id, r1, {'unnest' if d.duck else 'explode'}(conds) AS cond FROM {ev}) a WHERE r1 IS NOT NULL GROUP BY cond, dataset_id) b GROUP BY cond"


# ------------------------------------------------------------------ validation


def split(d: Dialect, bars: str, share: float = 0.7) -> str:
    """Bars with their side of a chronological split."""
    return f"SELECT *, CASE WHEN bar_index < floor(c * {share}e0) THEN 'in' ELSE 'out' END AS side FROM (SELECT *, count(*) OVER (PARTITION BY dataset_id) AS c FROM {bars}) a"


@stored
def out_of_sample(d: Dialect, ev: str) -> str:
    """Each pattern inside and outside the discovery sample: samples, win rates, moves, excursion ratio, degradation."""
    on = lambda side, x: f"avg(CASE WHEN side = '{side}' THEN {x} END)"
    return f"""
    SELECT *, coalesce(n_out < 20 OR win_in - win_out > 10, true) AS degraded
    FROM (
      SELECT dataset_id, pattern_id, direction, cast(sum(CASE WHEN side = 'in' THEN 1 ELSE 0 END) AS bigint) AS n_in, cast(sum(CASE WHEN side = 'out' THEN 1 ELSE 0 END) AS bigint) AS n_out,
        coalesce({on('in', _WON)}, 0e0) AS win_in, coalesce({on('out', _WON)}, 0e0) AS win_out, coalesce({on('in', 'ret')}, 0e0) AS move_in, coalesce({on('out', 'ret')}, 0e0) AS move_out, coalesce(sum(CASE WHEN side = 'out' THEN dx END), 0e0) AS dx_out,
        {on('out', "CASE direction WHEN 'bullish' THEN up ELSE dn END")} AS mfe_out, {on('out', "CASE direction WHEN 'bullish' THEN dn ELSE up END")} AS mae_out
      FROM (SELECT *, CASE WHEN bar_index < floor(c * 0.7e0) THEN 'in' ELSE 'out' END AS side FROM ({signed(d, ev)}) s) a GROUP BY dataset_id, pattern_id, direction
    ) b"""


def walk_forward(d: Dialect, ev: str, folds: int = FOLDS) -> str:
    """Folds over the last 60 per cent of bars: samples, win rate, move and whether the fold passes.

    A fold passes with five matches, half of them won and a mean move in the pattern's direction;
    a fold without matches has win rate 0.
    """
    edge = lambda f: f"floor(c * (0.4e0 + 0.6e0 * ({f}) / {folds}))"
    return f"""
    SELECT *, n >= 5 AND win_rate >= 50 AND CASE direction WHEN 'bullish' THEN move > 0 ELSE move < 0 END AS passed
    FROM (
      SELECT e.dataset_id, e.pattern_id, e.direction, g.fold, coalesce(w.n, 0) AS n, coalesce(w.win_rate, 0e0) AS win_rate, coalesce(w.move, 0e0) AS move
      FROM ({evaluate(d, ev)}) e CROSS JOIN {d.values([(k,) for k in range(folds)], 'fold')} g
      LEFT JOIN (
        SELECT dataset_id, pattern_id, fold, count(*) AS n, avg({_WON}) AS win_rate, avg(ret) AS move
        FROM (SELECT *, cast(CASE {' '.join(f'WHEN bar_index < {edge(k + 1)} THEN {k}' for k in range(folds))} END AS bigint) AS fold FROM ({signed(d, ev)}) s WHERE bar_index >= {edge(0)}) a GROUP BY dataset_id, pattern_id, fold
      ) w ON e.dataset_id = w.dataset_id AND e.pattern_id = w.pattern_id AND g.fold = w.fold
    ) f"""


def per_condition(d: Dialect, ev: str) -> str:
    """Each condition of each pattern alone, inside and outside the sample, in the pattern's direction.

    All bars count; an exit beyond the last bar is a move of 0.
    """
    z, y, x = digits(d, "pattern_id")
    each = f"{'unnest' if d.duck else 'explode'}({'[' if d.duck else 'array('}{x}, {y}, {z}{']' if d.duck else ')'})"
    alone = f"""
    SELECT dataset_id, cond, side, count(*) AS n, sum(CASE WHEN ret > 0 THEN 1 ELSE 0 END) AS ups, sum(CASE WHEN ret < 0 THEN 1 ELSE 0 END) AS downs, sum(ret) AS total
    FROM (SELECT dataset_id, coalesce(r{HORIZON}, 0e0) AS ret, CASE WHEN bar_index < floor(c * 0.7e0) THEN 'in' ELSE 'out' END AS side, {'unnest' if d.duck else 'explode'}(conds) AS cond FROM {ev}) a GROUP BY dataset_id, cond, side"""
    return f"""
    SELECT p.dataset_id, p.pattern_id, p.k - 1 AS cond, a.side, a.n, CASE p.direction WHEN 'bullish' THEN a.ups ELSE a.downs END * 100e0 / a.n AS win_rate, a.total / a.n AS move
    FROM (SELECT * FROM (SELECT dataset_id, pattern_id, direction, {each} AS k FROM ({evaluate(d, ev)}) e) q WHERE k > 0) p JOIN ({alone}) a ON p.dataset_id = a.dataset_id AND p.k - 1 = a.cond"""


@stored
def held_up(d: Dialect, ev: str) -> str:
    """Whether each pattern held up out of sample and over the folds, and the first rule it failed."""
    f = f"SELECT dataset_id, pattern_id, cast(sum(CASE WHEN passed THEN 1 ELSE 0 END) AS bigint) AS passed, avg(win_rate) AS mean_win, min(win_rate) AS worst_win FROM ({walk_forward(d, ev)}) w GROUP BY dataset_id, pattern_id"
    direction = "CASE o.direction WHEN 'bullish' THEN o.move_out > 0 ELSE o.move_out < 0 END"
    return f"""
    SELECT *, CASE WHEN failure = 'none' THEN 'held' ELSE 'degraded' END AS status FROM (
      SELECT o.dataset_id, o.pattern_id, f.passed, f.mean_win, f.worst_win, CASE WHEN o.n_out < 20 THEN 'few occurrences' WHEN o.win_out <= 50 THEN 'win rate' WHEN o.degraded THEN 'degraded' WHEN NOT {direction} THEN 'direction' WHEN f.passed < ceil(0.75e0 * {FOLDS}) OR f.mean_win <= 50 THEN 'folds' ELSE 'none' END AS failure
      FROM ({out_of_sample(d, ev)}) o JOIN ({f}) f ON o.dataset_id = f.dataset_id AND o.pattern_id = f.pattern_id
    ) a"""


def market_side(d: Dialect, ev: str) -> str:
    """Win rate of each pattern in rising and falling markets (close against its 50-bar mean)."""
    return f"SELECT dataset_id, pattern_id, market, count(*) AS n, avg({_WON}) AS win_rate FROM ({signed(d, ev)}) s GROUP BY dataset_id, pattern_id, market"


def by_year(d: Dialect, ev: str) -> str:
    """Matches and win rate by calendar year (UTC)."""
    year = f"cast(year({d.local('ts_ms', 'UTC')}) AS bigint)"
    return f"SELECT dataset_id, pattern_id, y, count(*) AS n, avg({_WON}) AS win_rate FROM (SELECT *, {year} AS y FROM ({signed(d, ev)}) s) a GROUP BY dataset_id, pattern_id, y"


def survival(d: Dialect, ev: str) -> str:
    """Share of datasets on which a target's pattern is profitable out of sample, in the target's direction.

    The target counts where it has matches; another dataset counts always, without matches as a
    failure.  A pattern's direction is the target's; profit is the mean change of price.
    """
    o = out_of_sample(d, ev)
    good = "CASE t.direction WHEN 'bullish' THEN s.dx_out > 0 ELSE s.dx_out < 0 END"
    return f"""
    SELECT t.dataset_id, t.pattern_id, max(t.others) + max(CASE WHEN t.n_out > 0 THEN 1 ELSE 0 END) AS evaluated, sum(CASE WHEN s.n_out > 0 AND {good} THEN 1 ELSE 0 END) * 1e0 / (max(t.others) + max(CASE WHEN t.n_out > 0 THEN 1 ELSE 0 END)) AS survival
    FROM (SELECT o.*, k.others FROM ({o}) o CROSS JOIN (SELECT count(DISTINCT dataset_id) - 1 AS others FROM {ev}) k) t JOIN ({o}) s ON t.pattern_id = s.pattern_id WHERE t.others > 0 GROUP BY t.dataset_id, t.pattern_id"""


#: Bar intervals in minutes that a pattern is tried on, and its own.
INTERVALS, OWN_INTERVAL = (30, 60, 120, 240), 60


def interval_bars(d: Dialect, events: str) -> str:
    """Bars of all intervals as datasets of their own (``name@minutes``), with ``symbol`` and ``minutes``."""
    name = lambda m: f"concat(dataset_id, '@{m}')"
    return " UNION ALL ".join(f"SELECT dataset_id AS symbol, cast({m} AS bigint) AS minutes, {name(m)} AS dataset_id, bar_index, ts_ms, open, high, low, close, volume FROM ({tick_bars(d, events, m * 60_000)}) b{m}" for m in INTERVALS)


def rescaled(minutes: int, horizon: int = HORIZON) -> int:
    """The horizon in bars of another interval that is nearest in time, one at least (halves up)."""
    return max(1, int(horizon * OWN_INTERVAL / minutes + 0.5))


def on_intervals(bars: str) -> str:
    """Rows (dataset_id, minutes, bar_index, c, conds, dx) over bars of all intervals; ``dx`` spans the same time everywhere.

    Spark's text only.
    """
    spans = {m: rescaled(m) for m in INTERVALS}
    conds = ", ".join(f"CASE WHEN {compiled(*x)} THEN cast({k} AS bigint) END" for k, x in enumerate(CONDITIONS))
    exits = "CASE minutes " + " ".join(f"WHEN {m} THEN x{h}" for m, h in spans.items()) + " END"
    leads = ", ".join(f"lead(close, {h}) OVER ({ORDER}) AS x{h}" for h in sorted(set(spans.values())))
    reached = in_blocks(SPARK, f"({fx._structure(SPARK, bars)}) s", 20, lambda b: f"SELECT *, {leads} FROM ({_boxed(b)}) f", ahead=max(spans.values()))
    return f"SELECT g.dataset_id, minutes, bar_index, c, array_compact(array({conds})) AS conds, {exits} - close AS dx FROM ({reached}) g JOIN (SELECT dataset_id, count(*) AS c FROM {bars} GROUP BY dataset_id) n ON g.dataset_id = n.dataset_id"


def survival_on_intervals(d: Dialect, ev: str) -> str:
    """Share of datasets of all symbols and intervals, and of the other intervals alone, on which a pattern is profitable late.

    Every dataset counts, without late matches as a failure; the pattern's own counts where it has
    matches.  Reads the stored ``grid``.
    """
    late = f"SELECT dataset_id, minutes, pattern_id, count(*) AS n, sum(dx) AS dx FROM ({matched(d, '(SELECT * FROM {grid} WHERE dx IS NOT NULL AND bar_index >= floor(c * 0.7e0)) g', 'minutes, dx', False)}) m GROUP BY dataset_id, minutes, pattern_id"
    count = f"SELECT count(*) AS total, sum(CASE WHEN minutes <> {OWN_INTERVAL} THEN 1 ELSE 0 END) AS elsewhere FROM (SELECT DISTINCT dataset_id, minutes FROM {{grid}}) g"
    good = "CASE t.direction WHEN 'bullish' THEN s.dx > 0 ELSE s.dx < 0 END"
    return f"""
    SELECT dataset_id, pattern_id, others + own AS evaluated, good * 1e0 / nullif(others + own, 0) AS survival, elsewhere, good_elsewhere * 1e0 / nullif(elsewhere, 0) AS interval_survival
    FROM (
      SELECT t.dataset_id, t.pattern_id, max(k.total) - 1 AS others, max(k.elsewhere) AS elsewhere, coalesce(max(CASE WHEN s.dataset_id = concat(t.dataset_id, '@{OWN_INTERVAL}') THEN 1 END), 0) AS own,
        sum(CASE WHEN {good} THEN 1 ELSE 0 END) AS good, sum(CASE WHEN {good} AND s.minutes <> {OWN_INTERVAL} THEN 1 ELSE 0 END) AS good_elsewhere
      FROM ({evaluate(d, ev)}) t CROSS JOIN ({count}) k LEFT JOIN ({late}) s ON t.pattern_id = s.pattern_id GROUP BY t.dataset_id, t.pattern_id
    ) a"""


def validation_summary(d: Dialect, ev: str) -> str:
    """Pass rate and mean figures over all patterns; figures that are missing are left out."""
    return f"SELECT count(*) AS patterns, avg(CASE WHEN h.status = 'held' THEN 100e0 ELSE 0e0 END) AS pass_rate, avg(s.survival) AS mean_survival, avg(CASE WHEN o.mae_out > 0 THEN o.mfe_out / o.mae_out END) AS mean_ratio FROM ({held_up(d, ev)}) h LEFT JOIN ({survival(d, ev)}) s ON h.dataset_id = s.dataset_id AND h.pattern_id = s.pattern_id JOIN ({out_of_sample(d, ev)}) o ON h.dataset_id = o.dataset_id AND h.pattern_id = o.pattern_id"


# ------------------------------------------------------------------ selection

_EVENTS = [k + 1 for k, c in enumerate(CONDITIONS) if c[0].endswith("_event")]
_DIRECTIONS = [k + 1 for k, c in enumerate(CONDITIONS) if c[0] == "candle_direction"]
_NUMERIC = [k + 1 for k, c in enumerate(CONDITIONS) if not isinstance(c[2], str)]


def _count(d: Dialect, which: list[int], p: str = "pattern_id") -> str:
    return "(" + " + ".join(f"CASE WHEN {x} IN ({', '.join(map(str, which))}) THEN 1 ELSE 0 END" for x in digits(d, p)) + ")"


def priority(d: Dialect, ev: str) -> str:
    """Ranked patterns with the priority by which their families are presented."""
    categorical = [k + 1 for k in range(len(CONDITIONS)) if k + 1 not in _NUMERIC]
    return f"SELECT *, 15 + 8 * {_count(d, _EVENTS)} + 8 * {_count(d, _DIRECTIONS)} + 2 * {_count(d, categorical)} - 2 * {_count(d, _NUMERIC)} + least(20e0, greatest(0e0, score)) AS priority FROM ({ranked(d, ev)}) r"


def family(d: Dialect, p: str = "pattern_id") -> str:
    """The feature columns of a pattern, as one number."""
    columns = sorted({c[0] for c in CONDITIONS})
    place = lambda x: "CASE " + x + " " + " ".join(f"WHEN {k + 1} THEN {columns.index(c[0]) + 1}" for k, c in enumerate(CONDITIONS)) + " ELSE 0 END"
    bits = [f"cast(pow(10, {place(x)}) AS bigint)" for x in digits(d, p)]
    return "(" + " + ".join(bits) + ")"


def balanced(d: Dialect, ev: str, most: int = 100) -> str:
    """Round-robin over targets, tiers and families: every target and family is seen before any is seen twice.

    The event tier (an event condition and another one) and the general tier alternate; within a tier
    families come by priority, best first within a family.
    """
    tier = f"CASE WHEN {_count(d, _EVENTS)} > 0 AND pattern_id >= {BASE} THEN 0 ELSE 1 END"
    lead = "floor(first_value({0}) OVER (PARTITION BY dataset_id, tier, family ORDER BY rk) * 1e9)"
    return f"""
    SELECT dataset_id, pattern_id, tier, turn, pos FROM (
      SELECT *, row_number() OVER (ORDER BY place, dataset_id) AS pos
      FROM (
        SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY tier_place, tier) AS place
        FROM (
          SELECT *, row_number() OVER (PARTITION BY dataset_id, tier ORDER BY turn, lead_priority DESC, lead_score DESC, family) AS tier_place
          FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, tier, family ORDER BY rk) AS turn, {lead.format('priority')} AS lead_priority, {lead.format('score')} AS lead_score FROM (SELECT *, {tier} AS tier, {family(d)} AS family FROM ({priority(d, ev)}) p) a) b
        ) c
      ) e
    ) f WHERE pos <= {most}"""


def shortlist(d: Dialect, ev: str) -> str:
    """Patterns that held up, by research priority."""
    value = f"r.score + {log10('(r.n + 1)')} + {log10('(r.trades + 1)')} + greatest(0e0, r.lift) / 20 - 0.08e0 * ({depth('r.pattern_id')})"
    return f"SELECT dataset_id, pattern_id, priority, row_number() OVER (PARTITION BY dataset_id ORDER BY floor(priority * 1e9) DESC, pattern_id) AS pos FROM (SELECT r.dataset_id, r.pattern_id, {value} AS priority FROM ({ranked(d, ev)}) r JOIN ({held_up(d, ev)}) h ON r.dataset_id = h.dataset_id AND r.pattern_id = h.pattern_id WHERE h.status = 'held') a"


def finalised(d: Dialect, ev: str) -> str:
    """Final status and confidence: the selected cohort is tested, the rest is not; a failure lowers confidence."""
    return f"""
    SELECT r.dataset_id, r.pattern_id, coalesce(h.status, 'not-tested') AS final, CASE WHEN h.status = 'degraded' THEN 'low' ELSE r.confidence END AS confidence
    FROM ({ranked(d, ev)}) r LEFT JOIN ({balanced(d, ev)}) b ON r.dataset_id = b.dataset_id AND r.pattern_id = b.pattern_id LEFT JOIN ({held_up(d, ev)}) h ON b.dataset_id = h.dataset_id AND b.pattern_id = h.pattern_id"""
