"""Features of uploaded columns: scores, directions, events, pivots, bands, pairs.

Each operator takes bars and the name of one or two columns; null is missing.
"""

from __future__ import annotations

from patternloom.operators.features import frame
from patternloom.plans.blocks import ORDER, bounded, carried, split
from patternloom.plans.dual import Dialect


def rolling_percentile(d: Dialect, bars: str, x: str, n: int = 100, least: int = 10) -> str:
    """Share of the last n values at or below the current; needs ``least`` values."""
    return split(d, bars, n - 1, lambda b: f"""
    SELECT dataset_id, bar_index, x, CASE WHEN x IS NOT NULL AND {d.size('w')} >= {least} THEN {d.count_in('w', 'v <= x')} * 100e0 / {d.size('w')} END AS percentile
    FROM (SELECT dataset_id, bar_index, {x} AS x, {d.items(x)} OVER ({frame(-(n - 1), 0)}) AS w FROM {b}) a""")


def rolling_z(d: Dialect, bars: str, x: str, n: int = 50, least: int = 10) -> str:
    """Score of the current value against the last n (population deviation; 0 where it vanishes)."""
    over = frame(-(n - 1), 0)
    return split(d, bars, n - 1, lambda b: f"""
    SELECT dataset_id, bar_index, x, CASE WHEN x IS NULL OR c < {least} THEN NULL WHEN s <= 1e-6 THEN 0e0 ELSE (x - m) / s END AS z
    FROM (SELECT dataset_id, bar_index, {x} AS x, count({x}) OVER ({over}) AS c, avg({x}) OVER ({over}) AS m, stddev_pop({x}) OVER ({over}) AS s FROM {b}) a""")


def _early_atr(d: Dialect, bars: str) -> str:
    """Mean of the true ranges there are, up to 14, from the first bar on."""
    return f"""
    SELECT *, avg(tr) OVER ({frame(-13, 0)}) AS atr
    FROM (SELECT *, CASE WHEN p IS NULL THEN high - low ELSE greatest(high - low, abs(high - p), abs(low - p)) END AS tr FROM (SELECT *, lag(close) OVER ({ORDER}) AS p FROM {bars}) a) b"""


early_atr = bounded(14)(_early_atr)


def quantiles(d: Dialect, bars: str, x: str) -> str:
    """Linear-interpolated 20, 50 and 80 per cent quantiles per dataset."""
    return f"SELECT dataset_id, {d.quantile(x, 0.2)} AS q20, {d.quantile(x, 0.5)} AS q50, {d.quantile(x, 0.8)} AS q80 FROM {bars} GROUP BY dataset_id"


def event_state(d: Dialect, bars: str, x: str) -> str:
    """Sign of a flag-like column as Off, Positive / On or Negative / On."""
    return f"SELECT dataset_id, bar_index, CASE WHEN {x} > 0 THEN 'Positive / On' WHEN {x} < 0 THEN 'Negative / On' WHEN {x} = 0 THEN 'Off' END AS state FROM {bars}"


def direction(d: Dialect, bars: str, x: str, k: int = 1) -> str:
    """Rising, Falling or Flat against k bars before, within a relative tolerance."""
    return split(d, bars, k, lambda b: f"""
    SELECT dataset_id, bar_index, x, CASE WHEN p IS NULL OR x IS NULL THEN NULL WHEN abs(x - p) <= greatest(abs(p) * 1e-10, 1e-12) THEN 'Flat' WHEN x > p THEN 'Rising' ELSE 'Falling' END AS direction
    FROM (SELECT dataset_id, bar_index, {x} AS x, lag({x}, {k}) OVER ({ORDER}) AS p FROM {b}) a""")


def slope(d: Dialect, bars: str, x: str, k: int = 5) -> str:
    """Change over k bars per bar in per cent, and its change (acceleration)."""
    return split(d, bars, k + 1, lambda b: f"""
    SELECT *, slope - lag(slope) OVER ({ORDER}) AS acceleration
    FROM (SELECT dataset_id, bar_index, (x - p) / greatest(abs(p), 1e-9) / {k} * 100 AS slope FROM (SELECT dataset_id, bar_index, {x} AS x, lag({x}, {k}) OVER ({ORDER}) AS p FROM {b}) a) b""")


def persistence(d: Dialect, bars: str, x: str) -> str:
    """Bars in a row with the same direction; a flat bar counts 1."""
    placed = carried(d, f"SELECT * FROM ({direction(d, bars, x)}) a WHERE direction IS NOT NULL", earlier=("last", "direction", "before"), place=("sum", "cast(1 AS bigint)"))
    runs = carried(d, placed, opened=("last", "CASE WHEN coalesce(direction <> earlier, true) THEN place END"))
    return f"SELECT dataset_id, bar_index, cast(CASE WHEN direction = 'Flat' THEN 1 ELSE place - opened + 1 END AS bigint) AS persistence FROM ({runs}) c"


def regime(d: Dialect, bars: str, x: str) -> str:
    """Low, Middle or High by rolling percentile, and the transition from the bar before."""
    zones = f"SELECT dataset_id, bar_index, CASE WHEN percentile <= 20 THEN 'Low' WHEN percentile >= 80 THEN 'High' ELSE 'Middle' END AS regime FROM ({rolling_percentile(d, bars, x)}) a WHERE percentile IS NOT NULL"
    return f"SELECT dataset_id, bar_index, regime, CASE WHEN p IS NULL OR regime = p THEN 'No transition' ELSE p || ' → ' || regime END AS transition FROM ({carried(d, zones, p=('last', 'regime', 'before'))}) c"


@bounded(15)
def price_level(d: Dialect, bars: str, x: str) -> str:
    """A price-like column against price: distances, relation, cross, touch, rejection, breakout."""
    return f"""
    SELECT dataset_id, bar_index, (close - x) / greatest(abs(x), 1e-9) * 100 AS distance_pct, CASE WHEN atr > 1e-12 THEN (close - x) / atr END AS distance_atr,
      CASE WHEN abs(close - x) <= tol THEN 'At' WHEN close > x THEN 'Above' ELSE 'Below' END AS relation,
      CASE WHEN pc <= px AND close > x THEN 'Crossed Above' WHEN pc >= px AND close < x THEN 'Crossed Below' ELSE 'No cross' END AS cross_event,
      CASE WHEN low - tol <= x AND high + tol >= x THEN 'Touched' ELSE 'No touch' END AS touch,
      CASE WHEN high > x + tol AND close < x - tol AND open < x THEN 'Rejected From Below' WHEN low < x - tol AND close > x + tol AND open > x THEN 'Rejected From Above' ELSE 'No rejection' END AS rejection,
      CASE WHEN pc <= px + tol AND close > x + tol THEN 'Breakout Above' WHEN pc >= px - tol AND close < x - tol THEN 'Breakout Below' ELSE 'No breakout' END AS breakout
    FROM (SELECT *, {x} AS x, lag(close) OVER ({ORDER}) AS pc, lag({x}) OVER ({ORDER}) AS px, greatest(0.05e0 * atr, 1e-5 * abs(close)) AS tol FROM ({_early_atr(d, bars)}) a) b WHERE x IS NOT NULL"""


@bounded(6)
def confirmed_pivots(d: Dialect, bars: str, x: str) -> str:
    """Three-left, three-right pivots of a column, known three bars later; ties disqualify."""
    lags = ", ".join(f"lag({x}, {k}) OVER ({ORDER}) AS x{k}" for k in range(7) if k)
    others = ["x0", "x1", "x2", "x4", "x5", "x6"]
    return f"""
    SELECT dataset_id, bar_index, bar_index - 3 AS pivot_index, close3 AS price, x3 AS value, CASE WHEN x3 > greatest({', '.join(others)}) THEN 'High' WHEN x3 < least({', '.join(others)}) THEN 'Low' END AS kind
    FROM (SELECT *, {x} AS x0, lag(close, 3) OVER ({ORDER}) AS close3, {lags} FROM {bars}) a WHERE bar_index >= 6 AND x3 IS NOT NULL"""


def divergence(d: Dialect, bars: str, x: str) -> str:
    """Consecutive confirmed pivots: price against the column (the low branch overrides)."""
    label = lambda a, b, kind: f"CASE WHEN price > pp AND value < pv THEN '{a}' WHEN price < pp AND value > pv THEN '{b}' WHEN price > pp AND value > pv THEN 'Convergent {kind}s Rising' WHEN price < pp AND value < pv THEN 'Convergent {kind}s Falling' ELSE 'None' END"
    own = lambda c: {f"{c}_{k.lower()}": ("last", f"CASE WHEN kind = '{k}' THEN {c} END", "before") for k in ("High", "Low")}
    seen = carried(d, f"SELECT * FROM ({confirmed_pivots(d, bars, x)}) p WHERE kind IS NOT NULL", **own("price"), **own("value"))
    before = lambda c: f"CASE kind WHEN 'High' THEN {c}_high ELSE {c}_low END"
    return f"""
    SELECT dataset_id, bar_index, CASE kind WHEN 'High' THEN {label('Bearish Divergence', 'Hidden Bearish', 'High')} ELSE {label('Hidden Bullish', 'Bullish Divergence', 'Low')} END AS divergence
    FROM (SELECT *, {before('price')} AS pp, {before('value')} AS pv FROM ({seen}) p) q WHERE pp IS NOT NULL"""


def recency(d: Dialect, events: str, event: str) -> str:
    """Bars since an event column was last active: Now, Within 3 bars, Within 10 bars or Not recent."""
    active = f"NOT ({event} LIKE 'No %' OR {event} LIKE 'None%' OR {event} LIKE 'Off%' OR {event} LIKE 'Flat%' OR {event} LIKE 'Middle%')"
    return f"""
    SELECT dataset_id, bar_index, CASE WHEN bar_index = seen THEN 'Now' WHEN bar_index - seen <= 3 THEN 'Within 3 bars' WHEN bar_index - seen <= 10 THEN 'Within 10 bars' ELSE 'Not recent' END AS recency
    FROM ({carried(d, events, seen=('last', f'CASE WHEN {active} THEN bar_index END'))}) f"""


@bounded(18)
def bands(d: Dialect, bars: str, upper: str, lower: str) -> str:
    """Width of a band in per cent and ATR, its expansion over three bars and acceleration."""
    return f"""
    SELECT dataset_id, bar_index, width_pct, width_atr, CASE WHEN p IS NULL THEN NULL WHEN abs(width_pct - p) <= greatest(abs(p) * 1e-10, 1e-12) THEN 'Flat' WHEN width_pct > p THEN 'Expanding' ELSE 'Compressing' END AS expansion,
      s - lag(s) OVER ({ORDER}) AS acceleration
    FROM (
      SELECT *, (width_pct - p) / greatest(abs(p), 1e-9) / 3 * 100 AS s
      FROM (
        SELECT *, lag(width_pct, 3) OVER ({ORDER}) AS p
        FROM (SELECT dataset_id, bar_index, ({upper} - {lower}) / greatest(abs(close), 1e-9) * 100 AS width_pct, CASE WHEN atr > 1e-12 THEN ({upper} - {lower}) / atr END AS width_atr FROM ({_early_atr(d, bars)}) a) b
      ) c
    ) e"""


def width_ratio(d: Dialect, bars: str, a: str, b: str) -> str:
    """Ratio of two widths; null where the denominator vanishes."""
    return f"SELECT dataset_id, bar_index, CASE WHEN abs({b}) > 1e-12 THEN ({a}) / ({b}) END AS width_ratio FROM {bars}"


def pair(d: Dialect, bars: str, a: str, b: str) -> str:
    """Relation, cross and spread score of two columns."""
    spread = f"(SELECT *, {a} - {b} AS spread FROM {bars}) s"
    scored = f"({rolling_z(d, spread, 'spread')}) y"
    before = split(d, scored, 1, lambda r: f"SELECT *, lag(x) OVER ({ORDER}) AS p FROM {r}")
    return f"""
    SELECT z.dataset_id, z.bar_index, CASE WHEN z.x > 0 THEN 'Above' WHEN z.x < 0 THEN 'Below' ELSE 'Equal' END AS relation,
      CASE WHEN p <= 0 AND z.x > 0 THEN 'Crossed Above' WHEN p >= 0 AND z.x < 0 THEN 'Crossed Below' ELSE 'No cross' END AS cross_event, z.z AS spread_z
    FROM ({before}) z WHERE z.x IS NOT NULL"""


def zone(d: Dialect, bars: str, x: str) -> str:
    """Low, Middle or High zone by the dataset's own 20 and 80 per cent quantiles."""
    return f"""
    SELECT v.dataset_id, v.bar_index, CASE WHEN v.{x} <= q.q20 THEN 'Low zone' WHEN v.{x} >= q.q80 THEN 'High zone' ELSE 'Middle' END AS zone
    FROM (SELECT * FROM {bars}) v JOIN ({quantiles(d, bars, x)}) q ON v.dataset_id = q.dataset_id"""


def change_score(d: Dialect, bars: str, x: str) -> str:
    """Rolling score of the first difference, for columns that drift."""
    changed = split(d, bars, 1, lambda b: f"SELECT *, {x} - lag({x}) OVER ({ORDER}) AS change FROM {b}")
    return rolling_z(d, f"({changed}) ch", "change")


def summary(d: Dialect, bars: str, x: str) -> str:
    """Facts of a column over all bars."""
    return f"SELECT dataset_id, count({x}) AS n, min({x}) AS lo, max({x}) AS hi, avg({x}) AS mean, stddev_pop({x}) AS sd, count(DISTINCT {x}) AS kinds FROM {bars} GROUP BY dataset_id"
