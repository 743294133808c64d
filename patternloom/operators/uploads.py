"""Features of all uploaded columns at once, planned from the columns' roles and labels.

``uploads`` holds a row per bar with its columns as a map; ``roles`` a row per column of a dataset.
Which columns make bands, pairs, zones, values or changes is data: small tables of pairs are joined to
the bars by dataset, and a window runs over (dataset, pair) as if that were a dataset, in blocks of bars.
So one plan serves any number of columns and datasets.
"""

from __future__ import annotations

from patternloom.operators import catalogue as ct
from patternloom.operators import features as fx
from patternloom.operators.features import frame
from patternloom.operators.semantic import early_atr
from patternloom.plans.blocks import ORDER, carried, split
from patternloom.plans.dual import Dialect

#: Label and expression over the bars with their bands, box, previous day and volume balance, in column order.
COLUMNS = [
    ("avg_value", "avg_value"), ("users", "users"), ("k", "k"), ("session vwap", "avg_value"), ("upper band", "exit_bb_upper"), ("lower band", "exit_bb_lower"), ("band basis", "exit_bb_mid"),
    ("bandwidth ratio", "bb_bandwidth"), ("percent b", "bb_percent_b"), ("box upper band", "exit_box_high"), ("box lower band", "exit_box_low"), ("day upper", "exit_pdh"), ("day lower", "exit_pdl"),
    ("obv", "obv"), ("direction flag", "cast(sign(close - open) AS double)"), ("body %", "abs(close - open) / (CASE WHEN high = low THEN 1e-9 ELSE high - low END) * 100"),
]
#: Roles whose raw value drifts, roles that no pair compares, bounds on bands, ratios and pairs of a dataset.
NON_STATIONARY = ("price", "price-level", "upper-band", "lower-band", "basis", "cumulative")
UNPAIRED = ("price-level", "upper-band", "lower-band", "basis", "binary-event")
BANDS, RATIO_BANDS, PAIRS = 8, 4, 12
#: Ranges that definitions state.
RANGES = (("k", 0.0, 100.0),)
_EPS = "1e-12"


def _in(xs: tuple) -> str:
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


def wide(d: Dialect, bars: str) -> str:
    """Bars with the columns that the uploaded ones are made of, and the early ATR."""
    balance = carried(d, split(d, bars, 1, lambda b: f"SELECT *, lag(close) OVER ({ORDER}) AS p_ FROM {b}"), obv=("sum", "CASE WHEN close > p_ THEN volume WHEN close < p_ THEN -volume ELSE 0e0 END"))
    on = "b.dataset_id = {0}.dataset_id AND b.bar_index = {0}.bar_index"
    return f"""
    SELECT b.*, a.atr, q.exit_bb_upper, q.exit_bb_lower, q.exit_bb_mid, q.bb_bandwidth, q.bb_percent_b, x.exit_box_high, x.exit_box_low, p.exit_pdh, p.exit_pdl
    FROM ({balance}) b LEFT JOIN ({early_atr(d, bars)}) a ON {on.format('a')} LEFT JOIN ({fx.bollinger(d, bars)}) q ON {on.format('q')} LEFT JOIN ({fx.box(d, bars)}) x ON {on.format('x')} LEFT JOIN ({fx.previous_day(d, bars)}) p ON {on.format('p')}"""


def uploads(d: Dialect, bars: str) -> str:
    """A row per bar: close, ATR and ``vals``, the map of uploaded columns; what is not finite is null."""
    finite = lambda x: f"CASE WHEN abs(cast({x} AS double)) < double('infinity') THEN cast({x} AS double) END"
    return f"SELECT dataset_id, bar_index, close, atr, map({', '.join(f"'{label}', {finite(x)}" for label, x in COLUMNS)}) AS vals FROM ({wide(d, bars)}) w"


def roles(d: Dialect, uploads_: str) -> str:
    """Role, place and 20 and 80 per cent quantile of each column of a dataset that has values."""
    long = f"SELECT dataset_id, bar_index, label, value FROM (SELECT dataset_id, bar_index, explode(vals) AS (label, value) FROM {uploads_}) e"
    places = d.values([(label, k) for k, (label, _) in enumerate(COLUMNS)], "label, pos")
    return f"""
    SELECT i.dataset_id, i.label, p.pos, i.role, q.q20, q.q80 FROM ({ct.inferred(d, '', long=long)}) i JOIN {places} p ON i.label = p.label
    JOIN (SELECT dataset_id, label, {d.quantile('value', 0.2)} AS q20, {d.quantile('value', 0.8)} AS q80 FROM ({long}) v WHERE value IS NOT NULL GROUP BY dataset_id, label) q ON i.dataset_id = q.dataset_id AND i.label = q.label"""


def band_pairs(roles_: str) -> str:
    """Upper and lower columns of one label group (the label without the words of bands), numbered by place.

    A dataset's only upper and only lower column are a pair whatever their labels.
    """
    group = r"coalesce(nullif(trim(regexp_replace(regexp_replace(lower(label), r'\b(upper|lower|basis|middle|midline|band)\b', ' '), r'\s+', ' ')), ''), 'default')"
    side = lambda role: f"(SELECT dataset_id, label, pos, {group} AS grp, count(*) OVER (PARTITION BY dataset_id) AS alone FROM {roles_} WHERE role = '{role}')"
    return f"""
    SELECT * FROM (
      SELECT dataset_id, upper, lower, row_number() OVER (PARTITION BY dataset_id ORDER BY pos) AS pair_no FROM (
        SELECT u.dataset_id, u.label AS upper, u.pos, coalesce(min_by(l.label, l.pos) FILTER (WHERE l.grp = u.grp), min(l.label) FILTER (WHERE u.alone = 1 AND l.alone = 1)) AS lower
        FROM {side('upper-band')} u JOIN {side('lower-band')} l ON u.dataset_id = l.dataset_id GROUP BY u.dataset_id, u.label, u.pos
      ) a WHERE lower IS NOT NULL
    ) b WHERE pair_no <= {BANDS}"""


def _width(upper: str, lower: str) -> str:
    return f"CASE WHEN u.close <> 0 THEN (u.vals[{upper}] - u.vals[{lower}]) / abs(u.close) * 100 END"


def band_widths(uploads_: str, roles_: str) -> str:
    """Width of each band in per cent and ATR, and whether it expands over three bars."""
    widths = f"""(
      SELECT named_struct('ds', u.dataset_id, 'upper', p.upper, 'lower', p.lower) AS dataset_id, u.bar_index, {_width('p.upper', 'p.lower')} AS width_pct, CASE WHEN u.atr > {_EPS} THEN (u.vals[p.upper] - u.vals[p.lower]) / u.atr END AS width_atr
      FROM {uploads_} u JOIN ({band_pairs(roles_)}) p ON u.dataset_id = p.dataset_id) w"""
    moved = split(Dialect(), widths, 3, lambda b: f"""
      SELECT *, CASE WHEN width_pct - was > tol THEN 'Expanding' WHEN width_pct - was < -tol THEN 'Compressing' WHEN tol IS NOT NULL AND width_pct IS NOT NULL THEN 'Flat' END AS expansion
      FROM (SELECT *, CASE WHEN was IS NOT NULL THEN greatest(abs(was) * 1e-10, {_EPS}) END AS tol FROM (SELECT *, lag(width_pct, 3) OVER ({ORDER}) AS was FROM {b}) a) c""")
    return f"SELECT dataset_id.ds AS dataset_id, bar_index, dataset_id.upper AS upper, dataset_id.lower AS lower, width_pct, width_atr, expansion FROM ({moved}) m WHERE width_pct IS NOT NULL OR width_atr IS NOT NULL"


def width_ratios(uploads_: str, roles_: str) -> str:
    """Ratios of the widths of the first bands, each pair once."""
    b = f"({band_pairs(roles_)})"
    return f"""
    SELECT dataset_id, bar_index, a, b, width_a / width_b AS width_ratio FROM (
      SELECT u.dataset_id, u.bar_index, p.a, p.b, {_width('p.au', 'p.al')} AS width_a, {_width('p.bu', 'p.bl')} AS width_b FROM {uploads_} u JOIN (
        SELECT x.dataset_id, x.upper AS a, y.upper AS b, x.upper AS au, x.lower AS al, y.upper AS bu, y.lower AS bl FROM {b} x JOIN {b} y ON x.dataset_id = y.dataset_id AND x.pair_no < y.pair_no AND y.pair_no <= {RATIO_BANDS}
      ) p ON u.dataset_id = p.dataset_id
    ) w WHERE abs(width_b) > {_EPS} AND width_a IS NOT NULL"""


def series_pairs(roles_: str) -> str:
    """Columns that may be compared, two at a time in column order, the first of each dataset."""
    free = f"(SELECT * FROM {roles_} WHERE role NOT IN {_in(UNPAIRED)})"
    return f"""
    SELECT dataset_id, a, b FROM (
      SELECT x.dataset_id, x.label AS a, y.label AS b, row_number() OVER (PARTITION BY x.dataset_id ORDER BY x.pos, y.pos) AS pair_no FROM {free} x JOIN {free} y ON x.dataset_id = y.dataset_id AND x.pos < y.pos
    ) p WHERE pair_no <= {PAIRS}"""


def pair_relations(uploads_: str, roles_: str) -> str:
    """Relation, cross and its recency, and spread score (50 bars, at least 10) of each pair of columns."""
    spreads = f"(SELECT named_struct('ds', u.dataset_id, 'a', p.a, 'b', p.b) AS dataset_id, u.bar_index, u.vals[p.a] - u.vals[p.b] AS x FROM {uploads_} u JOIN ({series_pairs(roles_)}) p ON u.dataset_id = p.dataset_id) s"
    over = frame(-49, 0)
    scored = split(Dialect(), spreads, 49, lambda b: f"""
      SELECT dataset_id, bar_index, x, CASE WHEN was <= 0 AND x > 0 THEN 'up' WHEN was >= 0 AND x < 0 THEN 'down' END AS crossed, CASE WHEN x IS NULL OR c < 10 THEN NULL WHEN sd <= 1e-6 THEN 0e0 ELSE (x - m) / sd END AS spread_z
      FROM (SELECT *, lag(x) OVER ({ORDER}) AS was, count(x) OVER ({over}) AS c, avg(x) OVER ({over}) AS m, stddev_pop(x) OVER ({over}) AS sd FROM {b}) a""")
    seen = carried(Dialect(), scored, seen=("last", "CASE WHEN crossed IS NOT NULL THEN bar_index END"))
    return f"""
    SELECT dataset_id.ds AS dataset_id, bar_index, dataset_id.a AS a, dataset_id.b AS b, spread_z,
      CASE WHEN abs(x) <= {_EPS} THEN 'Equal' WHEN x > 0 THEN concat(dataset_id.a, ' above ', dataset_id.b) WHEN x < 0 THEN concat(dataset_id.a, ' below ', dataset_id.b) END AS relation,
      CASE crossed WHEN 'up' THEN concat(dataset_id.a, ' crossed above ', dataset_id.b) WHEN 'down' THEN concat(dataset_id.a, ' crossed below ', dataset_id.b) ELSE 'No cross' END AS cross_event,
      CASE WHEN bar_index = seen THEN 'Now' WHEN bar_index - seen <= 3 THEN 'Within 3 bars' WHEN bar_index - seen <= 10 THEN 'Within 10 bars' ELSE 'Not recent' END AS recency
    FROM ({seen}) r"""


def zones(uploads_: str, roles_: str, ranges: tuple = RANGES) -> str:
    """Low, Middle or High of each oscillator: by fifths of its stated range, else by its own quantiles."""
    return f"""
    SELECT u.dataset_id, u.bar_index, r.label, CASE WHEN u.vals[r.label] <= low THEN 'Low' WHEN u.vals[r.label] >= high THEN 'High' ELSE 'Middle' END AS zone
    FROM {uploads_} u JOIN (
      SELECT r.dataset_id, r.label, coalesce(g.lo + (g.hi - g.lo) * 0.2e0, r.q20) AS low, coalesce(g.lo + (g.hi - g.lo) * 0.8e0, r.q80) AS high
      FROM {roles_} r LEFT JOIN {Dialect().values([tuple(x) for x in ranges], 'label, lo, hi')} g ON r.label = g.label WHERE r.role = 'oscillator'
    ) r ON u.dataset_id = r.dataset_id WHERE u.vals[r.label] IS NOT NULL"""


def levels_or_changes(uploads_: str, roles_: str) -> str:
    """Each series by its own value where its role is stationary, else by the score of its change."""
    rows = f"""(
      SELECT named_struct('ds', u.dataset_id, 'label', r.label, 'steady', r.role NOT IN {_in(NON_STATIONARY)}) AS dataset_id, u.bar_index, u.vals[r.label] AS x
      FROM {uploads_} u JOIN (SELECT * FROM {roles_} WHERE role NOT IN {_in(UNPAIRED)}) r ON u.dataset_id = r.dataset_id) s"""
    over = frame(-49, 0)
    scored = split(Dialect(), rows, 50, lambda b: f"""
      SELECT *, CASE WHEN y IS NULL OR count(y) OVER ({over}) < 10 THEN NULL WHEN stddev_pop(y) OVER ({over}) <= 1e-6 THEN 0e0 ELSE (y - avg(y) OVER ({over})) / stddev_pop(y) OVER ({over}) END AS z
      FROM (SELECT *, x - lag(x) OVER ({ORDER}) AS y FROM {b}) a""")
    return f"SELECT dataset_id.ds AS dataset_id, bar_index, dataset_id.label AS label, CASE WHEN dataset_id.steady THEN 'value' ELSE 'change' END AS kind, CASE WHEN dataset_id.steady THEN x ELSE z END AS reading FROM ({scored}) m WHERE x IS NOT NULL"
