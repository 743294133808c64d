"""The catalogue of columns and features: definitions, categories, gating, thresholds, exit levels.

Every operator reads bars.  Columns come as a long relation (dataset_id, bar_index, label, value),
so one plan serves any number of columns.
"""

from __future__ import annotations

from patternloom.operators import features as fx
from patternloom.plans.dual import Dialect

#: Label, expression over the bars with bands, category.
COLUMNS = [
    ("open", "open", "Price"), ("high", "high", "Price"), ("low", "low", "Price"), ("close", "close", "Price"), ("volume", "volume", "Volume"), ("avg_value", "avg_value", "Custom"), ("users", "users", "Custom"), ("k", "k", "Custom"),
    ("session vwap", "avg_value", "VWAP"), ("upper band", "exit_bb_upper", "Bands"), ("lower band", "exit_bb_lower", "Bands"), ("band basis", "exit_bb_mid", "Bands"), ("bandwidth ratio", "bb_bandwidth", "Bands"), ("percent b", "bb_percent_b", "Bands"),
    ("direction flag", "cast(sign(close - open) AS double)", "Candle"), ("body %", "abs(close - open) / (CASE WHEN high = low THEN 1e-9 ELSE high - low END) * 100", "Candle"),
]
#: Roles by alias, looked up first.
ALIASES = {"rsi": "oscillator", "stochastic": "oscillator", "atr": "volatility", "obv": "cumulative", "volume": "volume", "close": "price"}
PRICE_CATEGORIES, VOLUME_CATEGORIES = ("Price", "Candle", "Bands"), ("VWAP", "Volume")
MULTI = "Multi-Timeframe"


def long_columns(d: Dialect, bars: str) -> str:
    """Rows (dataset_id, bar_index, label, category, value) of every column."""
    wide = f"SELECT b.*, q.exit_bb_upper, q.exit_bb_lower, q.exit_bb_mid, q.bb_bandwidth, q.bb_percent_b FROM (SELECT * FROM {bars}) b LEFT JOIN ({fx.bollinger(d, bars)}) q ON b.dataset_id = q.dataset_id AND b.bar_index = q.bar_index"
    if d.duck:
        values = ", ".join(f"('{label}', '{category}', cast({x} AS double))" for label, x, category in COLUMNS)
        return f"SELECT w.dataset_id, w.bar_index, v.label, v.category, v.value FROM ({wide}) w, LATERAL (SELECT * FROM (VALUES {values}) AS t(label, category, value)) v"
    structs = ", ".join(f"struct('{label}' AS label, '{category}' AS category, cast({x} AS double) AS value)" for label, x, category in COLUMNS)
    return f"SELECT dataset_id, bar_index, x.label, x.category, x.value FROM (SELECT dataset_id, bar_index, explode(array({structs})) AS x FROM ({wide}) w) e"


def catalogue(d: Dialect, bars: str, overrides: tuple = (("percent b", 0.0, 100.0), ("body %", 0.0, 100.0))) -> str:
    """Label, category, values and range of each column: the observed range, or the override's."""
    return f"""
    SELECT c.label, c.category, c.n, coalesce(o.lo, c.low) AS lo, coalesce(o.hi, c.high) AS hi, o.lo IS NOT NULL AS overridden
    FROM (SELECT label, category, count(value) AS n, min(value) AS low, max(value) AS high FROM ({long_columns(d, bars)}) l GROUP BY label, category) c LEFT JOIN {d.values([tuple(o) for o in overrides], 'label, lo, hi')} o ON c.label = o.label"""


def inferred(d: Dialect, bars: str, sample: int = 5000, long: str | None = None) -> str:
    """Role of each column of a dataset: by alias, then by its values and the words of its label.

    ``long`` names other columns than those of the catalogue.
    """
    word = lambda *ws: " OR ".join(f"concat(' ', label, ' ') LIKE '% {w} %'" for w in ws)
    alias = "CASE " + " ".join(f"WHEN label LIKE '%{a}%' THEN '{r}'" for a, r in ALIASES.items()) + " END"
    return f"""
    SELECT dataset_id, label, CASE WHEN kinds BETWEEN 2 AND 5 AND whole THEN 'binary-event' WHEN {word('upper')} THEN 'upper-band' WHEN {word('lower')} THEN 'lower-band' WHEN {word('basis', 'middle', 'midline', 'center')} THEN 'basis'
      WHEN {word('price', 'vwap', 'support', 'resistance', 'pivot', 'level', 'session')} THEN 'price-level' WHEN instr(label, '%') > 0 OR {word('pct', 'percent', 'ratio', 'bandwidth', 'return')} THEN 'percentage'
      WHEN n > 10 AND ((lo >= 0 AND hi <= 100) OR (lo >= -1 AND hi <= 1)) THEN 'oscillator' ELSE coalesce({alias}, 'generic-series') END AS role
    FROM (SELECT dataset_id, label, count(value) AS n, count(DISTINCT value) AS kinds, min(value) AS lo, max(value) AS hi, min(CASE WHEN value = floor(value) THEN 1 ELSE 0 END) = 1 AS whole FROM ({long or long_columns(d, bars)}) l WHERE bar_index < {sample} AND value IS NOT NULL GROUP BY dataset_id, label) a"""


#: Stored definitions: id, name, reviewed, updated.
DEFINITIONS = [("d1", "users", 1, 10), ("d2", "avg_value", 1, 20), ("d3", "avg_value", 1, 30), ("d4", "k", 0, 40), ("d5", "upper band", 1, 50), ("d5", "upper band", 1, 60)]


def resolved(d: Dialect, bars: str, explicit: tuple = (("open", "d1"),)) -> str:
    """Definition of each column: the explicit one, else the only reviewed one of its name, else inferred."""
    newest = f"SELECT id, name, max(reviewed) AS reviewed FROM {d.values(DEFINITIONS, 'id, name, reviewed, updated')} x GROUP BY id, name"
    one = f"SELECT name, max(id) AS id FROM ({newest}) r WHERE reviewed = 1 GROUP BY name HAVING count(*) = 1"
    return f"""
    SELECT i.dataset_id, i.label, coalesce(e.id, o.id, concat('inferred.', i.role)) AS definition
    FROM ({inferred(d, bars)}) i LEFT JOIN {d.values([tuple(e) for e in explicit], 'label, id')} e ON i.label = e.label LEFT JOIN ({one}) o ON i.label = o.name"""


def merged_definitions(d: Dialect, bars: str) -> str:
    """Definitions of stored and observed columns, merged: the newest of a key stays, confidence within 0 and 1."""
    by = "arg_max" if d.duck else "max_by"
    both = f"SELECT name, cast(updated AS double) AS updated, 'stored' AS origin, 1.5e0 AS confidence FROM {d.values(DEFINITIONS, 'id, name, reviewed, updated')} s UNION ALL SELECT label, 45e0, concat('observed ', category), n / 100e0 - 10 FROM ({catalogue(d, bars)}) c"
    return f"SELECT name, {by}(origin, updated) AS origin, greatest(0e0, least(1e0, {by}(confidence, updated))) AS confidence FROM ({both}) b GROUP BY name"


def gated(d: Dialect, bars: str) -> str:
    """Columns of each dataset that a search may use: price needs OHLC, volume needs volume, custom columns always."""
    has = f"SELECT dataset_id, count(open) = count(*) AND count(high) = count(*) AND count(low) = count(*) AND count(close) = count(*) AS ohlc, max(volume) > 0 AS vol FROM {bars} GROUP BY dataset_id"
    in_ = lambda xs: ", ".join(f"'{x}'" for x in xs)
    return f"""
    SELECT h.dataset_id, c.label, c.category, c.category = 'Custom' OR (h.ohlc AND (c.category IN ({in_(PRICE_CATEGORIES)}) OR (h.vol AND c.category IN ({in_(VOLUME_CATEGORIES)})))) AS allowed
    FROM ({has}) h CROSS JOIN (SELECT DISTINCT label, category FROM ({catalogue(d, bars)}) k) c"""


def categories(d: Dialect, bars: str) -> str:
    """Categories in use and the one that multi-timeframe columns need."""
    return f"SELECT category, sum(n) AS n FROM (SELECT category, count(*) AS n FROM ({catalogue(d, bars)}) c GROUP BY category UNION ALL SELECT '{MULTI}', cast(0 AS bigint)) u GROUP BY category"


def toggled(d: Dialect, bars: str, off: tuple = ("Volume",), labels_off: tuple = ("k",)) -> str:
    """The catalogue with whole categories and single columns switched off."""
    no = lambda xs: ", ".join(f"'{x}'" for x in xs)
    return f"SELECT label, category, category NOT IN ({no(off)}) AND label NOT IN ({no(labels_off)}) AS enabled FROM ({catalogue(d, bars)}) c"


def searched(d: Dialect, bars: str, text: str = "band") -> str:
    """Columns whose label or category holds a text, by category."""
    return f"SELECT category, count(*) AS n FROM ({catalogue(d, bars)}) c WHERE lower(label) LIKE '%{text}%' OR lower(category) LIKE '%{text}%' GROUP BY category"


def state_candidates(d: Dialect, bars: str, most: int = 4096) -> str:
    """Conditions of columns with two or three values in an evenly strided sample: a value each, or 0 and not 0."""
    picked = f"SELECT l.*, count(*) OVER (PARTITION BY dataset_id, label) AS n FROM ({long_columns(d, bars)}) l"
    kinds = f"SELECT dataset_id, label, value FROM ({picked}) p WHERE value IS NOT NULL AND bar_index % greatest(1, {d.div('n', str(most))}) = 0 GROUP BY dataset_id, label, value"
    return f"""
    SELECT dataset_id, label, CASE WHEN c = 2 AND zero AND value <> 0 THEN 'neq' ELSE 'eq' END AS op, CASE WHEN c = 2 AND zero THEN 0e0 ELSE value END AS value
    FROM (SELECT *, count(*) OVER (PARTITION BY dataset_id, label) AS c, max(CASE WHEN value = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY dataset_id, label) = 1 AS zero FROM ({kinds}) k) a WHERE c BETWEEN 2 AND 3"""


def manual(d: Dialect, bars: str) -> str:
    """Conditions from manual settings: thresholds give both sides, ranges 'between', a range four even cuts.

    The range override of each column is its catalogue range.
    """
    cuts = f"SELECT label, lo + (hi - lo) * k / 5 AS v FROM ({catalogue(d, bars)}) c CROSS JOIN {d.values([(k,) for k in (1, 2, 3, 4)], 'k')} g WHERE label NOT IN ('users', 'volume')"
    both = f"SELECT label, v FROM {d.values([('users', 2.0), ('users', 4.0)], 'label, v')} t UNION ALL {cuts}"
    return f"SELECT label, op, v AS lo, cast(NULL AS double) AS hi FROM ({both}) b CROSS JOIN {d.values([('lt',), ('gt',)], 'op')} o UNION ALL SELECT label, 'between', lo, hi FROM {d.values([('volume', 1.0, 3.0), ('volume', 3.0, 9.0)], 'label, lo, hi')} r"


def distinct_conditions(d: Dialect, bars: str) -> str:
    """Conditions of all datasets' thresholds and states, each once."""
    q = ", ".join(f"{d.quantile('value', x / 100)} AS q{x}" for x in (20, 80))
    cut = f"SELECT label, {q} FROM ({long_columns(d, bars)}) l WHERE value IS NOT NULL GROUP BY dataset_id, label"
    return f"SELECT label, op, v, count(*) AS made FROM (SELECT label, 'lt' AS op, floor(q20 * 10) AS v FROM ({cut}) a UNION ALL SELECT label, 'gt', floor(q80 * 10) FROM ({cut}) b UNION ALL SELECT label, op, floor(value * 10) FROM ({state_candidates(d, bars)}) s) c GROUP BY label, op, v"


def matchers(d: Dialect, bars: str) -> str:
    """Matches of one set of conditions under the three readings of a condition.

    The search compares by the catalogue's type; validation knows no numeric 'eq' and 'neq' (never
    true); the simulator goes by the value itself.
    """
    tests = [("users", "eq", 3.0), ("users", "neq", 3.0), ("users", "gte", 3.0), ("direction flag", "eq", 1.0), ("body %", "lt", 50.0), ("percent b", "gt", 80.0)]
    compare = "CASE t.op WHEN 'eq' THEN l.value = t.v WHEN 'neq' THEN l.value <> t.v WHEN 'gte' THEN l.value >= t.v WHEN 'lt' THEN l.value < t.v ELSE l.value > t.v END"
    return f"""
    SELECT l.dataset_id, l.label, t.op, r.reading, sum(CASE WHEN {compare} AND (r.reading <> 'validation' OR t.op NOT IN ('eq', 'neq')) THEN 1 ELSE 0 END) AS n
    FROM ({long_columns(d, bars)}) l JOIN {d.values(tests, 'label, op, v')} t ON l.label = t.label CROSS JOIN {d.values([('search',), ('validation',), ('simulator',)], 'reading')} r WHERE l.value IS NOT NULL GROUP BY l.dataset_id, l.label, t.op, r.reading"""


def exit_levels(d: Dialect, bars: str) -> str:
    """Price series that a stop or target may use, with their labels and how often they are known."""
    on = "b.dataset_id = {0}.dataset_id AND b.bar_index = {0}.bar_index"
    names = {"pdh": "p.exit_pdh", "pdl": "p.exit_pdl", "pd_mid": "p.exit_pd_mid", "box_high": "x.exit_box_high", "box_low": "x.exit_box_low", "box_mid": "x.exit_box_mid", "bb_upper": "q.exit_bb_upper", "bb_lower": "q.exit_bb_lower", "bb_mid": "q.exit_bb_mid", "vwap": "v.exit_vwap"}
    title = lambda n: " ".join(w.upper() if w in ("pdh", "pdl", "pd", "bb", "vwap") else w.capitalize() for w in n.split("_"))
    counts = ", ".join(f"count({x}) AS {n}" for n, x in names.items())
    known = f"SELECT b.dataset_id, {counts} FROM (SELECT * FROM {bars}) b LEFT JOIN ({fx.previous_day(d, bars)}) p ON {on.format('p')} LEFT JOIN ({fx.box(d, bars)}) x ON {on.format('x')} LEFT JOIN ({fx.bollinger(d, bars)}) q ON {on.format('q')} LEFT JOIN ({fx.vwap(d, bars)}) v ON {on.format('v')} GROUP BY b.dataset_id"
    return " UNION ALL ".join(f"SELECT dataset_id, '{title(n)}' AS label, {n} AS n FROM ({known}) k WHERE {n} > 0" for n in names)


def universe(d: Dialect, *bars: str) -> str:
    """Instruments over datasets of several intervals: rows, distinct columns, intervals and the links between them."""
    per = " UNION ALL ".join(f"SELECT dataset_id AS instrument, {k} AS interval_no, count(*) AS n FROM {b} GROUP BY dataset_id" for k, b in enumerate(bars))
    return f"SELECT instrument, sum(n) AS rows_total, count(DISTINCT interval_no) AS intervals, greatest(0, count(DISTINCT interval_no) - 1) AS hierarchy_links FROM ({per}) a GROUP BY instrument"


def selected_labels(d: Dialect, bars: str, ids: tuple = ("click", "view")) -> str:
    """Labels with values over the selected datasets, each once, and in how many of them."""
    return f"SELECT label, count(DISTINCT dataset_id) AS datasets FROM ({long_columns(d, bars)}) l WHERE value IS NOT NULL AND dataset_id IN ({', '.join(repr(i) for i in ids)}) GROUP BY label"
