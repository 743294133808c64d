"""Level-wise search over every feature column: conditions from the data, match sets as words of bits.

Features come as a long relation, so conditions are made for all columns by one plan: a category each,
the states of a column with two or three values, both sides of four quantile cuts of the others.  A
condition's matches are words of 64 bars.  A set of conditions is built only from sets that reach the
least sample (levels one to three); its matches are the bitwise and of its words, its counts are bit
counts, so no row per bar and pattern is ever made.  Rows of a chunk of 64 bars carry all frequent
conditions of that chunk; their number is that of conditions, not of bars.

Duplicates are settled within a family (the columns of a set): a set goes if an earlier one that was
kept has the same matches, or nearly (sizes within 10 per cent and a Jaccard similarity of 0.95).

Operators take ``long`` (features) and ``ev`` (outcomes); ``met``, ``frequent``, ``words``, ``pairs`` and ``found`` are stored tables.
Spark's text only but for ``long_features`` and ``made``; the oracles join rows of bars.
"""

from __future__ import annotations

from patternloom.operators import features as fx
from patternloom.plans.dual import Dialect

#: Matches that a set of up to two conditions, and a set of three, needs in the registered queries.
LEAST, LEAST_OF_THREE = 120, 400
#: Rows that the thresholds and the states of a column are taken from, at least.
CUT_ROWS, STATE_ROWS = 5000, 4096
#: Near-duplicates agree in size within this share and have this similarity at least.
SIZE_BAND, NEAR = 0.1, 0.95

#: Feature operator, numeric columns, categorical columns.
SOURCES = [
    (fx.candle, "candle_upper_wick_pct candle_lower_wick_pct candle_body_pct candle_body_size candle_range", "candle_direction"),
    (fx.structure, "", "pivot_event swing_sequence structure_state break_of_structure liquidity_sweep structure_event_sequence"),
    (fx.calendar, "", "time_of_day session_phase weekday month"),
    (fx.volume, "rvol", "rvol_bucket volume_spike"),
    (fx.range_percentile, "range_percentile", ""),
    (fx.previous_day, "prev_day_location distance_to_pdh_atr distance_to_pdl_atr", "prev_day_level_state prev_day_level_event"),
    (fx.vwap, "vwap_distance_pct", "vwap_side"),
    (fx.gap, "gap_size_pct", "gap_direction"),
    (fx.box, "box_position", "box_event"),
    (fx.bollinger, "bb_bandwidth bb_percent_b bb_bandwidth_percentile", "bb_location bb_regime"),
    (fx.trend, "trend_slope", "trend_strength"),
    (fx.streak, "", "consecutive_direction"),
    (lambda d, b: f"SELECT * FROM {b}", "avg_value users k", ""),
]
CUSTOM = ("avg_value", "users", "k")

# fixed values: features tied to one price regime, words that mark a column as relative, and words of raw levels and running totals
_RAW_FEATURES = ("candle_body_size", "candle_range", "trend_slope")
_RELATIVE = "pct percent percentage ratio relative normalized normalised distance change return roc zscore z?score percentile position location bandwidth"
_TOTALS = "obv|on balance volume|cumulative|cum volume|running total"
_LEVELS = "price|vwap|support|resistance|price level"
_WHOLE = "upper|lower|basis|middle|midline|upper band|lower band|bb upper|bb lower"
_BAND_WORDS = "upper|lower|basis", "band|level|price"
_SPANS = "session|daily|day|weekly|week|monthly|month"
_QUOTES = "open|high|low|close"


def drifting(d: Dialect, name: str, custom: str) -> str:
    """Whether a feature holds raw levels or totals, whose thresholds mean nothing elsewhere.

    ``name`` and ``custom`` (an uploaded column?) are expressions; a relative column never drifts.
    """
    text = f"regexp_replace(lower({name}), '[_-]+', ' '{', ' + chr(39) + 'g' + chr(39) if d.duck else ''})"
    has = (lambda p: f"regexp_matches({text}, '{p}')") if d.duck else (lambda p: f"{text} RLIKE r'{p}'")
    relative = "|".join(w.replace("?", " ?") for w in _RELATIVE.split())
    raw = [rf"\b({_TOTALS}|{_LEVELS})\b", f"^({_WHOLE})$", rf"\b({_BAND_WORDS[0]})\s+({_BAND_WORDS[1]})\b", rf"\b({_SPANS})\s+((average|avg)\s+)?({_QUOTES})\b", rf"\b({_QUOTES})\s+price\b"]
    return f"({name} IN ({', '.join(repr(f) for f in _RAW_FEATURES)}) OR ({custom} AND NOT {has(rf'\b({relative})\b')} AND ({' OR '.join(map(has, raw))})))"


def long_features(d: Dialect, bars: str) -> str:
    """Rows (dataset_id, bar_index, feature, num, txt) of the eligible features; numbers to six digits."""
    parts = []
    for k, (operator, numeric, text) in enumerate(SOURCES):
        cells = [(c, f"cast(floor({c} * 1e6 + 0.5e0) / 1e6 AS double)", f"cast(NULL AS {d.text_type})") for c in numeric.split()] + [(c, "cast(NULL AS double)", c) for c in text.split()]
        rows = f"({operator(d, bars)}) o{k}"
        if d.duck:
            values = ", ".join(f"('{c}', {n}, {t})" for c, n, t in cells)
            parts.append(f"SELECT o{k}.dataset_id, o{k}.bar_index, v.feature, v.num, v.txt FROM {rows}, LATERAL (SELECT * FROM (VALUES {values}) AS t(feature, num, txt)) v")
        else:
            parts.append(f"SELECT dataset_id, bar_index, inline(array({', '.join(f"struct('{c}' AS feature, {n} AS num, {t} AS txt)" for c, n, t in cells)})) FROM {rows}")
    custom = ", ".join(f"'{c}'" for c in CUSTOM)
    return f"SELECT dataset_id, bar_index, feature, num, txt FROM ({' UNION ALL '.join(parts)}) u WHERE (num IS NOT NULL OR txt IS NOT NULL) AND NOT {drifting(d, 'feature', f'feature IN ({custom})')}"


def made(d: Dialect, long: str) -> str:
    """Conditions (dataset_id, feature, cond, op, v, t) from the data; ``cond`` names one alike on every engine."""
    bars = f"(SELECT dataset_id, max(bar_index) + 1 AS c FROM {long} GROUP BY dataset_id) c"
    sampled = lambda most: f"SELECT l.dataset_id, l.feature, l.num FROM {long} l JOIN {bars} ON l.dataset_id = c.dataset_id WHERE num IS NOT NULL AND l.bar_index % greatest(1, {d.div('c.c', str(most))}) = 0"
    states = f"SELECT dataset_id, feature, num, row_number() OVER (PARTITION BY dataset_id, feature ORDER BY num) - 1 AS i, count(*) OVER (PARTITION BY dataset_id, feature) AS kinds, max(CASE WHEN num = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY dataset_id, feature) AS zero FROM (SELECT DISTINCT dataset_id, feature, num FROM ({sampled(STATE_ROWS)}) s) k"
    flags = f"kinds = 2 AND zero = 1"
    state = f"SELECT dataset_id, feature, CASE WHEN {flags} AND num <> 0 THEN 'neq' ELSE 'eq' END AS op, CASE WHEN {flags} THEN 0e0 ELSE num END AS v, CASE WHEN {flags} THEN 0 ELSE i END AS which FROM ({states}) a WHERE kinds IN (2, 3)"
    many = f"SELECT dataset_id, feature FROM (SELECT dataset_id, feature, count(DISTINCT num) AS kinds FROM ({sampled(STATE_ROWS)}) s GROUP BY dataset_id, feature) k WHERE kinds NOT IN (2, 3)"
    ordered = f"SELECT s.dataset_id, s.feature, s.num, row_number() OVER (PARTITION BY s.dataset_id, s.feature ORDER BY s.num) - 1 AS i, count(*) OVER (PARTITION BY s.dataset_id, s.feature) AS n FROM ({sampled(CUT_ROWS)}) s JOIN ({many}) m ON s.dataset_id = m.dataset_id AND s.feature = m.feature"
    cuts = f"SELECT dataset_id, feature, num AS v, min(q) AS which FROM ({ordered}) o CROSS JOIN {d.values([(q,) for q in (1, 2, 3, 4)], 'q')} g WHERE i = least(n - 1, floor(n * q / 5e0)) GROUP BY dataset_id, feature, num"
    numeric = f"SELECT dataset_id, feature, op, v, which FROM ({cuts}) c CROSS JOIN {d.values([('lt',), ('gt',)], 'op')} w UNION ALL SELECT dataset_id, feature, op, v, which FROM ({state}) e"
    t = d.text_type
    return f"""
    SELECT dataset_id, feature, concat(feature, ' ', op, ' ', cast(which AS {t})) AS cond, op, v, cast(NULL AS {t}) AS t FROM ({numeric}) n
    UNION ALL SELECT DISTINCT dataset_id, feature, concat(feature, ' is ', txt), 'is', cast(NULL AS double), txt FROM {long} l WHERE txt IS NOT NULL"""


HOLDS = "CASE m.op WHEN 'lt' THEN l.num < m.v WHEN 'gt' THEN l.num > m.v WHEN 'eq' THEN l.num = m.v WHEN 'neq' THEN l.num <> m.v ELSE l.txt = m.t END"


def met(long: str, ev: str, horizon: int = 12) -> str:
    """Rows (dataset_id, chunk, cond, feature, bits, ups, downs): a condition's matches among 64 bars, and the outcomes there."""
    bit = "shiftleft(1L, cast(bar_index % 64 AS int))"
    on = lambda test: f"coalesce(bit_or({bit}) FILTER (WHERE {test}), 0L)"
    outcome = f"SELECT dataset_id, bar_index DIV 64 AS chunk, {on(f'r{horizon} IS NOT NULL')} AS has, {on(f'r{horizon} > 0')} AS ups, {on(f'r{horizon} < 0')} AS downs FROM {ev} GROUP BY dataset_id, bar_index DIV 64"
    word = f"SELECT l.dataset_id, l.bar_index DIV 64 AS chunk, m.cond, m.feature, bit_or({bit}) AS bits FROM {long} l JOIN ({made(Dialect(), long)}) m ON l.dataset_id = m.dataset_id AND l.feature = m.feature WHERE {HOLDS} GROUP BY l.dataset_id, l.bar_index DIV 64, m.cond, m.feature"
    return f"SELECT w.dataset_id, w.chunk, w.cond, w.feature, w.bits & o.has AS bits, o.ups, o.downs FROM ({word}) w JOIN ({outcome}) o ON w.dataset_id = o.dataset_id AND w.chunk = o.chunk WHERE (w.bits & o.has) <> 0"


def frequent(met_: str, least: int = LEAST) -> str:
    """Conditions that reach the least sample, numbered in the order of their names, and their columns numbered."""
    often = f"SELECT dataset_id, cond, feature FROM {met_} GROUP BY dataset_id, cond, feature HAVING sum(bit_count(bits)) >= {least}"
    return f"SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY cond) AS id, dense_rank() OVER (PARTITION BY dataset_id ORDER BY feature) AS f FROM ({often}) o"


def words(met_: str, frequent_: str) -> str:
    """Rows (dataset_id, chunk, id, f, bits, ups, downs) of the frequent conditions."""
    return f"SELECT m.dataset_id, m.chunk, q.id, q.f, m.bits, m.ups, m.downs FROM {met_} m JOIN {frequent_} q ON m.dataset_id = q.dataset_id AND m.cond = q.cond"


_COUNTS = "sum(bit_count(bits)) AS n, sum(bit_count(bits & ups)) AS ups, sum(bit_count(bits & downs)) AS downs"


def _pair_words(words_: str) -> str:
    """Rows (dataset_id, chunk, a, b, fa, fb, bits, ups, downs) of the pairs that hold together in a chunk."""
    chunk = f"SELECT dataset_id, chunk, ups, downs, sort_array(collect_list(struct(id, f, bits))) AS list FROM {words_} GROUP BY dataset_id, chunk, ups, downs"
    both = f"SELECT dataset_id, chunk, ups, downs, x, explode(slice(list, i + 2, size(list))) AS y FROM (SELECT *, posexplode(list) AS (i, x) FROM ({chunk}) c) f"
    return f"SELECT dataset_id, chunk, x.id AS a, y.id AS b, x.f AS fa, y.f AS fb, x.bits & y.bits AS bits, ups, downs FROM ({both}) p WHERE x.f <> y.f AND (x.bits & y.bits) <> 0"


def pairs(words_: str, least: int = LEAST) -> str:
    """Pairs that reach the least sample: (dataset_id, a, b, fa, fb, n, ups, downs)."""
    return f"SELECT dataset_id, a, b, fa, fb, {_COUNTS} FROM ({_pair_words(words_)}) w GROUP BY dataset_id, a, b, fa, fb HAVING sum(bit_count(bits)) >= {least}"


def _triples(words_: str, pairs_: str, least: int) -> str:
    """The same of triples; only those whose three pairs are frequent are tried."""
    tried = f"""
    SELECT p.dataset_id, p.a, p.b, q.b AS c FROM {pairs_} p JOIN {pairs_} q ON p.dataset_id = q.dataset_id AND p.a = q.a AND p.b < q.b AND p.fb <> q.fb
    JOIN {pairs_} r ON r.dataset_id = p.dataset_id AND r.a = p.b AND r.b = q.b WHERE least(p.n, q.n, r.n) >= {least}"""
    # the planner takes exploded rows for few: these joins are told to be sorted ones
    third = f"SELECT /*+ MERGE(t) */ w.dataset_id, w.chunk, w.a, w.b, t.c, w.bits, w.ups, w.downs FROM ({_pair_words(words_)}) w JOIN ({tried}) t ON w.dataset_id = t.dataset_id AND w.a = t.a AND w.b = t.b"
    bits = f"SELECT /*+ MERGE(z) */ x.dataset_id, x.a, x.b, x.c, x.bits & z.bits AS bits, x.ups, x.downs FROM ({third}) x JOIN {words_} z ON x.dataset_id = z.dataset_id AND x.chunk = z.chunk AND x.c = z.id WHERE (x.bits & z.bits) <> 0"
    return f"SELECT dataset_id, a, b, c, {_COUNTS} FROM ({bits}) w GROUP BY dataset_id, a, b, c HAVING sum(bit_count(bits)) >= {least}"


def levels(words_: str, pairs_: str, frequent_: str, least: int = LEAST_OF_THREE) -> str:
    """All sets of one to three conditions that reach the least sample (``least``: of three): (dataset_id, pattern, family, depth, ids, n, ups, downs)."""
    single = f"SELECT dataset_id, array(id) AS ids, {_COUNTS} FROM {words_} GROUP BY dataset_id, id"
    sets = f"{single} UNION ALL SELECT dataset_id, array(a, b), n, ups, downs FROM {pairs_} UNION ALL SELECT dataset_id, array(a, b, c), n, ups, downs FROM ({_triples(words_, pairs_, least)}) t"
    own = f"SELECT s.*, q.cond, q.feature FROM (SELECT *, explode(ids) AS one FROM ({sets}) u) s JOIN {frequent_} q ON s.dataset_id = q.dataset_id AND s.one = q.id"
    return f"SELECT dataset_id, array_join(sort_array(collect_list(cond)), ' + ') AS pattern, array_join(sort_array(collect_list(feature)), '|') AS family, size(ids) AS depth, ids, n, ups, downs FROM ({own}) o GROUP BY dataset_id, ids, n, ups, downs"


def judged(ev: str, found: str, horizon: int = 12, win: float = 52.0, lift: float = 3.0, added: float = 0.5) -> str:
    """Every frequent set with its rates and the first filter that rejects it, near-duplicates aside ('kept' if none)."""
    base = f"SELECT dataset_id AS ds, avg(CASE WHEN r{horizon} > 0 THEN 100e0 ELSE 0e0 END) AS base_up, avg(CASE WHEN r{horizon} < 0 THEN 100e0 ELSE 0e0 END) AS base_dn FROM {ev} WHERE r{horizon} IS NOT NULL GROUP BY dataset_id"
    rated = f"SELECT f.*, ups >= downs AS bull, greatest(ups, downs) * 100e0 / n AS win_rate, greatest(ups, downs) * 100e0 / n - CASE WHEN ups >= downs THEN base_up ELSE base_dn END AS lift FROM {found} f JOIN ({base}) b ON f.dataset_id = b.ds"
    parents = f"SELECT dataset_id, pattern, bull, explode(transform(ids, one -> array_remove(ids, one))) AS parent FROM ({rated}) c WHERE depth > 1"
    best = f"SELECT p.dataset_id AS bd, p.pattern AS bp, max(CASE WHEN p.bull THEN f.ups ELSE f.downs END * 100e0 / f.n) AS best FROM ({parents}) p JOIN {found} f ON p.dataset_id = f.dataset_id AND p.parent = f.ids GROUP BY p.dataset_id, p.pattern"
    return f"""
    SELECT dataset_id, pattern, family, depth, ids, n, win_rate, lift, CASE WHEN win_rate < {win}e0 THEN '2 win rate' WHEN lift < {lift}e0 THEN '3 lift' WHEN depth > 1 AND win_rate < best + {added}e0 THEN '4 redundant condition' ELSE 'kept' END AS reason
    FROM ({rated}) r LEFT JOIN ({best}) b ON r.dataset_id = b.bd AND r.pattern = b.bp"""


def similar(words_: str, sets: str, band: float = SIZE_BAND, near: float = NEAR) -> str:
    """Pairs (dataset_id, early, late, jaccard) of kept sets of one family whose matches nearly agree.

    A set's words are the bitwise and of its conditions' words; equal sets have similarity 1.
    """
    each = f"SELECT dataset_id, pattern, family, n, depth, explode(ids) AS id FROM ({sets}) s WHERE reason = 'kept'"
    word = f"SELECT k.dataset_id, w.chunk, k.pattern, k.family, k.n, k.depth, bit_and(w.bits) AS bits FROM ({each}) k JOIN {words_} w ON k.dataset_id = w.dataset_id AND k.id = w.id GROUP BY k.dataset_id, w.chunk, k.pattern, k.family, k.n, k.depth HAVING count(*) = k.depth AND bit_and(w.bits) <> 0"
    order = "(x.depth < y.depth OR (x.depth = y.depth AND x.pattern < y.pattern))"
    both = f"SELECT x.dataset_id, x.pattern AS early, y.pattern AS late, x.n AS n, y.n AS m, sum(bit_count(x.bits & y.bits)) AS shared FROM ({word}) x JOIN ({word}) y ON x.dataset_id = y.dataset_id AND x.family = y.family AND x.chunk = y.chunk WHERE {order} AND abs(x.n - y.n) <= {band}e0 * greatest(x.n, y.n) GROUP BY x.dataset_id, x.pattern, y.pattern, x.n, y.n"
    return f"SELECT dataset_id, early, late, shared * 1e0 / (n + m - shared) AS jaccard FROM ({both}) b WHERE shared >= {near}e0 * (n + m - shared)"


def filtered(words_: str, ev: str, found: str) -> str:
    """Every frequent set with the filter that rejects it; near-duplicates of an earlier kept set of their family last.

    A set is compared with sets that stayed, so the choice goes through a family in order; a family
    holds the conditions of at most three columns.
    """
    sets = judged(ev, found)
    twins = f"SELECT dataset_id AS td, late, collect_set(early) AS twins FROM ({similar(words_, sets)}) t GROUP BY dataset_id, late"
    lined = f"SELECT dataset_id, family, sort_array(collect_list(struct(depth, pattern, coalesce(twins, cast(array() AS array<string>)) AS twins))) AS line FROM ({sets}) s LEFT JOIN ({twins}) t ON s.dataset_id = t.td AND s.pattern = t.late WHERE reason = 'kept' GROUP BY dataset_id, family"
    chosen = f"SELECT dataset_id AS cd, explode(aggregate(line, cast(array() AS array<string>), (s, v) -> CASE WHEN arrays_overlap(s, v.twins) THEN s ELSE concat(s, array(v.pattern)) END)) AS stays FROM ({lined}) l"
    return f"SELECT s.dataset_id, s.pattern, s.family, s.depth, s.n, s.win_rate, s.lift, CASE WHEN s.reason = 'kept' AND c.stays IS NULL THEN '5 near duplicate' ELSE s.reason END AS reason FROM ({sets}) s LEFT JOIN ({chosen}) c ON s.dataset_id = c.cd AND s.pattern = c.stays"


#: Bars that screening looks at, at least; values that a score needs; features that go on.
SCREEN_ROWS, SCREEN_LEAST, SCREENED = 256, 8, 1200


def screened(long: str, ev: str, most: int = SCREENED) -> str:
    """Features by their association with the next bar's return on evenly strided bars, the strongest ``most`` of a dataset.

    A numeric feature scores by its absolute correlation, a categorical one by the spread of the mean
    returns of its values that occur twice; with too few values the score is 0.
    """
    sample = f"SELECT dataset_id AS ds, bar_index AS b, r1 / 100 AS y FROM {ev} WHERE r1 IS NOT NULL AND bar_index < c - 1 AND bar_index % greatest(1, (c - 1) DIV {SCREEN_ROWS}) = 0"
    met = f"SELECT l.dataset_id, l.feature, l.num, l.txt, s.y FROM {long} l LEFT JOIN ({sample}) s ON l.dataset_id = s.ds AND l.bar_index = s.b"
    x = "CASE WHEN y IS NOT NULL THEN num END"
    numeric = f"SELECT dataset_id, feature, CASE WHEN count(y) >= {SCREEN_LEAST} AND stddev_pop({x}) > 1e-12 THEN coalesce(abs(try_divide(covar_pop(num, y), stddev_pop({x}) * stddev_pop(y))), 0e0) ELSE 0e0 END AS score FROM ({met}) m WHERE num IS NOT NULL GROUP BY dataset_id, feature"
    groups = f"SELECT dataset_id, feature, txt, count(y) AS n, avg(y) AS mean FROM ({met}) m WHERE txt IS NOT NULL GROUP BY dataset_id, feature, txt"
    spread = f"SELECT dataset_id, feature, CASE WHEN sum(n) >= {SCREEN_LEAST} AND count_if(n >= 2) >= 2 THEN max(CASE WHEN n >= 2 THEN mean END) - min(CASE WHEN n >= 2 THEN mean END) ELSE 0e0 END AS score FROM ({groups}) g GROUP BY dataset_id, feature"
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY floor(score * 1e9) DESC, feature) AS place FROM ({numeric} UNION ALL {spread}) u) v WHERE place <= {most}"
