"""Exit triggers, parameter grid and the opening reversal: sessions, signals and their outcomes."""

from __future__ import annotations

from patternloom.operators.features import CLOSE, OPEN, clocked
from patternloom.plans.dual import Dialect
from patternloom.sources.bars import ORDER


def exit_triggers(d: Dialect, bars: str, x: str = "users", level: float = 5.0) -> str:
    """Bars where a column crosses a level or a state newly begins."""
    return f"SELECT dataset_id, bar_index, coalesce(p <= {level}e0 AND x > {level}e0, false) AS cross_above, coalesce(p >= {level}e0 AND x < {level}e0, false) AS cross_below, coalesce(x = {level}e0 AND p <> {level}e0, false) AS newly_equal FROM (SELECT dataset_id, bar_index, {x} AS x, lag({x}) OVER ({ORDER}) AS p FROM {bars}) a"


#: The opening-reversal grid.
GRID = {"manipulation": (20, 25, 30, 35, 40, 45, 50), "wick": (30, 40, 50, 60, 70), "body": (30, 40, 50, 60), "location": (25, 35, 45), "inside": (0, 1), "entry": ("confirmation-close", "next-open")}


def grid(d: Dialect) -> str:
    """All parameter sets, as a product of one-column relations."""
    parts = " CROSS JOIN ".join(f"{d.values([(v,) for v in vs], k)} AS r_{k}" for k, vs in GRID.items())
    return f"SELECT {', '.join(GRID)} FROM {parts}"


def sessions(d: Dialect, bars: str) -> str:
    """Regular-hours sessions of at least six bars: opening range of three bars and its midpoint."""
    over = "PARTITION BY dataset_id, local_day ORDER BY bar_index"
    return f"""
    SELECT *, max(CASE WHEN bar_no <= 3 THEN high END) OVER (PARTITION BY dataset_id, local_day) AS oh, min(CASE WHEN bar_no <= 3 THEN low END) OVER (PARTITION BY dataset_id, local_day) AS ol,
      max(CASE WHEN bar_no = 1 THEN open END) OVER (PARTITION BY dataset_id, local_day) AS oo, max(CASE WHEN bar_no = 3 THEN close END) OVER (PARTITION BY dataset_id, local_day) AS oc,
      max(high) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS known_high, min(low) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS known_low
    FROM (
      SELECT *, row_number() OVER ({over}) AS bar_no, count(*) OVER (PARTITION BY dataset_id, local_day) AS c, lead(open) OVER ({over}) AS next_open, lead(bar_index) OVER ({over}) AS next_index
      FROM (SELECT *, cast({d.local('ts_ms', 'America/New_York')} AS date) AS local_day FROM ({clocked(d, bars)}) x WHERE minute_of_day >= {OPEN} AND minute_of_day < {CLOSE}) y
    ) z WHERE c >= 6"""


def reversal_signals(d: Dialect, bars: str, wick: int = 30, body: int = 60, location: int = 45) -> str:
    """First rejection candle of each session after its opening range, with entry, stop and target."""
    lo = "row_number() OVER (PARTITION BY dataset_id, local_day ORDER BY bar_index)"
    return f"""
    SELECT dataset_id, local_day, bar_index, side, close AS entry, CASE side WHEN 'long' THEN known_low ELSE known_high END AS stop, (oh + ol) / 2 AS target
    FROM (
      SELECT *, {lo} AS nth
      FROM (
        SELECT *, CASE WHEN oc < oo AND close > open AND low <= ol AND (least(open, close) - low) / (high - low) * 100 >= {wick} AND abs(close - open) / (high - low) * 100 <= {body} AND (close - low) / (high - low) * 100 >= {100 - location} THEN 'long'
             WHEN oc > oo AND close < open AND high >= oh AND (high - greatest(open, close)) / (high - low) * 100 >= {wick} AND abs(close - open) / (high - low) * 100 <= {body} AND (close - low) / (high - low) * 100 <= {location} THEN 'short' END AS side
        FROM ({sessions(d, bars)}) s WHERE bar_no > 3 AND high > low
      ) a WHERE side IS NOT NULL
    ) b WHERE nth = 1"""


def reversal_trades(d: Dialect, bars: str) -> str:
    """Outcome of each session's signal within the session: stop, target, ambiguous or session close."""
    up, dn = "(s.side = 'long' AND f.high >= s.target OR s.side = 'short' AND f.low <= s.target)", "(s.side = 'long' AND f.low <= s.stop OR s.side = 'short' AND f.high >= s.stop)"
    return f"""
    SELECT dataset_id, local_day, side, bar_index AS signal_index, CASE WHEN least(t_hit, s_hit) IS NULL THEN 'session-close' WHEN t_hit = s_hit THEN 'ambiguous' WHEN s_hit = least(t_hit, s_hit) THEN 'stop' ELSE 'target' END AS result,
      CASE WHEN side = 'long' THEN 1 ELSE -1 END * (CASE WHEN least(t_hit, s_hit) IS NULL THEN last_close WHEN s_hit = least(t_hit, s_hit) THEN stop ELSE target END - entry) / abs(entry - stop) AS gross_r
    FROM (
      SELECT s.dataset_id, s.local_day, s.side, s.bar_index, s.entry, s.stop, s.target, min(CASE WHEN {up} THEN f.bar_index END) AS t_hit, min(CASE WHEN {dn} THEN f.bar_index END) AS s_hit, {'arg_max' if d.duck else 'max_by'}(f.close, f.bar_index) AS last_close
      FROM ({reversal_signals(d, bars)}) s JOIN ({sessions(d, bars)}) f ON s.dataset_id = f.dataset_id AND s.local_day = f.local_day AND f.bar_index > s.bar_index
      WHERE (s.side = 'long' AND s.entry > s.stop AND s.target > s.entry) OR (s.side = 'short' AND s.entry < s.stop AND s.target < s.entry)
      GROUP BY s.dataset_id, s.local_day, s.side, s.bar_index, s.entry, s.stop, s.target
    ) a"""


# ------------------------------------------------------------------ viability of the opening reversal

#: Least trades of a viable set, folds, folds that must be profitable, stable neighbours, sets looked at in the holdout.
LEAST, FOLDS, GOOD_FOLDS, NEIGHBOURS, SHORTLIST = 5, 4, 3, 3, 24
COST_R = 0.02


def reversal_candidates(d: Dialect, bars: str) -> str:
    """Every rejection candle after the opening range: its measures, both entries, and the outcome of each in R.

    ``gate`` is the opening range in per cent of the mean daily range of the 14 sessions before.
    """
    day = f"SELECT dataset_id, local_day, max(oh - ol) AS opening, max(day_range) AS day_range, row_number() OVER (PARTITION BY dataset_id ORDER BY local_day) AS session_no FROM (SELECT *, max(high) OVER (PARTITION BY dataset_id, local_day) - min(low) OVER (PARTITION BY dataset_id, local_day) AS day_range FROM ({sessions(d, bars)}) s) x GROUP BY dataset_id, local_day"
    gate = f"SELECT *, opening / avg(day_range) OVER (PARTITION BY dataset_id ORDER BY session_no ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) * 100 AS gate FROM ({day}) y"
    side = "CASE WHEN oc < oo AND close > open AND low <= ol THEN 'long' WHEN oc > oo AND close < open AND high >= oh THEN 'short' END"
    measured = f"""
    SELECT *, CASE side WHEN 'long' THEN (least(open, close) - low) / (high - low) * 100 ELSE (high - greatest(open, close)) / (high - low) * 100 END AS wick, abs(close - open) / (high - low) * 100 AS body,
      CASE side WHEN 'long' THEN 100 - (close - low) / (high - low) * 100 ELSE (close - low) / (high - low) * 100 END AS location, CASE WHEN high <= oh AND low >= ol THEN 0 ELSE 1 END AS outside, CASE side WHEN 'long' THEN known_low ELSE known_high END AS stop, (oh + ol) / 2 AS target
    FROM (SELECT *, {side} AS side FROM ({sessions(d, bars)}) s WHERE bar_no > 3 AND high > low) a WHERE side IS NOT NULL"""
    entered = f"SELECT m.*, e.entry_mode, CASE e.entry_mode WHEN 'next-open' THEN m.next_open ELSE m.close END AS entry FROM ({measured}) m CROSS JOIN {d.values([('confirmation-close',), ('next-open',)], 'entry_mode')} e"
    hit = "(s.side = 'long' AND f.high >= s.target OR s.side = 'short' AND f.low <= s.target)"
    lost = "(s.side = 'long' AND f.low <= s.stop OR s.side = 'short' AND f.high >= s.stop)"
    return f"""
    SELECT a.dataset_id, a.local_day, a.bar_index, a.entry_mode, a.wick, a.body, a.location, a.outside, g.gate, g.session_no,
      CASE WHEN side = 'long' THEN 1 ELSE -1 END * (CASE WHEN least(t_hit, s_hit) IS NULL THEN last_close WHEN s_hit = least(t_hit, s_hit) THEN stop ELSE target END - entry) / abs(entry - stop) - {COST_R}e0 AS r
    FROM (
      SELECT s.dataset_id, s.local_day, s.bar_index, s.side, s.entry_mode, s.wick, s.body, s.location, s.outside, s.entry, s.stop, s.target, min(CASE WHEN {hit} THEN f.bar_index END) AS t_hit, min(CASE WHEN {lost} THEN f.bar_index END) AS s_hit, {'arg_max' if d.duck else 'max_by'}(f.close, f.bar_index) AS last_close
      FROM ({entered}) s JOIN ({sessions(d, bars)}) f ON s.dataset_id = f.dataset_id AND s.local_day = f.local_day AND f.bar_index > s.bar_index
      WHERE (s.side = 'long' AND s.entry > s.stop AND s.target > s.entry) OR (s.side = 'short' AND s.entry < s.stop AND s.target < s.entry)
      GROUP BY s.dataset_id, s.local_day, s.bar_index, s.side, s.entry_mode, s.wick, s.body, s.location, s.outside, s.entry, s.stop, s.target
    ) a JOIN ({gate}) g ON a.dataset_id = g.dataset_id AND a.local_day = g.local_day WHERE g.gate IS NOT NULL"""


def reversal_sets(d: Dialect, bars: str) -> str:
    """Each parameter set on each instrument: the first candidate of a session that it accepts is its trade.

    The last fifth of the sessions is the holdout; folds and ranks come from the sessions before.
    """
    return f"""
    SELECT dataset_id, manipulation, wick, body, location, inside, entry, cast(sum(CASE WHEN NOT held THEN 1 ELSE 0 END) AS bigint) AS n, avg(CASE WHEN NOT held THEN r END) AS expectancy, cast(sum(CASE WHEN held THEN 1 ELSE 0 END) AS bigint) AS n_held, avg(CASE WHEN held THEN r END) AS held_expectancy, avg(CASE WHEN held THEN r - {COST_R}e0 END) AS stressed,
      {' + '.join(f"CASE WHEN coalesce(sum(CASE WHEN NOT held AND fold = {k} THEN r END), 0e0) > 0 THEN 1 ELSE 0 END" for k in range(FOLDS))} AS good_folds
    FROM (
      SELECT *, session_no > floor(last * 0.8e0) AS held, least(floor((session_no - 1) * {FOLDS} / floor(greatest(1, last * 0.8e0))), {FOLDS - 1}) AS fold
      FROM (
        SELECT c.dataset_id, c.session_no, c.r, g.*, max(c.session_no) OVER (PARTITION BY c.dataset_id) AS last, row_number() OVER (PARTITION BY c.dataset_id, c.session_no, g.manipulation, g.wick, g.body, g.location, g.inside, g.entry ORDER BY c.bar_index) AS nth
        FROM ({reversal_candidates(d, bars)}) c JOIN ({grid(d)}) g ON c.entry_mode = g.entry AND c.gate >= g.manipulation AND c.wick >= g.wick AND c.body <= g.body AND c.location <= g.location AND (g.inside = 0 OR c.outside = 0)
      ) a WHERE nth = 1
    ) b GROUP BY dataset_id, manipulation, wick, body, location, inside, entry"""


def reversal_viability(d: Dialect, bars: str) -> str:
    """Parameter sets in rank order with their stable neighbours; only the first of an instrument may be recommended.

    A neighbour differs by one step in one of manipulation, wick and body; it is stable if it earns.
    """
    sets = reversal_sets(d, bars)
    near = f"SELECT a.dataset_id, a.manipulation, a.wick, a.body, a.location, a.inside, a.entry, count(*) AS neighbours FROM ({sets}) a JOIN ({sets}) b ON a.dataset_id = b.dataset_id AND a.location = b.location AND a.inside = b.inside AND a.entry = b.entry AND abs(a.manipulation - b.manipulation) / 5 + abs(a.wick - b.wick) / 10 + abs(a.body - b.body) / 10 = 1 WHERE b.expectancy > 0 GROUP BY a.dataset_id, a.manipulation, a.wick, a.body, a.location, a.inside, a.entry"
    key = "dataset_id, manipulation, wick, body, location, inside, entry"
    on = " AND ".join(f"s.{c} = k.{c}" for c in key.split(", "))
    return f"""
    SELECT {key}, n, expectancy, good_folds, neighbours, place, viable, viable AND place = 1 AND n_held > 0 AND held_expectancy > 0 AND stressed > 0 AS recommended
    FROM (
      SELECT s.*, coalesce(k.neighbours, 0) AS neighbours, s.n >= {LEAST} AND s.expectancy > 0 AND s.good_folds >= {GOOD_FOLDS} AND coalesce(k.neighbours, 0) >= {NEIGHBOURS} AS viable,
        row_number() OVER (PARTITION BY s.dataset_id ORDER BY CASE WHEN s.n >= {LEAST} THEN 0 ELSE 1 END, floor(coalesce(s.expectancy, -99e0) * 1e9) DESC, s.n DESC, s.manipulation, s.wick, s.body, s.location, s.inside, s.entry) AS place
      FROM ({sets}) s LEFT JOIN ({near}) k ON {on}
    ) v WHERE place <= {SHORTLIST}"""
