"""Where and when patterns occur: by year, by dataset and pooled, steadiness over their span, and flags.

``spans`` counts the matches of a pattern on a dataset by year and stretch of time; it is the only pass
over matches.  All levels of coverage are grouping sets of that small table.  The middle match of a pattern
is found from the counts of stretches; only matches of the stretch that holds it are looked at again.

Spark's text only: the oracles are written apart.  The operators take ``ev`` and the kept table ``spans``.
"""

from __future__ import annotations

from patternloom.operators import patterns as pt
from patternloom.plans.dual import SPARK

#: Fewest occurrences, share of the history that a span must exceed, points between halves or symbols, fewest symbols.
FEW, SHORT, POINTS, SYMBOLS = 30, 0.25, 10, 2
#: Milliseconds of a stretch (30 days).
STRETCH = 2_592_000_000
_NEXT = "bar_index, ts_ms, r1"


def _rows(ev: str) -> str:
    """Matches with the direction of the next bar's close."""
    return f"SELECT dataset_id, pattern_id, ts_ms, ts_ms DIV {STRETCH} AS stretch, CASE WHEN r1 > 0 THEN 1 ELSE 0 END AS up, CASE WHEN r1 < 0 THEN 1 ELSE 0 END AS down FROM ({pt.matched(SPARK, ev, _NEXT)}) m WHERE pattern_id > 0"


def spans(ev: str) -> str:
    """Matches, next closes up and down, first and last of each pattern by dataset, year (UTC) and stretch of time."""
    year = f"cast(year({SPARK.local('ts_ms', 'UTC')}) AS bigint)"
    return f"SELECT dataset_id, pattern_id, {year} AS y, stretch, count(*) AS n, sum(up) AS ups, sum(down) AS downs, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM ({_rows(ev)}) r GROUP BY dataset_id, pattern_id, {year}, stretch"


def history(ev: str) -> str:
    """Bars, first and last time of each dataset."""
    return f"SELECT dataset_id, count(*) AS bars, min(ts_ms) AS lo, max(ts_ms) AS hi FROM {ev} GROUP BY dataset_id"


def periods(ev: str, spans_: str) -> str:
    """Occurrences of every pattern in all years and each year, on each dataset and on all (``*``).

    ``share`` is of the bars examined; a row of all years has year 0.
    """
    return f"""
    SELECT s.dataset_id, pattern_id, y, n, first_ms, last_ms, n * 100e0 / h.bars AS share
    FROM (
      SELECT CASE grouping(dataset_id) WHEN 1 THEN '*' ELSE dataset_id END AS dataset_id, pattern_id, CASE grouping(y) WHEN 1 THEN cast(0 AS bigint) ELSE y END AS y, sum(n) AS n, min(first_ms) AS first_ms, max(last_ms) AS last_ms
      FROM {spans_} GROUP BY GROUPING SETS ((dataset_id, pattern_id), (dataset_id, pattern_id, y), (pattern_id), (pattern_id, y))
    ) s JOIN (SELECT coalesce(dataset_id, '*') AS dataset_id, sum(bars) AS bars FROM ({history(ev)}) h GROUP BY GROUPING SETS ((dataset_id), ())) h ON s.dataset_id = h.dataset_id"""


def halves(ev: str, spans_: str, key: str) -> str:
    """Per ``key``: matches, the half of them, and next closes up and down in all and among the first half in time.

    Matches at one instant are ordered by dataset.
    """
    keys = [k.strip() for k in key.split(",")]
    over = f"OVER (PARTITION BY {key} ORDER BY stretch)"
    same = " AND ".join(f"m.{k} = b.{k}" for k in keys)
    return f"""
    WITH b AS (
      SELECT * FROM (
        SELECT *, sum(n) {over} - n AS earlier, sum(ups) {over} - ups AS ups_earlier, sum(downs) {over} - downs AS downs_earlier, sum(n) OVER (PARTITION BY {key}) AS total, sum(ups) OVER (PARTITION BY {key}) AS all_ups, sum(downs) OVER (PARTITION BY {key}) AS all_downs, sum(n) OVER (PARTITION BY {key}) DIV 2 AS half
        FROM (SELECT {key}, stretch, sum(n) AS n, sum(ups) AS ups, sum(downs) AS downs FROM {spans_} GROUP BY {key}, stretch) g
      ) c WHERE earlier <= half AND half < earlier + n
    )
    SELECT {', '.join(f'b.{k}' for k in keys)}, b.total, b.half, b.all_ups, b.all_downs, b.ups_earlier + coalesce(f.up, 0) AS early_ups, b.downs_earlier + coalesce(f.down, 0) AS early_downs
    FROM b LEFT JOIN (
      SELECT {key}, sum(up) AS up, sum(down) AS down FROM (
        SELECT {', '.join(f'm.{k}' for k in keys)}, m.up, m.down, b.half - b.earlier AS wanted, row_number() OVER (PARTITION BY {', '.join(f'm.{k}' for k in keys)} ORDER BY m.ts_ms, m.dataset_id) AS place
        FROM ({_rows(ev)}) m JOIN b ON {same} AND m.stretch = b.stretch
      ) p WHERE place <= wanted GROUP BY {key}
    ) f ON {' AND '.join(f'b.{k} = f.{k}' for k in keys)}"""


def _steady(side: str) -> str:
    """Whether the halves' rates of next closes on a side are close; one match is steady."""
    return f"(total < 2 OR abs(early_{side} * 100e0 / half - (all_{side} - early_{side}) * 100e0 / (total - half)) <= {POINTS})"


def _flags(*named: tuple[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {test} THEN '{name}' END" for test, name in named) + ")"


def flagged(ev: str, spans_: str) -> str:
    """Coverage of each pattern on its own dataset: win rates of both halves, steadiness and flags of concentration.

    Wins are of the next close in the pattern's direction.  A search has one symbol and one interval.
    """
    win = lambda up, down: f"CASE e.direction WHEN 'bullish' THEN {up} ELSE {down} END"
    flags = _flags(("true", "symbol-specific"), ("true", "timeframe-specific"), (f"n < {FEW}", "few-occurrences"), (f"hi > lo AND (last_ms - first_ms) / (hi - lo) < {SHORT}e0", "concentrated-in-short-period"))
    return f"""
    SELECT dataset_id, pattern_id, n, early_win, late_win, total < 2 OR abs(coalesce(early_win, 0e0) - late_win) <= {POINTS} AS steady, {flags} AS flags
    FROM (
      SELECT e.dataset_id, e.pattern_id, e.n, h.total, s.first_ms, s.last_ms, y.lo, y.hi, {win('early_ups', 'early_downs')} * 100e0 / nullif(half, 0) AS early_win, {win('all_ups - early_ups', 'all_downs - early_downs')} * 100e0 / (total - half) AS late_win
      FROM ({pt.evaluate(SPARK, ev)}) e JOIN ({halves(ev, spans_, 'dataset_id, pattern_id')}) h ON e.dataset_id = h.dataset_id AND e.pattern_id = h.pattern_id
      JOIN (SELECT dataset_id, pattern_id, min(first_ms) AS first_ms, max(last_ms) AS last_ms FROM {spans_} GROUP BY dataset_id, pattern_id) s ON e.dataset_id = s.dataset_id AND e.pattern_id = s.pattern_id
      JOIN ({history(ev)}) y ON e.dataset_id = y.dataset_id
    ) a"""


def per_symbol(ev: str) -> str:
    """Occurrences, win rate and mean move of every pattern on every dataset, zeros included."""
    e = f"({pt.evaluate(SPARK, ev)})"
    return f"""
    SELECT s.dataset_id, s.pattern_id, coalesce(e.n, 0) AS n, coalesce(e.win_rate, 0e0) AS win_rate, coalesce(e.avg_move, 0e0) AS avg_move
    FROM (SELECT pattern_id, explode(names) AS dataset_id FROM (SELECT pattern_id, (SELECT collect_set(dataset_id) FROM ({history(ev)}) d) AS names FROM {e} p GROUP BY pattern_id) q) s
    LEFT JOIN {e} e ON s.dataset_id = e.dataset_id AND s.pattern_id = e.pattern_id"""


def pooled(ev: str, spans_: str) -> str:
    """Coverage of each pattern over all datasets: pooled and equal results, steadiness read up and down, flags.

    ``broad``: at least two datasets with enough occurrences, win rates within ten points.
    """
    flags = _flags(("symbols <= 1", "symbol-specific"), ("true", "timeframe-specific"), (f"n < {FEW}", "few-occurrences"))
    enough = f"FILTER (WHERE n >= {pt.LEAST})"
    return f"""
    SELECT r.pattern_id, symbols, n, r.win_rate, r.equal_rate, r.avg_move, r.equal_move, coalesce(able >= {SYMBOLS} AND top - low <= {POINTS}, false) AS broad, {_steady('ups')} AS steady_up, {_steady('downs')} AS steady_down, {flags} AS flags
    FROM (
      SELECT pattern_id, count(*) AS symbols, sum(n) AS n, sum(win_rate * n) / sum(n) AS win_rate, avg(win_rate) AS equal_rate, sum(avg_move * n) / sum(n) AS avg_move, avg(avg_move) AS equal_move, count(*) {enough} AS able, max(win_rate) {enough} AS top, min(win_rate) {enough} AS low
      FROM ({pt.evaluate(SPARK, ev)}) e GROUP BY pattern_id
    ) r JOIN ({halves(ev, spans_, 'pattern_id')}) h ON r.pattern_id = h.pattern_id"""
