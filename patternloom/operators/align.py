"""Causal alignment: as-of, interval and containment joins on completed bars.

A source bar is known at its end (start + interval).  The as-of join is a union of both sides
ordered by end time with the last source seen carried forward, one sort per instrument and no
range join.
"""

from __future__ import annotations

from patternloom.plans.blocks import ORDER, split
from patternloom.plans.dual import Dialect


def completed(d: Dialect, target: str, source: str, target_ms: int, source_ms: int) -> str:
    """For each target bar, the last source bar that has ended by the target's end."""
    over = "PARTITION BY dataset_id ORDER BY end_ms, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return f"""
    SELECT dataset_id, bar_index, ts_ms, open, high, low, close, src_index
    FROM (
      SELECT *, {d.last('own', over)} AS src_index
      FROM (
        SELECT dataset_id, bar_index, ts_ms, open, high, low, close, ts_ms + {target_ms} AS end_ms, 1 AS side, cast(NULL AS bigint) AS own FROM {target}
        UNION ALL SELECT dataset_id, bar_index, ts_ms, open, high, low, close, ts_ms + {source_ms}, 0, bar_index FROM {source}
      ) u
    ) w WHERE side = 1"""


def context(d: Dialect, target: str, source: str, target_ms: int, source_ms: int, columns: str) -> str:
    """Columns of the last completed source bar beside each target bar."""
    picked = ", ".join(f"s.{c} AS mtf_{c}" for c in columns.split())
    return f"SELECT t.dataset_id, t.bar_index, t.src_index, {picked} FROM ({completed(d, target, source, target_ms, source_ms)}) t LEFT JOIN (SELECT * FROM {source}) s ON t.dataset_id = s.dataset_id AND t.src_index = s.bar_index"


def _neighbours(d: Dialect, bars: str) -> str:
    """Bars with the high and low of the one before and the time of the next."""
    return split(d, bars, 1, lambda b: f"SELECT dataset_id, bar_index, ts_ms, high, low, lag(high) OVER ({ORDER}) AS ph, lag(low) OVER ({ORDER}) AS pl, lead(ts_ms) OVER ({ORDER}) AS next_ms FROM {b}", ahead=1)


def developing(d: Dialect, target: str, source: str, target_ms: int, source_ms: int) -> str:
    """The forming source candle at each target bar: progress, body, range, location so far, and the order of its sweeps.

    A candle forms until its end; at its end it is complete and the bar has none.  Sweeps are first
    touches beyond the source bar before; where both fall in one bar the low counts as first.
    """
    lo = "PARTITION BY dataset_id, bucket ORDER BY bar_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    percent = lambda x: f"CASE WHEN o <> 0 THEN ({x}) / abs(o) * 100 ELSE 0e0 END"
    return f"""
    SELECT dataset_id, bar_index, (ts_ms + {target_ms} - bucket) * 100e0 / {source_ms} AS progress, {percent('close - o')} AS body_pct, {percent('h - l')} AS range_pct, CASE WHEN h > l THEN (close - l) / (h - l) * 100 ELSE 50e0 END AS location,
      CASE WHEN first_high < first_low THEN 'Swept prior high before prior low' WHEN first_low <= first_high THEN 'Swept prior low before prior high' WHEN first_high IS NOT NULL THEN 'Swept prior high' WHEN first_low IS NOT NULL THEN 'Swept prior low' ELSE 'Inside prior range' END AS sweep_order
    FROM (
      SELECT *, first_value(open) OVER ({lo}) AS o, max(high) OVER ({lo}) AS h, min(low) OVER ({lo}) AS l, min(CASE WHEN high > ph THEN bar_index END) OVER ({lo}) AS first_high, min(CASE WHEN low < pl THEN bar_index END) OVER ({lo}) AS first_low
      FROM (SELECT t.*, s.ts_ms AS bucket, s.ph, s.pl FROM (SELECT * FROM {target}) t JOIN ({_neighbours(d, source)}) s ON t.dataset_id = s.dataset_id AND {d.div('t.ts_ms', str(source_ms))} = {d.div('s.ts_ms', str(source_ms))} WHERE t.ts_ms + {target_ms} < s.ts_ms + {source_ms}) a
    ) b"""


def intrabar(d: Dialect, target: str, source: str, target_ms: int, source_ms: int) -> str:
    """Path of the lower-timeframe bars inside each target bar: count, order of extremes and of sweeps of the bar before, efficiency, turns."""
    lo = "arg_min" if d.duck else "min_by"
    key = lambda *xs: f"({', '.join(xs)})" if d.duck else f"struct({', '.join(xs)})"
    over = "PARTITION BY dataset_id, tgt ORDER BY bar_index"
    turned = d.last("nullif(sg, 0)", f"{over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
    expected = max(1, round(target_ms / source_ms))
    return f"""
    SELECT dataset_id, tgt AS bar_index, n AS intrabars, least(100e0, n * 100e0 / {expected}) AS coverage,
      CASE WHEN high_at < low_at THEN 'High before low' WHEN low_at < high_at THEN 'Low before high' ELSE 'High and low in same intrabar' END AS extreme_order,
      CASE WHEN swept_high = swept_low THEN 'Both swept in same intrabar' WHEN swept_high < swept_low THEN 'Prior high swept before prior low' WHEN swept_low < swept_high THEN 'Prior low swept before prior high' WHEN swept_high IS NOT NULL THEN 'Prior high swept only' WHEN swept_low IS NOT NULL THEN 'Prior low swept only' ELSE 'No prior-range sweep' END AS sweep_order,
      CASE WHEN path > 0 THEN abs(last_close - first_open) / path * 100 ELSE 0e0 END AS efficiency, turns, (hi - first_open) / greatest(abs(first_open), 1e-9) * 100 AS up_excursion, (first_open - lo) / greatest(abs(first_open), 1e-9) * 100 AS down_excursion
    FROM (
      SELECT dataset_id, tgt, count(*) AS n, {lo}(bar_index, {key('-high', 'bar_index')}) AS high_at, {lo}(bar_index, {key('low', 'bar_index')}) AS low_at, sum(abs(close - before)) AS path, min(CASE WHEN high > ph THEN bar_index END) AS swept_high, min(CASE WHEN low < pl THEN bar_index END) AS swept_low,
        {lo}(open, bar_index) AS first_open, {lo}(close, -bar_index) AS last_close, max(high) AS hi, min(low) AS lo, cast(sum(CASE WHEN sg <> 0 AND sg <> turned THEN 1 ELSE 0 END) AS bigint) AS turns
      FROM (
        SELECT *, {turned} AS turned
        FROM (
          SELECT *, sign(close - before) AS sg
          FROM (
            SELECT l.*, t.bar_index AS tgt, t.ph, t.pl, coalesce(lag(l.close) OVER (PARTITION BY l.dataset_id, t.bar_index ORDER BY l.bar_index), l.open) AS before
            FROM (SELECT * FROM {source}) l JOIN ({_neighbours(d, target)}) t ON l.dataset_id = t.dataset_id AND {d.div('l.ts_ms', str(target_ms))} = {d.div('t.ts_ms', str(target_ms))}
          ) a
        ) b
      ) c GROUP BY dataset_id, tgt
    ) e"""


def covering(d: Dialect, target: str, source: str, source_ms: int) -> str:
    """The source bar whose interval holds each target bar's start."""
    return f"SELECT t.dataset_id, t.bar_index, s.bar_index AS src_index FROM (SELECT * FROM {target}) t JOIN (SELECT * FROM {source}) s ON t.dataset_id = s.dataset_id AND {d.div('t.ts_ms', str(source_ms))} = {d.div('s.ts_ms', str(source_ms))} WHERE t.ts_ms >= s.ts_ms AND t.ts_ms < s.ts_ms + {source_ms}"


def prior_daily(d: Dialect, target: str, source: str, strict_ms: int = 0) -> str:
    """Last source bar that starts strictly before each target bar; ``strict_ms`` adds its length."""
    over = "PARTITION BY dataset_id ORDER BY moment, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return f"""
    SELECT dataset_id, bar_index, src_index FROM (
      SELECT *, {d.last('own', over)} AS src_index
      FROM (SELECT dataset_id, bar_index, ts_ms AS moment, 0 AS side, cast(NULL AS bigint) AS own FROM {target} UNION ALL SELECT dataset_id, bar_index, ts_ms + {strict_ms}, 1, bar_index FROM {source}) u
    ) w WHERE side = 0"""


def nearest(d: Dialect, driver: str, other: str, tolerance: int) -> str:
    """Each driver event with the nearest other event within a tolerance; of equals the later one.

    Events are bucketed by the tolerance, so only neighbouring buckets meet.
    """
    return f"""
    SELECT event_id, other_id, distance FROM (
      SELECT a.event_id, b.event_id AS other_id, abs(a.moment - b.moment) AS distance, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.moment - b.moment), b.moment DESC, b.event_id DESC) AS rn
      FROM (SELECT *, {d.div("moment", str(tolerance))} + o.o AS bucket FROM {driver} CROSS JOIN {d.values([(-1,), (0,), (1,)], 'o')} o) a
      JOIN (SELECT *, {d.div("moment", str(tolerance))} AS bucket FROM {other}) b ON a.bucket = b.bucket AND abs(a.moment - b.moment) <= {tolerance}
    ) x WHERE rn = 1"""


def audit(d: Dialect, target: str, source: str, target_ms: int, source_ms: int) -> str:
    """Alignment facts per dataset, and those of its last bar: age, progress of the forming bar, bars contained, status.

    A bar leaks where its source ends after it, or where a later source had ended already.
    """
    by, ends = ("arg_max" if d.duck else "max_by"), f"ts_ms + {target_ms}"
    relation = "higher" if source_ms > target_ms else "lower" if source_ms < target_ms else "equal"
    near = _neighbours(d, source)
    within = f"SELECT t.dataset_id, count(*) AS contained FROM (SELECT dataset_id, max(ts_ms) AS last_ms FROM {target} GROUP BY dataset_id) t JOIN (SELECT * FROM {source}) s ON t.dataset_id = s.dataset_id AND s.ts_ms >= t.last_ms AND s.ts_ms + {source_ms} <= t.last_ms + {target_ms} GROUP BY t.dataset_id"
    odd = f"SELECT dataset_id, sum(CASE WHEN abs(next_ms - ts_ms - {source_ms}) * 1e0 / {source_ms} > 0.08e0 THEN 1 ELSE 0 END) AS irregular, min(ts_ms) AS first_ms FROM ({near}) n GROUP BY dataset_id"
    # before the first source bar is complete, that bar is the one that forms
    forming = "CASE WHEN src_ms IS NULL THEN first_ms ELSE next_ms END"
    return f"""
    SELECT dataset_id, 'same-instrument {relation} timeframe' AS relationship, bars, aligned, leaks, irregular, aligned * 100e0 / bars AS coverage, at_ms - src_ms - {source_ms} AS age_ms,
      CASE WHEN {source_ms} > {target_ms} AND {forming} < at_ms AND at_ms < {forming} + {source_ms} THEN least(100e0, (at_ms - {forming}) * 100e0 / {source_ms}) END AS progress,
      CASE WHEN {source_ms} < {target_ms} THEN contained END AS contained, CASE WHEN src_ms IS NULL THEN 'unavailable' WHEN leaks > 0 OR src_ms + {source_ms} > at_ms THEN 'warning' ELSE 'pass' END AS status
    FROM (
      SELECT a.dataset_id, count(*) AS bars, count(src_index) AS aligned, cast(sum(CASE WHEN src_ms + {source_ms} > {ends} OR next_ms + {source_ms} <= {ends} THEN 1 ELSE 0 END) AS bigint) AS leaks, max({ends}) AS at_ms, {by}(src_ms, a.bar_index) AS src_ms, {by}(next_ms, a.bar_index) AS next_ms,
        cast(max(o.irregular) AS bigint) AS irregular, max(o.first_ms) AS first_ms, coalesce(max(w.contained), 0) AS contained
      FROM (SELECT t.*, s.ts_ms AS src_ms, s.next_ms FROM ({completed(d, target, source, target_ms, source_ms)}) t LEFT JOIN ({near}) s ON t.dataset_id = s.dataset_id AND t.src_index = s.bar_index) a
      LEFT JOIN ({odd}) o ON a.dataset_id = o.dataset_id LEFT JOIN ({within}) w ON a.dataset_id = w.dataset_id GROUP BY a.dataset_id
    ) b"""
