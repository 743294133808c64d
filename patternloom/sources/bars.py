"""Bar builders: ticks to OHLCV bars, resampling, dataset facts."""

from __future__ import annotations

from patternloom.plans.blocks import ORDER, numbered, split
from patternloom.plans.dual import Dialect

HOUR, DAY = 3_600_000, 86_400_000


def tick_bars(d: Dialect, events: str, interval: int = HOUR) -> str:
    """Events to bars: one dataset per event type; price is ``value``, volume the count.

    Ties in time are broken by event id.  Empty intervals make no bar.
    """
    ms = d.epoch_ms("ts")
    rows = f"""
      SELECT event_type AS dataset_id, {d.div(ms, str(interval))} * cast({interval} AS bigint) AS ts_ms,
        {_by('min', 'value', 'ts', 'event_id', d)} AS open, max(value) AS high, min(value) AS low, {_by('max', 'value', 'ts', 'event_id', d)} AS close,
        cast(count(*) AS double) AS volume, avg(value) AS avg_value, cast(count(DISTINCT user_id) AS double) AS users, avg({d.json_long('props', 'k')}) AS k
      FROM {events} WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY event_type, {d.div(ms, str(interval))}"""
    return f"SELECT dataset_id, bar_index, ts_ms, open, high, low, close, volume, avg_value, users, k FROM ({numbered(d, rows, interval)}) b"


def _by(which: str, value: str, first: str, second: str, d: Dialect) -> str:
    return f"arg_{which}({value}, ({first}, {second}))" if d.duck else f"{which}_by({value}, struct({first}, {second}))"


def daily_bars(d: Dialect, lineitem: str) -> str:
    """Line items to daily bars of the unit price: one dataset per return flag."""
    order = ("l_extendedprice / l_quantity", "l_orderkey", "l_linenumber")
    rows = f"""
      SELECT l_returnflag AS dataset_id, {d.epoch_ms('l_shipdate')} AS ts_ms, {_by('min', *order, d)} AS open, max(l_extendedprice / l_quantity) AS high,
        min(l_extendedprice / l_quantity) AS low, {_by('max', *order, d)} AS close, sum(l_quantity) AS volume
      FROM {lineitem} GROUP BY l_returnflag, l_shipdate"""
    return f"SELECT dataset_id, bar_index, ts_ms, open, high, low, close, volume FROM ({numbered(d, rows, DAY)}) b"


def resample(d: Dialect, bars: str, n: int = 4) -> str:
    """n bars to one: first open, max high, min low, last close, summed volume; a short tail is dropped."""
    return f"""
    SELECT dataset_id, {d.div('bar_index', str(n))} AS bar_index, min(ts_ms) AS ts_ms, {'arg_min' if d.duck else 'min_by'}(open, bar_index) AS open, max(high) AS high, min(low) AS low,
      {'arg_max' if d.duck else 'max_by'}(close, bar_index) AS close, sum(volume) AS volume
    FROM {bars} GROUP BY dataset_id, {d.div('bar_index', str(n))} HAVING count(*) = {n}"""


def facts(d: Dialect, bars: str) -> str:
    """Rows, date range and bar interval (upper median of the first 49 steps) of each dataset."""
    return f"""
    SELECT dataset_id, count(*) AS row_count, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms,
      coalesce({d.at(d.sorted(d.items('step')), "floor(count(step) / 2e0) + 1")}, 60000) AS interval_ms
    FROM (SELECT dataset_id, ts_ms, CASE WHEN bar_index BETWEEN 1 AND 49 THEN ts_ms - lag(ts_ms) OVER ({ORDER}) END AS step FROM {bars}) s
    GROUP BY dataset_id"""


def timeframe(d: Dialect, facts_: str) -> str:
    """Label of each dataset's interval: whole minutes within 8 per cent, then w, d, h or m."""
    t = d.text_type
    return f"""
    SELECT dataset_id, interval_ms, CASE
        WHEN m < 1 OR abs(interval_ms / 60000e0 - m) / m > 0.08e0 THEN 'unknown'
        WHEN m % 10080 = 0 THEN concat(cast({d.div('m', '10080')} AS {t}), 'w') WHEN m % 1440 = 0 THEN concat(cast({d.div('m', '1440')} AS {t}), 'd')
        WHEN m % 60 = 0 THEN concat(cast({d.div('m', '60')} AS {t}), 'h') ELSE concat(cast(m AS {t}), 'm') END AS timeframe
    FROM (SELECT dataset_id, interval_ms, cast(round(interval_ms / 60000e0) AS bigint) AS m FROM {facts_}) f"""


def preview(d: Dialect, bars: str, rows: int = 15) -> str:
    """The first rows of each dataset."""
    return f"SELECT dataset_id, bar_index, ts_ms, open, high, low, close, volume FROM {bars} WHERE bar_index < {rows}"


def rescale(d: Dialect, bars: str, factor: float = 100.0) -> str:
    """Prices multiplied by a constant."""
    return f"SELECT dataset_id, bar_index, ts_ms, open * {factor}e0 AS open, high * {factor}e0 AS high, low * {factor}e0 AS low, close * {factor}e0 AS close, volume FROM {bars}"


def calibration(d: Dialect, bars: str) -> str:
    """Deviation of returns, mean and upper median of true range in per cent, deviation of opening gaps."""
    return f"""
    SELECT dataset_id, round(stddev_pop(r), 6) AS return_sd, round(avg(tr), 4) AS mean_tr_pct, round({d.at(d.sorted(d.items('tr')), 'floor(count(tr) / 2e0) + 1')}, 4) AS median_tr_pct, round(stddev_pop(gap), 6) AS gap_sd
    FROM (
      SELECT dataset_id, CASE WHEN p > 0 THEN close / p - 1 END AS r, CASE WHEN p > 0 THEN greatest(high - low, abs(high - p), abs(low - p)) / p * 100 END AS tr, CASE WHEN p > 0 THEN open / p - 1 END AS gap
      FROM ({split(d, bars, 1, lambda b: f"SELECT *, lag(close) OVER ({ORDER}) AS p FROM {b}")}) a
    ) b GROUP BY dataset_id"""
