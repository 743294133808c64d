"""Events of several datasets that fall together in time, and how strongly.

The dataset with the fewest events drives; each of its events takes the nearest event of every
other dataset within a tolerance.  Events are bucketed by the tolerance, so only neighbouring
buckets meet.
"""

from __future__ import annotations

from patternloom.plans.dual import Dialect
from patternloom.sources.bars import HOUR, ORDER

TOLERANCE = HOUR // 2


def events(d: Dialect, bars: str, k: float = 1.0) -> str:
    """Events of every dataset: the close crosses its mean plus or minus k deviations; rising and falling bars."""
    base = f"SELECT *, lag(close) OVER ({ORDER}) AS p, avg(close) OVER (PARTITION BY dataset_id) AS m, stddev_pop(close) OVER (PARTITION BY dataset_id) AS s FROM {bars}"
    kinds = [("cross above", f"close > m + {k}e0 * s AND p <= m + {k}e0 * s"), ("cross below", f"close < m - {k}e0 * s AND p >= m - {k}e0 * s"), ("bullish bar", "close > open"), ("bearish bar", "close < open")]
    made = ", ".join(f"CASE WHEN {test} THEN cast({n} AS bigint) END" for n, (_, test) in enumerate(kinds))
    name = "CASE kind_no " + " ".join(f"WHEN {n} THEN '{x}'" for n, (x, _) in enumerate(kinds)) + " END"
    return f"SELECT dataset_id, bar_index * 4 + kind_no AS event_id, ts_ms AS moment, {name} AS kind FROM (SELECT dataset_id, bar_index, ts_ms, {'unnest' if d.duck else 'explode'}({f'[{made}]' if d.duck else f'array({made})'}) AS kind_no FROM ({base}) b) a WHERE kind_no IS NOT NULL"


def counts(d: Dialect, bars: str) -> str:
    """Events of each dataset, the driver first."""
    return f"SELECT dataset_id, n, sum(n) OVER () AS total, count(*) OVER () AS datasets, row_number() OVER (ORDER BY n, dataset_id) = 1 AS driver FROM (SELECT dataset_id, count(*) AS n FROM ({events(d, bars)}) e GROUP BY dataset_id) c"


def coincidences(d: Dialect, bars: str, tolerance: int = TOLERANCE) -> str:
    """Each driver event with the nearest event of each other dataset; of equals the later one."""
    e = f"SELECT e.*, c.driver FROM ({events(d, bars)}) e JOIN ({counts(d, bars)}) c ON e.dataset_id = c.dataset_id"
    return f"""
    SELECT event_id, moment, driver_id, dataset_id, other_id, other_moment, distance FROM (
      SELECT a.event_id, a.moment, a.dataset_id AS driver_id, b.dataset_id, b.event_id AS other_id, b.moment AS other_moment, abs(a.moment - b.moment) AS distance, row_number() OVER (PARTITION BY a.event_id, b.dataset_id ORDER BY abs(a.moment - b.moment), b.moment DESC, b.event_id DESC) AS rn
      FROM (SELECT x.*, {d.div('moment', str(tolerance))} + o.o AS bucket FROM ({e}) x CROSS JOIN {d.values([(-1,), (0,), (1,)], 'o')} o WHERE driver) a
      JOIN (SELECT y.*, {d.div('moment', str(tolerance))} AS bucket FROM ({e}) y WHERE NOT driver) b ON a.bucket = b.bucket AND abs(a.moment - b.moment) <= {tolerance}
    ) x WHERE rn = 1"""


def strengths(d: Dialect, bars: str, tolerance: int = TOLERANCE) -> str:
    """Strength of each coincidence: tightness, coverage and rarity, at most 1, and its band; those below 0.1 are left out."""
    rarity = "least(1e0, coverage * tight / sqrt(greatest(1e0, total * 1e0 / datasets) / 100))"
    return f"""
    SELECT *, CASE WHEN strength >= 0.66e0 THEN 'High' WHEN strength >= 0.33e0 THEN 'Medium' ELSE 'Low' END AS band
    FROM (
      SELECT event_id, moment, contributors, least(1e0, 0.45e0 * tight + 0.4e0 * coverage + 0.15e0 * {rarity}) AS strength
      FROM (
        SELECT p.event_id, p.moment, count(*) + 1 AS contributors, (count(*) + 1) * 1e0 / max(c.datasets) AS coverage, greatest(0e0, 1 - coalesce(avg(CASE WHEN p.distance > 0 THEN p.distance END), 0e0) / {tolerance}) AS tight, max(c.total) AS total, max(c.datasets) AS datasets
        FROM ({coincidences(d, bars, tolerance)}) p JOIN ({counts(d, bars)}) c ON p.driver_id = c.dataset_id GROUP BY p.event_id, p.moment
      ) a
    ) b WHERE strength >= 0.1e0"""


def order_of_events(d: Dialect, bars: str) -> str:
    """Which dataset's event came first in each coincidence, by time; at one time the driver's."""
    all_ = f"SELECT event_id, driver_id AS dataset_id, moment AS happened, 0 AS side FROM ({coincidences(d, bars)}) p UNION SELECT event_id, dataset_id, other_moment, 1 FROM ({coincidences(d, bars)}) q"
    return f"SELECT event_id, dataset_id, happened, row_number() OVER (PARTITION BY event_id ORDER BY happened, side, dataset_id) AS place FROM ({all_}) a"


def contributions(d: Dialect, bars: str) -> str:
    """One event per dataset and coincidence, coincidences by strength."""
    return f"SELECT s.event_id, p.dataset_id, p.other_id, dense_rank() OVER (ORDER BY floor(s.strength * 1e9) DESC, s.event_id) AS place FROM ({strengths(d, bars)}) s JOIN ({coincidences(d, bars)}) p ON s.event_id = p.event_id"
