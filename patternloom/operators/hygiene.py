"""Feature hygiene and catalogue facts."""

from __future__ import annotations

from patternloom.plans.dual import Dialect

COLUMNS = ("open", "close", "volume", "avg_value", "users", "k")


def presence(d: Dialect, bars: str) -> str:
    """Columns that are too sparse (under 5 rows or 1 per cent) or constant."""
    each = " UNION ALL ".join(f"SELECT dataset_id, '{c}' AS feature, count({c}) AS present, count(DISTINCT {c}) AS kinds, count(*) AS n FROM {bars} GROUP BY dataset_id" for c in COLUMNS)
    return f"SELECT dataset_id, feature, present, kinds >= 2 AND present >= greatest(5, n * 0.01e0) AS kept FROM ({each}) e"


def duplicates(d: Dialect, bars: str) -> str:
    """Pairs of columns that are equal on every bar."""
    pairs = [(a, b) for i, a in enumerate(COLUMNS) for b in COLUMNS[i + 1 :]]
    each = " UNION ALL ".join(f"SELECT dataset_id, '{a}' AS a, '{b}' AS b, sum(CASE WHEN {a} = {b} OR ({a} IS NULL AND {b} IS NULL) THEN 0 ELSE 1 END) AS differ FROM {bars} GROUP BY dataset_id" for a, b in pairs)
    return f"SELECT dataset_id, a, b FROM ({each}) e WHERE differ = 0"


def statistics(d: Dialect, bars: str, x: str) -> str:
    """Minimum, maximum, mean and quartiles, the quartiles at index floor(p * n)."""
    q = lambda p: d.at("v", f"least(floor({d.size('v')} * {p}e0), {d.size('v')} - 1) + 1")
    return f"SELECT dataset_id, lo, hi, mean, {q(0.25)} AS p25, {q(0.5)} AS p50, {q(0.75)} AS p75 FROM (SELECT dataset_id, min({x}) AS lo, max({x}) AS hi, avg({x}) AS mean, {d.sorted(d.items(x))} AS v FROM {bars} GROUP BY dataset_id) a"


def distribution(d: Dialect, features: str, x: str, buckets: tuple[str, ...]) -> str:
    """Count and share of each known bucket, zero where it never occurs."""
    return f"""
    SELECT b.bucket, count(f.{x}) AS n, count(f.{x}) * 100e0 / max(t.c) AS pct
    FROM {d.values([(v,) for v in buckets], 'bucket')} b LEFT JOIN ({features}) f ON b.bucket = f.{x} CROSS JOIN (SELECT count(*) AS c FROM ({features}) g) t GROUP BY b.bucket"""


def observed(d: Dialect, bars: str) -> str:
    """Observed range of each column."""
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, min({c}) AS lo, max({c}) AS hi FROM {bars}" for c in COLUMNS)
