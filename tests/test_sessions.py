"""Sessions with prior daily ATR, sources of instruments, confluence of intervals."""

from patternloom.operators import sessions as ses
from patternloom.plans.dual import SPARK, on

HOUR, DAY = 3_600_000, 86_400_000
MONDAY = 1_767_571_200_000  # 2026-01-05 00:00 UTC; New York opens at 14:30 UTC


def table(spark, rows):
    return spark.createDataFrame(rows, "dataset_id string, bar_index long, ts_ms long, open double, high double, low double, close double, volume double")


def days(n, first, ds="d", spread=lambda k: 2.0):
    return [(ds, k, first + k * DAY, 10.0, 10.0 + spread(k), 10.0, 10.0, 1.0) for k in range(n)]


def session(n, day, ds="d", start=0):
    return [(ds, start + k, day + 14 * HOUR + HOUR // 2 + k * HOUR // 4, 10.0, 11.0, 9.0, 10.0, 1.0) for k in range(n)]


def test_prior_atr_by_start_and_strictly_by_end(spark):
    # 15 daily bars, the last one begins on the session's own day
    daily = table(spark, days(15, MONDAY - 14 * DAY, spread=lambda k: 16.0 if k == 14 else 2.0))
    bars = table(spark, session(7, MONDAY))
    row = on(ses.usable_sessions, bars, daily).first()
    assert (row.bars, row.open_ms, row.prior_atr, row.completed_atr) == (7, MONDAY + 14 * HOUR + HOUR // 2, 3.0, 2.0)


def test_short_sessions_and_unknown_ranges_are_left_out(spark):
    daily = table(spark, days(14, MONDAY - 13 * DAY))
    bars = table(spark, session(5, MONDAY) + session(6, MONDAY + DAY, start=5) + session(6, MONDAY, ds="alone"))
    rows = on(ses.usable_sessions, bars, daily).collect()
    assert [(r.dataset_id, r.open_ms) for r in rows] == [("d", MONDAY + DAY + 14 * HOUR + HOUR // 2)]
    fewer = table(spark, days(13, MONDAY - 12 * DAY))
    assert on(ses.usable_sessions, bars, fewer).isEmpty() and on(ses.usable_sessions, bars, daily.limit(0)).isEmpty()


def test_sources_of_an_instrument(spark):
    rows = [("x", "x@15m", 9, 900_000), ("x", "x@1h", 9, HOUR), ("x", "x@1d", 9, DAY), ("x", "x@1w", 9, 7 * DAY), ("y", "y@1h", 9, HOUR), ("y", "y@again", 9, HOUR)]
    df = spark.createDataFrame(rows, "instrument string, dataset_id string, row_count long, interval_ms long")
    got = {r.dataset_id: (r.daily_source, r.inner_source) for r in spark.sql(ses.source_choice(SPARK, "SELECT * FROM {m}"), m=df).collect()}
    assert got == {"x@15m": ("x@1d", None), "x@1h": ("x@1d", "x@15m"), "x@1d": ("x@1d", "x@15m"), "x@1w": ("x@1d", "x@15m"), "y@1h": (None, None), "y@again": (None, None)}


def test_confluence_counts_origins(spark):
    quarter = table(spark, [("d", k, MONDAY + k * HOUR // 4, 10.0, 12.0, 9.0, 11.0, 1.0) for k in range(8)])
    hours = table(spark, [("d", k, MONDAY + k * HOUR, 11.0, 12.0, 9.0, 10.0, 1.0) for k in range(2)])
    got = {(r.a, r.b): (r.origins, r.accepted, r.n) for r in on(ses.confluence, quarter, hours, lower_ms=HOUR // 4, higher_ms=HOUR).collect()}
    assert got["lo_candle_direction=Up", "hi_candle_direction=Down"] == (2, True, 5)
    assert got["lo_candle_direction=Up", "lo_rvol_bucket=Normal"] == (1, False, 8)
