"""Golden trades on constructed bars, search statistics against plain Python, and optimizer gates."""

from math import isnan, log10
from struct import pack

import duckdb
import pandas as pd
import pytest

from patternloom import oracles, registry
from patternloom.operators import patterns as pt
from patternloom.operators import trades as tr
from patternloom.plans.dual import DUCKDB, SPARK
from patternloom.sources.bars import tick_bars
from patternloom.sources.shared import written

FLAT = [(100.0, 100.5, 99.5, 100.0), (100.0, 101.5, 99.6, 101.0), (100.0, 101.0, 99.8, 100.5)]


def world(spark, rows, conds, x=None):
    """Bars as a relation and the evaluated table over given conditions."""
    bars = pd.DataFrame(rows, columns=["open", "high", "low", "close"]).astype(float)
    bars.insert(0, "dataset_id", "d")
    bars.insert(1, "bar_index", range(len(bars)))
    bars.insert(2, "ts_ms", [1_767_605_400_000 + 3_600_000 * k for k in range(len(bars))])
    bars["volume"], bars["users"] = 100.0, [float(v) for v in (x or range(len(bars)))]
    b = spark.createDataFrame(bars)
    ev = spark.createDataFrame([("d", k, len(bars), [int(v) for v in c]) for k, c in enumerate(conds)], "dataset_id string, bar_index long, c long, conds array<long>")
    return b, ev, spark.sql(tr.paths(SPARK, "{bars} b", "{ev}"), bars=b, ev=ev)


def trade(spark, rows, conds, settings, direction="bullish", pattern=1, cost=0.0, x=None):
    b, ev, paths = world(spark, rows, conds, x)
    systems = spark.createDataFrame([("d", pattern, direction)], "dataset_id string, pattern_id long, direction string")
    text = tr.outcomes(SPARK, "{evt}", "SELECT * FROM {systems}", settings, [("whole", 0.0, 1.0, cost)])
    made = spark.sql(tr.taken(SPARK, text), evt=ev, systems=systems, paths=paths)
    facts = spark.sql(tr.results(SPARK, "SELECT * FROM {made}"), made=made).first()
    return made.orderBy("cfg", "i").collect(), facts


def test_one_trade_one_overlap(spark):
    rows, facts = trade(spark, FLAT, [[0], [0], []], [tr.setting(0, "next-open", ("fixed-percent", 1), ("risk-multiple", 1), 1)])
    assert [(r.state, r.result) for r in rows if r.state == "trade"] == [("trade", "target")]
    assert (facts.trades, facts.overlapping) == (1, 1) and facts.net_profit == pytest.approx(500)


def test_time_exit(spark):
    rows, facts = trade(spark, FLAT, [[0], [], []], [tr.setting(0, "next-open", ("fixed-percent", 5), ("time-only", 0), 1)])
    assert facts.trades == 1 and [r.result for r in rows] == ["time"]


def test_exits_of_each_mode(spark):
    up = [(100 + k, 101.5 + k, 99.0 + k, 101.0 + k) for k in range(60)]
    conds = [[0] if k in (40, 41, 42, 43) else [] for k in range(60)]

    settings = [
        tr.setting(0, "next-open", ("fixed-percent", 50), ("signal-invalidation", 0), 5), tr.setting(1, "next-open", ("fixed-percent", 50), ("feature-event", 0), 5, ("cross-above", 42.5)), tr.setting(2, "next-open", ("fixed-percent", 50), ("time-only", 0), 5), tr.setting(3, "signal-close", ("fixed-percent", 50), ("time-only", 0), 5),
        tr.setting(4, "next-open", ("fixed-percent", 0.5), ("risk-multiple", 1), 5), tr.setting(5, "next-open", ("atr-multiple", 2), ("atr-multiple", 1), 5), tr.setting(6, "next-open", ("price-level", 0), ("time-only", 0), 5), tr.setting(7, "next-open", ("fixed-percent", 1), ("price-level", 0), 5), tr.setting(8, "box-boundary-limit", ("fixed-percent", 1), ("box-midpoint", 0), 5),
    ]
    rows, _ = trade(spark, up, conds, settings)
    at = {r.cfg: r for r in rows if r.i == 40}
    assert [at[k].exit_index for k in range(4)] == [44, 43, 46, 45]
    assert at[4].result == "ambiguous" and at[5].result == "target" and at[5].r == pytest.approx(0.5, abs=0.01)
    assert at[6].state == "trade" and at[7].state == "unfilled" and at[8].state in ("unfilled", "trade")  # the box lies below the entry
    rows, _ = trade(spark, up, conds, [tr.setting(0, "next-open", ("fixed-percent", 1), ("time-only", 0), 5)], "bearish")
    assert next(r for r in rows if r.i == 40).result == "stop"


def test_bars_that_meet_stop_or_target_exactly(spark):
    settings = [tr.setting(0, "next-open", ("fixed-percent", 40), ("time-only", 0), 2), tr.setting(1, "next-open", ("fixed-percent", 80), ("fixed-percent", 40), 2)]
    bars = [(1.5, 1.5, 1.5, 1.5), (1.5, 1.6, 1.4, 1.5), (1.5, 1.6, 0.9, 1.5), (1.5, 1.6, 1.4, 1.5), (1.5, 1.6, 1.4, 1.5)]
    long, _ = trade(spark, bars, [[0], [], [], [], []], settings)
    short, _ = trade(spark, bars, [[0], [], [], [], []], settings, "bearish")
    assert [(r.result, r.exit_index) for r in (long[0], short[1])] == [("stop", 2), ("target", 2)]


def test_an_entry_at_zero_is_filled_and_has_no_r(spark):
    settings = [tr.setting(0, "next-open", ("fixed-percent", 20), ("risk-multiple", 1), 2), tr.setting(1, "next-open", ("atr-multiple", 1), ("fixed-percent", 20), 2)]
    bars = [(1.0, 1.0, 1.0, 1.0), (0.0, 2.0, 0.0, 1.0), (1.0, 2.0, 0.5, 1.0), (1.0, 2.0, 0.5, 1.0), (1.0, 2.0, 0.5, 1.0)]
    rows, facts = trade(spark, bars, [[0], [0], [0], [], []], settings)
    assert [(r.cfg, r.i, r.state, r.result, r.exit_index, isnan(r.r)) for r in rows if r.i == 0] == [(0, 0, "trade", "stop", 1, True), (1, 0, "trade", "ambiguous", 1, True)]
    assert isnan(facts.expectancy_r) and isnan(facts.net_profit)
    got = spark.sql(f"SELECT {registry.columns(SPARK, '~v')} FROM VALUES (double('NaN')), (double('-Infinity')), (1e300), (1.00005e0), (cast(NULL AS double)) AS t(v)").collect()
    assert [str(r.v) for r in got] == ["nan", "-inf", "1e+300", "1.0001", "None"]


def test_a_missing_r_of_a_stored_table_is_the_nan_of_the_sql(spark):
    bits = lambda v: pack(">d", v).hex()
    stored = written(spark.sql("SELECT double('NaN') AS r"))
    sql = duckdb.execute(f"SELECT {registry.columns(DUCKDB, '~r')} FROM (SELECT x / x AS r FROM (SELECT i * 0e0 AS x FROM range(1) t(i)) a) b").fetchall()
    assert bits(spark.sql(f"SELECT {registry.columns(SPARK, '~r')} FROM {{stored}}", stored=stored).first().r) == bits(sql[0][0])


def test_trades_at_zero_equal_the_sql_bit_by_bit(spark, tmp_path):
    """Every setting both ways over hours that open or close at 0: the same trades as in the SQL, NaN with its sign."""
    file, con = f"{tmp_path}/events.parquet", duckdb.connect()
    con.execute(f"COPY (SELECT h * 3 + k AS event_id, make_timestamp((1704067200 + h * 3600 + k * 900) * 1000000) AS ts, h % 4 + k AS user_id, 'd' AS event_type, CASE WHEN (h * 3 + k) % 11 = 0 THEN 0e0 ELSE (h * 7 + k * 5) % 13 + 1e0 END AS value, '{{}}' AS props FROM range(90) a(h), range(3) b(k)) TO '{file}' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{file}'")
    ways, out = [(1, "bullish"), (2, "bearish")], "pattern_id cfg i exit_index state result ~r:unsigned"
    body = f"ev AS (SELECT dataset_id, bar_index, count(*) OVER () AS c, [0, 1] AS conds FROM ({tick_bars(DUCKDB, 'events')}) b), hit AS (SELECT dataset_id AS ds, bar_index AS b, c, unnest(conds) + 1 AS pid FROM ev), pat AS (SELECT 'd' AS ds, pid, dir FROM {DUCKDB.values(ways, 'pid, dir')} w), placed AS (SELECT ds, pid FROM pat), held AS (SELECT ds, pid, 'none' AS why FROM pat), {oracles._WALK}"
    sql = con.execute(f"SELECT {registry.columns(DUCKDB, out)} FROM (WITH RECURSIVE {body} {oracles.TRADES[oracles.TRADES.rindex('SELECT ds'):]}) q").fetchall()
    b = spark.sql(tick_bars(SPARK, "{events}"), events=spark.read.parquet(file)).cache()
    ev = spark.sql("SELECT dataset_id, bar_index, count(*) OVER (PARTITION BY dataset_id) AS c, array(0L, 1L) AS conds FROM {b}", b=b)
    systems = spark.createDataFrame([("d", *w) for w in ways], "dataset_id string, pattern_id long, direction string")
    text = tr.outcomes(SPARK, "{evt}", "SELECT * FROM {systems}", tr.SETTINGS)
    made = written(spark.sql(tr.taken(SPARK, text), evt=ev, systems=systems, paths=written(spark.sql(tr.paths(SPARK, "{b} b", "{evt}"), b=b, evt=ev))))
    got = spark.sql(f"SELECT {registry.columns(SPARK, out)} FROM {{made}} WHERE state = 'trade'", made=made).collect()
    bits = lambda rows: sorted((*r[:-1], pack(">d", r[-1]).hex()) for r in rows)
    assert bits(got) == bits(sql)
    assert {pack(">d", r[-1]).hex() for r in sql if isnan(r[-1])} == {"7ff8000000000000", "fff8000000000000"}


def test_wilder_blocks_equal_the_recursion(spark):
    rows = [(10 + (i * 7) % 13, 14 + (i * 7) % 13, 6 + (i * 5) % 11, 9 + (i * 3) % 12) for i in range(400)]
    b, _, _ = world(spark, rows, [[]] * 400)
    got = {r.bar_index: r.atr for r in spark.sql(tr.wilder(SPARK, "{b}", block=128), b=b).collect()}
    tr_ = [max(h - lo, abs(h - (rows[k - 1][3] if k else c)), abs(lo - (rows[k - 1][3] if k else c))) for k, (_, h, lo, c) in enumerate(rows)]
    value = sum(tr_[:14]) / 14
    assert got[12] is None and got[13] == pytest.approx(value)
    for k in range(14, 400):
        value = (value * 13 + tr_[k]) / 14
        assert got[k] == pytest.approx(value, rel=1e-6)  # (13 / 14) ** 256 of what lies before two blocks is left out


def test_refinement_stays_within_families_and_bounds():
    first = tr.coarse()
    more = tr.refined(first[:4], first)
    assert 0 < len(more) <= tr.MOST and len({r[1:] for r in first + more}) == len(first) + len(more)
    assert [r[0] for r in more] == list(range(len(first), len(first) + len(more)))
    assert {r[5] for r in more} <= set(tr.TARGETS) and {r[1] for r in more} <= set(tr.ENTRIES)


def test_modes_of_the_registered_settings():
    assert {s[1] for s in tr.SETTINGS} == set(tr.ENTRIES) and {s[3] for s in tr.SETTINGS} == set(tr.STOPS) and {s[5] for s in tr.SETTINGS} == set(tr.TARGETS)


# ------------------------------------------------------------------ search statistics in plain Python


def search_world(n=420):
    """Close-only bars of one target; condition 0 on every third bar is mostly followed by a rise."""
    import random

    r = random.Random(5)
    close, rows = 100.0, []
    for k in range(n):
        drift = 0.8 if k % 3 == 1 else -0.25
        nxt = close * (1 + (drift + r.uniform(-0.9, 0.9)) / 100)
        rows.append((close, max(close, nxt) * 1.001, min(close, nxt) * 0.999, nxt))
        close = nxt
    conds = [[c for c, yes in enumerate((k % 3 == 0, k % 2 == 0, r.random() < 0.5)) if yes] for k in range(n)]
    return rows, conds


def test_search_statistics_equal_plain_python(spark):
    rows, conds = search_world()
    n, h = len(rows), 12
    move = [(rows[k + h][3] - rows[k][3]) / rows[k][3] * 100 if k + h < n else None for k in range(n)]
    ev = spark.createDataFrame(
        [("d", k, n, 0, "bull", float(rows[k + h][3] - rows[k][3]) if k + h < n else None, move[k], 1.0, 1.0, conds[k]) for k in range(n)],
        "dataset_id string, bar_index long, c long, ts_ms long, market string, dx double, r12 double, u12 double, w12 double, conds array<long>")
    got = {r.pattern_id: r for r in spark.sql(pt.scores(SPARK, "{t}"), t=ev).collect()}
    from itertools import combinations

    bars = [k for k in range(n) if move[k] is not None]
    base = {"bullish": sum(move[k] > 0 for k in bars) / len(bars) * 100, "bearish": sum(move[k] < 0 for k in bars) / len(bars) * 100}
    seen = set()
    for size in (1, 2, 3):
        for combo in combinations(range(3), size):
            hit = [k for k in bars if set(combo) <= set(conds[k])]
            if not hit:
                continue
            pid = 0
            for c in combo:
                pid = pid * 21 + c + 1
            ups, downs = sum(move[k] > 0 for k in hit), sum(move[k] < 0 for k in hit)
            way = "bullish" if ups >= downs else "bearish"
            win = max(ups, downs) / len(hit) * 100
            margin = win - base[way]
            r = got[pid]
            seen.add(pid)
            assert (r.n, r.direction) == (len(hit), way) and r.win_rate == pytest.approx(win) and r.baseline == pytest.approx(base[way])
            assert r.score == pytest.approx(0.4 * log10(max(10, len(hit))) / 4 + 0.6 * max(0, margin) / 25)
    assert seen == set(got)


def test_held_patterns_are_exactly_the_shortlist(spark):
    """Twelve held, one degraded and one not tested: the shortlist holds the twelve."""
    ranked = spark.createDataFrame([("d", k, 12, 50 + k, 20, 60.0, 10.0, 0.5 + k / 100, k) for k in range(1, 15)], "dataset_id string, pattern_id long, h long, n long, trades long, win_rate double, lift double, score double, rk long")
    held = spark.createDataFrame([("d", k, "held" if k <= 12 else "degraded") for k in range(1, 14)], "dataset_id string, pattern_id long, status string")
    rows = spark.sql(pt.shortlist(SPARK, "{ev}"), ranked=ranked, held_up=held).orderBy("pos").collect()
    assert [r.pattern_id for r in rows] == list(range(12, 0, -1))
    top = rows[0]
    assert top.priority == pytest.approx(0.62 + log10(63) + log10(21) + 0.5 - 0.08)
