"""Coverage of patterns: the middle match from counts of stretches, flags, zeros."""

import pytest

from patternloom.operators import coverage as cov
from patternloom.operators import patterns as pt

HOUR, DAY = 3_600_000, 86_400_000
EV = "dataset_id string, bar_index long, ts_ms long, r1 double, r12 double, conds array<bigint>"
EVALUATED = "dataset_id string, pattern_id long, n long, win_rate double, avg_move double, direction string"


def bars(ds, moves, step=HOUR, conds=lambda i: [0]):
    return [(ds, i, i * step, r, 1.0, conds(i)) for i, r in enumerate(moves)]


def planned(spark, text, rows, evaluated=()):
    tables = {"ev": spark.createDataFrame(rows, EV), "evaluate": spark.createDataFrame(list(evaluated), EVALUATED)}
    body = text("{ev}", "(" + cov.spans("{ev}") + ") s")
    return spark.sql(body, **{k: v for k, v in tables.items() if "{" + k + "}" in body})


def counted(rows, key):
    """Halves by sorting all matches of a pattern."""
    groups = {}
    for ds, _, ts, r1, _, conds in rows:
        for c in conds:
            groups.setdefault((ds, c + 1) if key == "dataset_id, pattern_id" else (c + 1,), []).append((ts, ds, r1 or 0.0))
    out = set()
    for k, matches in groups.items():
        moves = [r for *_, r in sorted(matches)]
        half = len(moves) // 2
        out.add((*k, len(moves), half, sum(r > 0 for r in moves), sum(r < 0 for r in moves), sum(r > 0 for r in moves[:half]), sum(r < 0 for r in moves[:half])))
    return out


@pytest.mark.parametrize("key", ["dataset_id, pattern_id", "pattern_id"])
@pytest.mark.parametrize("stretch", [HOUR, 7 * HOUR, 30 * DAY])
def test_halves_of_any_stretch_equal_counting(spark, monkeypatch, key, stretch):
    monkeypatch.setattr(cov, "STRETCH", stretch)
    moves = [(i * 37 % 11) - 5.0 if i % 9 else None for i in range(101)]
    rows = bars("a", moves, conds=lambda i: [0] if i % 3 else [0, 1][: 1 + i % 2]) + bars("b", moves[:40]) + bars("c", [1.0], conds=lambda i: [4])
    # patterns of single conditions only: no bar's two conditions make a third row of ours
    got = {tuple(r) for r in planned(spark, lambda ev, s: cov.halves(ev, s, key), rows).where(f"pattern_id < {pt.BASE}").collect()}
    assert got == counted(rows, key)


def test_flags_of_few_and_concentrated_matches(spark):
    rows = bars("a", [1.0] * 20 + [-1.0] * 20 + [0.0] * 200, conds=lambda i: [0] if i < 40 else []) + bars("b", [1.0] * 10)
    told = {r.dataset_id: r for r in planned(spark, cov.flagged, rows, [("a", 1, 40, 60.0, 1.0, "bullish"), ("b", 1, 10, 60.0, 1.0, "bullish")]).collect()}
    assert (told["a"].early_win, told["a"].late_win, told["a"].steady) == (100.0, 0.0, False)
    assert told["a"].flags == "symbol-specific,timeframe-specific,concentrated-in-short-period"
    assert told["b"].flags == "symbol-specific,timeframe-specific,few-occurrences" and told["b"].steady


def test_pooled_needs_two_symbols_with_enough_matches(spark):
    rows = bars("a", [1.0] * 30) + bars("b", [1.0] * 30) + bars("c", [1.0] * 5)
    own = lambda a, b, c: [("a", 1, 30, a, 1.0, "bullish"), ("b", 1, 30, b, 2.0, "bullish"), ("c", 1, 5, c, 3.0, "bullish")]
    broad = lambda *w: planned(spark, cov.pooled, rows, own(*w)).first()
    assert broad(60.0, 70.0, 10.0).broad and not broad(60.0, 71.0, 60.0).broad
    row = broad(60.0, 70.0, 20.0)
    assert (row.symbols, row.n, row.equal_rate, row.flags) == (3, 65, 50.0, "timeframe-specific") and abs(row.win_rate - 4000 / 65) < 1e-9


def test_symbols_without_matches_are_rows_of_zeros(spark):
    rows = bars("a", [1.0] * 3) + bars("b", [1.0] * 3, conds=lambda i: [])
    text = cov.per_symbol("{ev}")
    got = spark.sql(text, ev=spark.createDataFrame(rows, EV), evaluate=spark.createDataFrame([("a", 1, 3, 100.0, 1.0, "bullish")], EVALUATED)).collect()
    assert {tuple(r) for r in got} == {("a", 1, 3, 100.0, 1.0), ("b", 1, 0, 0.0, 0.0)}


def test_periods_split_at_the_turn_of_the_year(spark):
    turn = 1_735_689_600_000  # 2025-01-01
    rows = [("a", i, turn + (i - 3) * HOUR, 1.0, 1.0, [0]) for i in range(10)]
    got = {(r.dataset_id, r.y): (r.n, r.share) for r in planned(spark, cov.periods, rows).collect()}
    assert got == {(d, y): (n, n * 10.0) for d in ("a", "*") for y, n in ((2024, 3), (2025, 7), (0, 10))}
