"""Level-wise search, eligibility and first passage against brute force on small tables."""

import random
from itertools import combinations

import pytest

from patternloom.operators import conjunctions as cj
from patternloom.operators import passage as ps
from patternloom.plans.dual import SPARK
from tests.test_features import make


def test_names_that_drift(spark):
    names = {"session vwap": True, "upper band": True, "bb_lower": True, "OBV": True, "daily avg high": True, "Close Price": True, "distance from resistance pct": False, "upper": True, "bandwidth ratio": False, "percent b": False, "close": False, "trend_slope": True, "price_level": True, "upper bandage": False, "monthly open": True, "z score of price": False}
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name: r.d for r in spark.sql(f"SELECT name, {cj.drifting(SPARK, 'name', 'true')} AS d FROM {{t}}", t=rows).collect()}
    assert got == names
    assert not spark.sql(f"SELECT {cj.drifting(SPARK, 'name', 'false')} AS d FROM {{t}} WHERE name = 'upper'", t=rows).first().d


@pytest.fixture(scope="module")
def searched(spark):
    """Long features and outcomes of two datasets, and the stored tables of the search over them."""
    r = random.Random(11)
    rows, out = [], []
    for ds in ("a", "b"):
        for b in range(400):
            x = r.random()
            rows += [(ds, b, "x", x, None), (ds, b, "nearly", x + 0.0001 * r.random(), None), (ds, b, "y", float(r.randrange(3)), None), (ds, b, "kind", None, "up" if x > 0.55 else r.choice(["up", "down", "flat"]))]
            out.append((ds, b, 400, None if b >= 388 else round(r.gauss(0.4 if x > 0.5 else -0.3, 1), 3)))
    t = {"long": spark.createDataFrame(rows, "dataset_id string, bar_index long, feature string, num double, txt string"), "ev": spark.createDataFrame(out, "dataset_id string, bar_index long, c long, r12 double")}
    run = lambda text: spark.sql(text, **t).cache()
    t["met"] = run(cj.met("{long}", "{ev}"))
    t["frequent"] = spark.sql(cj.frequent("{met}", 20), **t).cache()
    t["words"] = spark.sql(cj.words("{met}", "{frequent}"), **t).cache()
    t["pairs"] = spark.sql(cj.pairs("{words}", 20), **t).cache()
    t["found"] = spark.sql(cj.levels("{words}", "{pairs}", "{frequent}", 20), **t).cache()
    made = spark.sql(cj.made(SPARK, "{long}"), **t).collect()
    value = {(ds, b, f): n if n is not None else s for ds, b, f, n, s in rows}
    test = {"lt": lambda v, m: v < m.v, "gt": lambda v, m: v > m.v, "eq": lambda v, m: v == m.v, "neq": lambda v, m: v != m.v, "is": lambda v, m: v == m.t}
    done = {(ds, b): y for ds, b, _, y in out if y is not None}
    held = {}
    for m in made:
        held[m.dataset_id, m.cond] = (m.feature, {b for (ds, b) in done if ds == m.dataset_id and test[m.op](value[ds, b, m.feature], m)})
    return t, held, done


def test_levels_equal_brute_force(spark, searched):
    t, held, done = searched
    want = {}
    for ds in ("a", "b"):
        own = sorted((c, f, bs) for (d, c), (f, bs) in held.items() if d == ds)
        for k in (1, 2, 3):
            for some in combinations(own, k):
                bars = set.intersection(*[s[2] for s in some])
                if len({s[1] for s in some}) == k and len(bars) >= 20:
                    want[ds, " + ".join(s[0] for s in some)] = (k, len(bars), sum(done[ds, b] > 0 for b in bars), sum(done[ds, b] < 0 for b in bars))
    got = {(r.dataset_id, r.pattern): (r.depth, r.n, r.ups, r.downs) for r in t["found"].collect()}
    assert got == want and {v[0] for v in want.values()} == {1, 2, 3}


def test_near_duplicates_equal_brute_force(spark, searched):
    t, held, _ = searched
    rows = spark.sql(cj.filtered("{words}", "{ev}", "{found}"), **t).collect()
    # parts of a pattern are split where its conditions are joined
    bars = lambda ds, p: set.intersection(*[held[ds, c][1] for c in p.split(" + ")])
    families = {}
    for r in sorted(rows, key=lambda r: (r.depth, r.pattern)):
        if r.reason in ("kept", "5 near duplicate"):
            own, line = bars(r.dataset_id, r.pattern), families.setdefault((r.dataset_id, r.family), [])
            twin = any(abs(len(x) - len(own)) <= 0.1 * max(len(x), len(own)) and len(x & own) >= 0.95 * len(x | own) for x in line)
            assert (r.reason == "5 near duplicate") == twin, r.pattern
            if not twin:
                line.append(own)
    assert any(r.reason == "5 near duplicate" for r in rows) and any(r.reason == "kept" for r in rows)


@pytest.mark.parametrize("horizon", [1, 5, 12, 33])
def test_first_passage_equals_brute_force(spark, horizon):
    r, close, rows = random.Random(horizon), 100.0, []
    for _ in range(150):
        new = close * (1 + r.gauss(0, 0.03))
        rows.append((close, max(close, new) * 1.01, min(close, new) * 0.99, new))
        close = new
    bars, moves = make(spark, rows), (1.0, 4.0, 9.0)
    t = {"bars": bars, "entries": spark.sql(ps.entries("{bars} b", horizon), bars=bars), "reach": spark.sql(ps.reach("{bars} b", horizon), bars=bars)}
    got = {(x.bar_index, x.side, x.pct): x.bars for x in spark.sql(ps.touches("{entries}", "{reach}", horizon, moves), entries=t["entries"], reach=t["reach"]).collect()}
    want = {}
    for i in range(len(rows) - 1):
        entry = rows[i][3]
        for pct in moves:
            for side in (1, -1):
                reached = lambda j: (rows[j][1] - entry if side == 1 else entry - rows[j][2]) / entry * 100 >= pct  # noqa: B023, E731
                want[i, side, pct] = next((j - i for j in range(i + 1, min(i + horizon, len(rows) - 1) + 1) if reached(j)), None)
    assert got == want
