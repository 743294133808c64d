"""Windows over blocks, rank counting and greedy choice: equal to the plain rules at any block size."""

import bisect
import random

import numpy as np
import pytest

from patternloom.operators import features as fx
from patternloom.operators import patterns as pt
from patternloom.operators import semantic as sem
from patternloom.plans import blocks
from patternloom.plans.dual import SPARK, on
from patternloom.sources import bars as src
from tests.test_features import make


def walk(n, seed=3):
    r = random.Random(seed)
    rows, close = [], 100
    for _ in range(n):
        new = close + r.choice([-2, -1, 0, 1, 2])
        rows.append((close, max(close, new) + r.choice([0, 1]), min(close, new) - r.choice([0, 1]), new))
        close = new
    return rows


def recent(d, b):
    return sem.recency(d, sem.regime(d, b, "close"), "transition")


OPERATORS = {
    "structure": fx.structure, "vwap": fx.vwap, "clocked": fx.clocked, "days": fx.days, "streak": fx.streak, "sequences": fx.sequences, "bollinger": fx.bollinger, "trend": fx.trend, "atr_percentile": fx.atr_percentile, "previous_hour": fx.previous_hour,
    "adjusted_box": fx.adjusted_box, "recency": recent, "persistence": lambda d, b: sem.persistence(d, b, "close"), "divergence": lambda d, b: sem.divergence(d, b, "high"), "pair": lambda d, b: sem.pair(d, b, "high", "close"), "evaluated": pt.evaluated,
}


@pytest.fixture(scope="module")
def bars(spark):
    return make(spark, walk(230), step=900_000).union(make(spark, walk(90, 8), dataset="e", step=900_000)).cache()


@pytest.mark.parametrize("name", OPERATORS)
def test_block_size_does_not_matter(spark, bars, monkeypatch, name):
    def rows(size):
        monkeypatch.setattr(blocks, "BLOCK", size)
        monkeypatch.setattr(fx, "TILE_BITS", 3 if size < 100 else 8)
        return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in on(OPERATORS[name], bars).collect())

    whole = rows(100_000)
    assert whole and rows(16) == whole


def tasks(df):
    """Rows of each partition that the windows of a plan run in, none left out."""
    return [n for n in df.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect() if n]


@pytest.mark.parametrize("name", ["structure", "vwap", "clocked", "streak", "recency"])
def test_one_dataset_is_several_tasks(spark, monkeypatch, name):
    monkeypatch.setattr(blocks, "BLOCK", 16)
    one = make(spark, walk(230), step=900_000).repartition(1)
    for k, v in {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}.items():
        spark.conf.set(k, v)
    try:
        assert len(tasks(on(OPERATORS[name], one))) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bars_are_numbered_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 4)
    events = spark.sql("SELECT id AS event_id, CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS event_type, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id * id % 5000 AS int)) AS ts, cast(id AS double) AS value, 1 AS user_id, '{}' AS props FROM range(300)")
    got = {}
    for r in on(src.tick_bars, events).collect():
        got.setdefault(r.dataset_id, []).append((r.ts_ms, r.bar_index))
    assert set(got) == {"a", "b"} and all([i for _, i in sorted(x)] == list(range(len(x))) for x in got.values())


def test_rank_counting_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fx, "TILE_BITS", 3)
    monkeypatch.setattr(fx, "NODE_BITS", 5)
    r = np.random.default_rng(1)
    columns = {"a": np.round(r.normal(size=700), 1).tolist(), "b": r.integers(0, 5, 90).astype(float).tolist(), "c": [1.0], "d": [2.0] * 33}
    want = {}
    for k, x in columns.items():
        seen = []
        for i, v in enumerate(x):
            want[k, i] = bisect.bisect_left(seen, v)
            bisect.insort(seen, v)
    rows = spark.createDataFrame([(k, i, i, v) for k, x in columns.items() for i, v in enumerate(x)], "dataset_id string, bar_index long, place long, x double")
    assert {(q.dataset_id, q.place): q.smaller for q in spark.sql(fx.earlier_smaller("SELECT * FROM {x}"), x=rows).collect()} == want


def test_rank_counting_of_a_million_bars_of_one_dataset(spark):
    n = 1_000_000
    rows = spark.range(n).selectExpr("'d' AS dataset_id", "id AS bar_index", "id AS place", f"cast((id * 7919) % {n} AS double) AS x")
    got = spark.sql("SELECT sum(smaller) AS total, sum(smaller * (place % 1000)) AS mixed FROM (" + fx.earlier_smaller("SELECT * FROM {x}") + ") q", x=rows).first()
    x, tree, want = [(i * 7919) % n for i in range(n)], [0] * (n + 1), []
    for v in x:
        k, below = v, 0
        while k:
            below += tree[k]
            k &= k - 1
        want.append(below)
        k = v + 1
        while k <= n:
            tree[k] += 1
            k += k & -k
    assert got.total == sum(want) and got.mixed == sum(w * (i % 1000) for i, w in enumerate(want))


def greedy(bars, h):
    chosen, free = set(), 0
    for b in sorted(bars):
        if b >= free:
            chosen.add(b)
            free = b + h
    return chosen


@pytest.mark.parametrize(("block", "stretch"), [(16, 4), (64, 3), (1024, 1024)])
def test_greedy_choice_is_carried_over_blocks(spark, monkeypatch, block, stretch):
    monkeypatch.setattr(pt, "PICK_BLOCK", block)
    monkeypatch.setattr(pt, "PICK_STRETCH", stretch)
    r, rows, want = random.Random(5), [], {}
    for p in range(5):
        for h in (1, 2, 5, 12):
            bars = r.sample(range(4000), r.choice([1, 50, 900, 2500]))
            if p == 4:  # a wide gap between two dense parts
                bars = [b for b in range(4000) if b < 120 or b > 3300]
            rows += [("x", p, h, b, float(b)) for b in bars]
            want["x", p, h] = greedy(bars, h)
    df = spark.createDataFrame(rows, "dataset_id string, pattern_id long, h long, bar_index long, move double")
    got, n = {}, 0
    for q in spark.sql(pt.picked(SPARK, "SELECT * FROM {x}"), x=df).collect():
        n += 1
        assert q.move == q.bar_index
        if q.picked:
            got.setdefault((q.dataset_id, q.pattern_id, q.h), set()).add(q.bar_index)
    assert got == want and n == len(rows)


def test_a_chain_of_many_rows(spark):
    rows = spark.range(200_000).selectExpr("'d' AS dataset_id", "1L AS pattern_id", "12L AS h", "id AS bar_index", "0d AS move")
    got = spark.sql("SELECT count(*) AS n, sum(CASE WHEN picked THEN 1 ELSE 0 END) AS chosen, max(CASE WHEN picked AND bar_index % 12 <> 0 THEN 1 ELSE 0 END) AS odd FROM (" + pt.picked(SPARK, "SELECT * FROM {x}") + ") q", x=rows).first()
    assert (got.n, got.chosen, got.odd) == (200_000, 16_667, 0)
