"""Golden values and properties of features on constructed bars."""

import pandas as pd
import pytest

from patternloom.operators import align, features, simulate
from patternloom.plans.dual import on
from patternloom.sources import bars as src


def make(spark, rows, dataset="d", step=60_000, start=1_767_605_400_000):
    frame = pd.DataFrame(rows, columns=["open", "high", "low", "close"]).astype(float)
    frame.insert(0, "dataset_id", dataset)
    frame.insert(1, "bar_index", range(len(frame)))
    frame.insert(2, "ts_ms", [start + k * step for k in range(len(frame))])
    frame["volume"] = 100.0
    return spark.createDataFrame(frame)


def linear(n):
    return [(100 + i, 102 + i, 99 + i, 101 + i) for i in range(n)]


def test_asof_uses_completed_bars_only(spark):
    low, high = make(spark, linear(10)), make(spark, linear(3), step=300_000)
    got = {r.bar_index: r.src_index for r in on(align.completed, low, high, target_ms=60_000, source_ms=300_000).collect()}
    assert got[0] is None and got[3] is None and got[4] == 0 and got[5] == 0 and got[9] == 1


def test_developing_progress(spark):
    low, high = make(spark, linear(10), start=1_767_600_000_000), make(spark, linear(3), step=300_000, start=1_767_600_000_000)
    got = {r.bar_index: r.progress for r in on(align.developing, low, high, target_ms=60_000, source_ms=300_000).collect()}
    assert got[5] == pytest.approx(20.0) and got[3] == pytest.approx(80.0) and 4 not in got  # complete at its end


def test_intrabar_path(spark):
    low, high = make(spark, linear(10), start=1_767_600_000_000), make(spark, linear(2), step=300_000, start=1_767_600_000_000)
    got = on(align.intrabar, high, low, target_ms=300_000, source_ms=60_000).orderBy("bar_index").collect()
    assert [r.intrabars for r in got] == [5, 5] and got[0].coverage == pytest.approx(100) and got[0].extreme_order == "Low before high"


@pytest.mark.parametrize("operator", [features.structure, features.box, features.atr, features.bollinger, features.trend, features.previous_hour])
def test_features_are_causal(spark, operator):
    rows = [(10 + (i * 7) % 13, 14 + (i * 7) % 13, 6 + (i * 5) % 11, 9 + (i * 3) % 12) for i in range(80)]
    whole, cut = on(operator, make(spark, rows)), on(operator, make(spark, rows[:60]))
    early = whole.where("bar_index < 60").toPandas().sort_values("bar_index").reset_index(drop=True)
    pd.testing.assert_frame_equal(early, cut.toPandas().sort_values("bar_index").reset_index(drop=True))


def test_layout_does_not_matter(spark):
    bars = make(spark, [(10 + (i * 7) % 13, 14 + (i * 7) % 13, 6 + (i * 5) % 11, 9 + (i * 3) % 12) for i in range(60)])
    same = lambda df: sorted(map(str, df.collect()))
    assert same(on(features.structure, bars)) == same(on(features.structure, bars.repartition(7, "close")))


def test_timeframe_labels(spark):
    for step, label in ((60_000, "1m"), (900_000, "15m"), (3_600_000, "1h"), (86_400_000, "1d")):
        assert on(src.timeframe, on(src.facts, make(spark, linear(10), step=step))).first().timeframe == label


def test_grid_has_all_parameter_sets(spark):
    assert on(lambda d, x: simulate.grid(d) + f" WHERE EXISTS (SELECT 1 FROM {x})", spark.range(1)).count() == 1680
