"""Plans made from the roles and labels of columns, on small hand-made tables."""

import pytest

from patternloom.operators import uploads as up
from patternloom.plans import blocks

ROLES = "dataset_id string, label string, pos long, role string, q20 double, q80 double"
BARS = "dataset_id string, bar_index long, close double, atr double, vals map<string,double>"


def planned(spark, operator, columns, bars=()):
    roles = spark.createDataFrame([(ds, label, k, role, lo, hi) for k, (ds, label, role, lo, hi) in enumerate(columns)], ROLES)
    if not bars:
        return spark.sql(operator("{roles}"), roles=roles)
    return spark.sql(operator("{uploads}", "{roles}"), uploads=spark.createDataFrame(list(bars), BARS), roles=roles)


def column(ds, label, role, lo=0.0, hi=0.0):
    return ds, label, role, lo, hi


def test_bands_pair_by_label_group_in_column_order(spark):
    columns = [column("d", "Keltner Upper", "upper-band"), column("d", "bb upper band", "upper-band"), column("d", "odd upper", "upper-band"), column("d", "BB Lower Band", "lower-band"), column("d", "keltner lower", "lower-band"), column("d", "keltner  lower band", "lower-band")]
    assert [tuple(r)[1:] for r in planned(spark, up.band_pairs, columns).orderBy("pair_no").collect()] == [("Keltner Upper", "keltner lower", 1), ("bb upper band", "BB Lower Band", 2)]


def test_only_upper_and_only_lower_pair_whatever_their_labels(spark):
    columns = [column("d", "a upper", "upper-band"), column("d", "b lower", "lower-band"), column("e", "a upper", "upper-band"), column("e", "b lower", "lower-band"), column("e", "c lower", "lower-band")]
    assert [tuple(r) for r in planned(spark, up.band_pairs, columns).collect()] == [("d", "a upper", "b lower", 1)]


def test_no_more_than_eight_bands_and_twelve_pairs(spark):
    bands = [column("d", f"g{k} {side}", f"{side}-band") for k in range(10) for side in ("upper", "lower")]
    assert sorted(r.upper for r in planned(spark, up.band_pairs, bands).collect()) == [f"g{k} upper" for k in range(8)]
    series = [column("d", f"s{k}", "oscillator") for k in range(7)] + [column("d", "level", "price-level"), column("d", "flag", "binary-event")]
    got = {(r.a, r.b) for r in planned(spark, up.series_pairs, series).collect()}
    assert got == {("s0", f"s{k}") for k in range(1, 7)} | {("s1", f"s{k}") for k in range(2, 7)} | {("s2", "s3")}


def test_widths_of_missing_and_vanishing_values(spark):
    columns = [column("d", "upper", "upper-band"), column("d", "lower", "lower-band")]
    bars = [("d", 0, 100.0, 0.0, {"upper": 104.0, "lower": 100.0}), ("d", 1, 0.0, 2.0, {"upper": 104.0, "lower": 100.0}), ("d", 2, 100.0, 2.0, {"upper": None, "lower": 100.0}), ("d", 3, 100.0, 2.0, {"upper": 110.0, "lower": 100.0}), ("d", 4, 100.0, 2.0, {"upper": 101.0, "lower": 100.0}), ("d", 6, -50.0, 2.0, {"upper": 105.0, "lower": 100.0})]
    got = {r.bar_index: (r.width_pct, r.width_atr, r.expansion) for r in planned(spark, up.band_widths, columns, bars).collect()}
    assert got == {0: (4.0, None, None), 1: (None, 2.0, None), 3: (10.0, 5.0, "Expanding"), 4: (1.0, 0.5, None), 6: (10.0, 2.5, None)}


def test_crosses_and_their_recency(spark):
    columns = [column("d", "a", "oscillator"), column("d", "b", "oscillator")]
    spreads = [-1.0, 0.0, 2.0, None, -1.0, -2.0, 3.0]
    bars = [("d", i, 1.0, 1.0, {"a": s, "b": 0.0}) for i, s in enumerate(spreads)]
    rows = planned(spark, up.pair_relations, columns, bars).orderBy("bar_index").collect()
    assert [r.cross_event for r in rows] == ["No cross", "No cross", "a crossed above b", "No cross", "No cross", "No cross", "a crossed above b"]
    assert [r.relation for r in rows] == ["a below b", "Equal", "a above b", None, "a below b", "a below b", "a above b"]
    assert [r.recency for r in rows] == ["Not recent", "Not recent", "Now", "Within 3 bars", "Within 3 bars", "Within 3 bars", "Now"]


def test_zones_by_stated_range_and_by_own_quantiles(spark):
    columns = [column("d", "k", "oscillator", 1.0, 2.0), column("d", "own", "oscillator", 1.0, 2.0), column("d", "other", "volatility")]
    bars = [("d", i, 1.0, 1.0, {"k": v, "own": w, "other": 1.0}) for i, (v, w) in enumerate([(20.0, 1.0), (50.0, 1.5), (80.0, 2.0), (None, None)])]
    got = sorted((r.label, r.bar_index, r.zone) for r in planned(spark, up.zones, columns, bars).collect())
    assert got == [(c, i, z) for c in ("k", "own") for i, z in enumerate(("Low", "Middle", "High"))]


@pytest.mark.parametrize("operator", [up.band_widths, up.pair_relations, up.levels_or_changes])
def test_blocks_make_no_difference(spark, monkeypatch, operator):
    columns = [column("d", "a", "oscillator"), column("d", "b", "cumulative"), column("d", "upper", "upper-band"), column("d", "lower", "lower-band")]
    bars = [("d", i, 10.0, 1.0, {"a": float(i * 7 % 11), "b": float(i * i % 13), "upper": float(i % 5 + 2), "lower": 1.0}) for i in range(150)]
    rounded = lambda rows: sorted(str(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)
    whole = rounded(planned(spark, operator, columns, bars).collect())
    monkeypatch.setattr(blocks, "BLOCK", 16)
    assert len(whole) == 150 * (2 if operator is up.levels_or_changes else 1) and rounded(planned(spark, operator, columns, bars).collect()) == whole


def test_empty_tables_give_no_rows(spark):
    bars = spark.createDataFrame([], BARS)
    roles = spark.createDataFrame([], ROLES)
    for operator in (up.band_widths, up.width_ratios, up.pair_relations, up.zones, up.levels_or_changes):
        assert spark.sql(operator("{uploads}", "{roles}"), uploads=bars, roles=roles).isEmpty()
