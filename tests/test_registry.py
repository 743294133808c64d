"""Registered queries against DuckDB on the smallest tables."""

import duckdb
import pytest

from patternloom import registry

SF = "/root/testdata/sf0.001"
SOME = [
    "s3_dataset_bars", "s8_resample", "s17_timeframe", "b1_candle", "b4_swing_sequence", "b8_structure_event_sequence", "b10_time_of_day", "b16_atr14", "b17_atr_percentile", "b21_adjusted_pds_box", "b26_opening_range",
    "b28_bandwidth_regime", "b31_consecutive_direction", "b33_break_retest", "c5_rolling_z", "c12_persistence", "c16_divergence", "j1_asof_completed", "j5_intrabar_path", "j6_coincidences", "p2_conjunctions", "p3_eligibility", "p5_conditions", "p8_levelwise", "p11_screened_features", "a11_outcome_profile", "a11_first_touches", "a16_signatures", "a18_levelwise_filters", "j4_developing_candle", "j12_lower_audit", "v9_survival_on_intervals",
    "a4_pattern_eval", "a8_non_overlapping", "a10_horizon_curve", "a13_bh_qvalue", "a18_filter_audit", "a21_rank", "v4_walk_forward", "v9_survival", "v10_held_up", "o5_balanced_selection", "x1_first_exit", "x1_simulate", "x8_objective", "x14_reversal_trades", "x17_viability", "x19_shortlist",
    "a22_periods", "a22_flags", "a23_per_symbol", "a23_pooled_coverage", "x13_session_atr", "x18_sources_by_instrument", "c18_all_bands", "c19_all_width_ratios", "c20_all_pairs", "c21_all_zones", "c22_levels_or_changes",
    "b36_catalogue", "c1_inferred_roles", "h1_category_gating", "p4_state_detection", "x4_exit_levels", "r4_correlation_strength", "a28_universe", "h3_duplicates", "d7_run_page",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in registry.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(str(tuple(float(r[k]) if isinstance(r[k], (int, float)) and not isinstance(r[k], bool) else r[k] for k in order)) for r in rows)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    cursor = duck.execute(registry.ORACLES[name])
    assert got == plain(cursor.fetchall(), [c[0] for c in cursor.description])


def test_every_query_plans_and_has_an_oracle(spark):
    for name, query in registry.QUERIES.items():
        if name != "x10_optimizer":
            assert query(spark, SF).columns and name in registry.ORACLES


def test_column_summary_counts_every_bar(spark):
    bars = {r.dataset_id: r.n for r in registry.QUERIES["r1_series_facts"](spark, SF).collect()}
    assert {r.dataset_id: r.n for r in registry.QUERIES["c24_column_summary"](spark, SF).collect()} == bars


def test_optimizer_recommends_only_eligible_systems(spark):
    rows = registry.QUERIES["x10_optimizer"](spark, SF).collect()
    best = [r for r in rows if r.recommended]
    assert all(r.eligible and r.sealed_r > 0 and r.stress_r > 0 for r in best) and len({(r.dataset_id, r.pattern_id) for r in best}) == len(best)
    for r in rows:
        assert r.place <= 12 and (not r.eligible or (r.good >= 3 and r.sealed_trades >= 10))
