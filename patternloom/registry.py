"""Registered queries and their DuckDB statements.

``Query`` names an operator, its inputs and the columns it returns; the Spark plan and the
oracle text come from it.  Columns marked ``~`` are rounded to four digits by the same double
arithmetic on both sides (the engines' own ``round`` treat ties differently); ``~r:flag`` names a column
of the Spark plan that tells which NaN have no sign bit.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from patternloom import oracles
from patternloom.operators import align, hygiene, simulate
from patternloom.operators import catalogue as ct
from patternloom.operators import conjunctions as cj
from patternloom.operators import coverage as cov
from patternloom.operators import crossref as xr
from patternloom.operators import semantic as sem
from patternloom.operators import sessions as ses
from patternloom.operators import features as fx
from patternloom.operators import passage as ps
from patternloom.operators import patterns as pt
from patternloom.operators import trades as tr
from patternloom.operators import uploads as up
from patternloom.plans.dual import DUCKDB, SPARK, Dialect, Operator
from patternloom.sources import bars as src
from patternloom.sources.shared import emptied, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = ("events", "lineitem", "orders", "customer", "nation", "region", "part", "supplier")


def columns(d: Dialect, spec: str) -> str:
    return ", ".join(f"{_rounded(d, *c[1:].split(':'))} AS {c[1:].split(':')[0]}" if c[0] == "~" else c for c in spec.split())


def _rounded(d: Dialect, c: str, unsigned: str = "false") -> str:
    """Four digits.  Spark's floor is a long, so NaN, infinite and very large values (whole at this scale) go without it.

    NaN gets the sign bit that a processor gives 0 / 0, and so DuckDB's, unless ``unsigned`` holds; Spark's stored tables drop it.
    """
    up = f"{c} * 1e4 + 0.50001e0"
    nan = f"abs(cast({c} AS double))"
    nan = f"-{nan}" if unsigned == "false" else f"CASE WHEN {unsigned} THEN {nan} ELSE -{nan} END"
    return f"floor({up}) / 1e4" if d.duck else f"CASE WHEN abs({c}) < 1e14 THEN floor({up}) / 1e4 WHEN isnan({c}) THEN {nan} ELSE ({up}) / 1e4 END"


def hourly(d: Dialect, **t: str) -> str:
    return f"({src.tick_bars(d, t['events'])})"


def quarter(d: Dialect, **t: str) -> str:
    return f"({src.tick_bars(d, t['events'], 900_000)})"


def daily(d: Dialect, **t: str) -> str:
    return f"({src.daily_bars(d, t['lineitem'])})"


def spoken(build: Callable[..., str], d: Dialect, spec: str, **t: str) -> str:
    return f"SELECT {columns(d, spec)} FROM ({build(d, **t)}) q"


def _run(build: Callable[..., str], spec: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    body = spoken(build, SPARK, spec, **{t: "{" + t + "}" for t in TABLES})
    used = [t for t in TABLES if "{" + t + "}" in body]
    return spark.sql(body, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def add(name: str, spec: str, build: Callable[..., str]) -> None:
    """Register a query from a function of a dialect and the tables."""
    QUERIES[name] = partial(_run, build, spec)
    ORACLES[name] = spoken(build, DUCKDB, spec, **{t: t for t in TABLES})


_held: dict[str, DataFrame] = {}
_held_of: list = []


def _state(events: DataFrame) -> tuple:
    """Which files a table has now: their number, sizes and times."""
    files = events.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return tuple(files.selectExpr("count(*)", "sum(file_size)", "max(file_modification_time)").first())


def kept_tables(spark: SparkSession, sf_dir: str, body: str) -> dict[str, DataFrame]:
    """The tables that a text names: bars, evaluated bars and the stored tables of patterns of a folder.

    Each is computed once and written to the shared folder for the queries of the folder, so no
    query carries another's plan and a lost executor loses none of them.  Only the tables of the last
    folder are kept, as long as its files stay as they are; others are emptied.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    now = [spark.sparkContext.applicationId, sf_dir, _state(events)]
    if _held_of != now:
        if _held_of[:1] == now[:1]:
            for df in _held.values():
                emptied(df)
        _held.clear()
        _held_of[:] = now

    def tables(text: str) -> dict[str, DataFrame]:
        got = {"events": events} if "{events}" in text else {}
        for name in pt.STORED:
            if "{" + name + "}" in text:
                if name not in _held:
                    own = pt.STORED[name](SPARK, "{ev}")
                    _held[name] = written(spark.sql(own, **tables(own)))
                got[name] = _held[name]
        return got

    return tables(body)


pt.STORED["bars"] = lambda d, ev: src.tick_bars(d, "{events}")
_BARS = "{bars} b"
pt.STORED["ev"] = lambda d, ev: pt.evaluated(d, _BARS)
pt.STORED["grid"] = lambda d, ev: pt.on_intervals(f"({pt.interval_bars(d, '{events}')}) b")
pt.STORED["reach"] = lambda d, ev: ps.reach(_BARS)
pt.STORED["entries"] = lambda d, ev: ps.entries(_BARS)
pt.STORED["touches"] = lambda d, ev: ps.touches("{entries}", "{reach}")
pt.STORED["long"] = lambda d, ev: cj.long_features(d, _BARS)
pt.STORED["met"] = lambda d, ev: cj.met("{long}", "{ev}")
pt.STORED["frequent"] = lambda d, ev: cj.frequent("{met}")
pt.STORED["words"] = lambda d, ev: cj.words("{met}", "{frequent}")
pt.STORED["pairs"] = lambda d, ev: cj.pairs("{words}")
pt.STORED["found"] = lambda d, ev: cj.levels("{words}", "{pairs}", "{frequent}")
pt.STORED["spans"] = lambda d, ev: cov.spans(ev)
pt.STORED["uploads"] = lambda d, ev: up.uploads(d, _BARS)
pt.STORED["roles"] = lambda d, ev: up.roles(d, "{uploads}")
pt.STORED["paths"] = lambda d, ev: tr.paths(d, _BARS, ev)


def pattern_query(name: str, spec: str, operator: Operator, oracle: str | None = None, **options) -> None:
    """A query over the evaluated bars; ``oracle`` is a statement written apart from the operator."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        body = f"SELECT {columns(SPARK, spec)} FROM ({operator(SPARK, '{ev}', **options)}) q"
        return spark.sql(body, **kept_tables(spark, sf_dir, body))

    QUERIES[name] = run
    ORACLES[name] = f"WITH ev AS MATERIALIZED ({EVALUATED}) SELECT {columns(DUCKDB, spec)} FROM ({oracle or operator(DUCKDB, 'ev', **options)}) q"


EVALUATED = pt.evaluated(DUCKDB, f"({src.tick_bars(DUCKDB, 'events')})")


def level_query(name: str, spec: str, text: str, oracle: str) -> None:
    """A query over the stored tables of the level-wise search; the oracle reads ``long``, ``made`` and ``ev``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        body = f"SELECT {columns(SPARK, spec)} FROM ({text}) q"
        return spark.sql(body, **kept_tables(spark, sf_dir, body))

    QUERIES[name] = run
    features = cj.long_features(DUCKDB, f"({src.tick_bars(DUCKDB, 'events')})")
    ORACLES[name] = f"WITH RECURSIVE ev AS MATERIALIZED ({EVALUATED}), long AS MATERIALIZED ({features}), made AS MATERIALIZED ({cj.made(DUCKDB, 'long')}), {oracles.LEVELS} SELECT {columns(DUCKDB, spec)} FROM ({oracle}) q"


def bar_query(name: str, spec: str, operator: Operator, source=hourly, **options) -> None:
    add(name, spec, lambda d, **t: operator(d, source(d, **t) + " bb", **options))


bar_query("s3_dataset_bars", "dataset_id bar_index ts_ms open high low close volume ~avg_value users", lambda d, b: f"SELECT * FROM {b}")
bar_query("s3_daily_bars", "dataset_id bar_index ts_ms ~open ~high ~low ~close volume", lambda d, b: f"SELECT * FROM {b}", daily)
bar_query("s8_resample", "dataset_id bar_index ts_ms open high low close volume", src.resample)
bar_query("s11_rescale", "dataset_id bar_index ts_ms ~open ~high ~low ~close volume", src.rescale)
bar_query("s11_calibration", "dataset_id ~return_sd ~mean_tr_pct ~median_tr_pct ~gap_sd", src.calibration)
bar_query("s16_preview", "dataset_id bar_index ts_ms open high low close volume", src.preview)
bar_query("s17_facts", "dataset_id row_count first_ms last_ms interval_ms", src.facts)
bar_query("s17_timeframe", "dataset_id interval_ms timeframe", lambda d, b: src.timeframe(d, f"({src.facts(d, b)})"))
bar_query("b1_candle", "dataset_id bar_index ~candle_upper_wick_pct ~candle_lower_wick_pct ~candle_body_pct ~candle_body_size ~candle_range", fx.candle)
bar_query("b2_candle_direction", "dataset_id bar_index candle_direction", fx.candle)
for _name, _spec in {"b3_pivot_event": "pivot_event", "b4_swing_sequence": "swing_sequence", "b5_structure_state": "structure_state", "b6_break_of_structure": "break_of_structure", "b7_liquidity_sweep": "liquidity_sweep", "b8_structure_event_sequence": "structure_event_sequence"}.items():
    bar_query(_name, f"dataset_id bar_index {_spec}", fx.structure)
bar_query("b9_vwap", "dataset_id bar_index ~vwap_distance_pct vwap_side", fx.vwap)
bar_query("b10_time_of_day", "dataset_id bar_index time_of_day", fx.calendar, quarter)
bar_query("b11_session_phase", "dataset_id bar_index session_phase", fx.calendar, quarter)
bar_query("b12_weekday_month", "dataset_id bar_index weekday month", fx.calendar, daily)
bar_query("b13_trading_day", "dataset_id bar_index day minute_of_day", fx.clocked)
bar_query("b14_day_index", "dataset_id day_no first_bar last_bar day_open day_high day_low day_close", fx.days)
bar_query("b15_relative_volume", "dataset_id bar_index rvol_bucket volume_spike", fx.volume)
bar_query("b16_atr14", "dataset_id bar_index ~true_range ~atr_14 ~current_atr", fx.atr)
bar_query("b17_atr_percentile", "dataset_id bar_index ~atr_percentile", fx.atr_percentile)
bar_query("b18_range_percentile", "dataset_id bar_index ~range_percentile", fx.range_percentile)
bar_query("b19_prev_day_location", "dataset_id bar_index ~prev_day_location prev_day_level_state", fx.previous_day)
bar_query("b20_prev_day_distance_atr", "dataset_id bar_index ~distance_to_pdh_atr ~distance_to_pdl_atr ~distance_to_pds_mid_atr", fx.previous_day)
bar_query("b21_adjusted_pds_box", "dataset_id bar_index adjusted_pds_box_state ~adjusted_pds_box_position ~distance_to_adjusted_pds_mid_atr adjusted_pds_level_event", fx.adjusted_box)
bar_query("b22_prev_day_level_event", "dataset_id bar_index prev_day_level_event", fx.previous_day)
bar_query("b23_prev_hour_location", "dataset_id bar_index ~prev_hour_location", fx.previous_hour, quarter)
bar_query("b24_box", "dataset_id bar_index ~box_position box_event", fx.box)
bar_query("b25_gap", "dataset_id bar_index ~gap_size_pct gap_direction", fx.gap)
bar_query("b26_opening_range", "dataset_id bar_index ~or_size_pct or_breakout", fx.opening_range)
bar_query("b27_bollinger", "dataset_id bar_index bb_location ~bb_bandwidth ~bb_percent_b", fx.bollinger)
bar_query("b28_bandwidth_regime", "dataset_id bar_index ~bb_bandwidth_percentile bb_regime", fx.bollinger)
bar_query("b29_trend_slope", "dataset_id bar_index ~trend_slope", fx.trend)
bar_query("b30_trend_strength", "dataset_id bar_index trend_strength", fx.trend)
bar_query("b31_consecutive_direction", "dataset_id bar_index consecutive_direction", fx.streak)
bar_query("b32_sweep_reclaim", "dataset_id bar_index sweep_reclaim_sequence", fx.sequences)
bar_query("b33_break_retest", "dataset_id bar_index break_retest_sequence", fx.sequences)
bar_query("b34_custom_columns", "dataset_id bar_index ~avg_value users ~k", lambda d, b: f"SELECT dataset_id, bar_index, CASE WHEN NOT isnan(avg_value) THEN avg_value END AS avg_value, users, k FROM {b}")
bar_query("b35_exit_levels_day", "dataset_id bar_index ~exit_pdh ~exit_pdl ~exit_pd_mid", fx.previous_day)
bar_query("b35_exit_levels_bands", "dataset_id bar_index ~exit_bb_mid ~exit_bb_upper ~exit_bb_lower", fx.bollinger)
bar_query("b35_exit_levels_box", "dataset_id bar_index ~exit_box_high ~exit_box_low ~exit_box_mid", fx.box)
bar_query("b35_exit_levels_opening", "dataset_id bar_index ~exit_or_high ~exit_or_low ~exit_or_mid", fx.opening_range)
bar_query("b35_exit_levels_vwap", "dataset_id bar_index ~exit_vwap", fx.vwap)
bar_query("b35_exit_levels_swings", "dataset_id bar_index swing_high swing_low", fx.pivots)

# ------------------------------------------------------------------ uploaded columns

bar_query("c4_rolling_percentile", "dataset_id bar_index ~percentile", sem.rolling_percentile, x="avg_value")
bar_query("c5_rolling_z", "dataset_id bar_index ~z", sem.rolling_z, x="avg_value")
bar_query("c6_early_atr", "dataset_id bar_index ~tr ~atr", sem.early_atr)
bar_query("c7_quantiles", "dataset_id ~q20 ~q50 ~q80", sem.quantiles, x="users")
bar_query("c8_event_state", "dataset_id bar_index state", sem.event_state, x="(users - 3)")
bar_query("c9_direction", "dataset_id bar_index direction", sem.direction, x="users")
bar_query("c10_slope", "dataset_id bar_index ~slope", sem.slope, x="users")
bar_query("c11_acceleration", "dataset_id bar_index ~acceleration", sem.slope, x="users")
bar_query("c12_persistence", "dataset_id bar_index persistence", sem.persistence, x="users")
bar_query("c13_regime_transition", "dataset_id bar_index regime transition", sem.regime, x="users")
bar_query("c14_price_level", "dataset_id bar_index ~distance_pct ~distance_atr relation cross_event touch rejection breakout", sem.price_level, x="avg_value")
bar_query("c15_confirmed_pivots", "dataset_id bar_index pivot_index ~value kind", sem.confirmed_pivots, x="users")
bar_query("c16_divergence", "dataset_id bar_index divergence", sem.divergence, x="users")
bar_query("c17_recency", "dataset_id bar_index recency", lambda d, b: sem.recency(d, sem.regime(d, b, "users"), "transition"))
bar_query("c18_band_width", "dataset_id bar_index ~width_pct ~width_atr expansion", sem.bands, upper="high", lower="low")
bar_query("c19_width_ratio", "dataset_id bar_index ~width_ratio", sem.width_ratio, a="high - low", b="close - open")
bar_query("c20_pair", "dataset_id bar_index relation cross_event ~spread_z", sem.pair, a="users", b="volume")
bar_query("c21_zone", "dataset_id bar_index zone", sem.zone, x="users")
bar_query("c22_change_score", "dataset_id bar_index ~z", sem.change_score, x="users")
bar_query("c23_band_acceleration", "dataset_id bar_index ~acceleration", sem.bands, upper="(high + 1)", lower="low")
bar_query("c24_column_summary", "dataset_id n lo hi ~mean ~sd kinds", sem.summary, x="users")



def upload_query(name: str, spec: str, operator: Callable[..., str], oracle: str) -> None:
    """A query over all uploaded columns; the columns' roles and labels plan it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        body = f"SELECT {columns(SPARK, spec)} FROM ({operator('{uploads}', '{roles}')}) q"
        return spark.sql(body, **kept_tables(spark, sf_dir, body))

    QUERIES[name] = run
    ORACLES[name] = f"SELECT {columns(DUCKDB, spec)} FROM ({oracle}) q"


upload_query("c18_all_bands", "dataset_id bar_index upper lower ~width_pct ~width_atr expansion", up.band_widths, oracles.BAND_WIDTHS)
upload_query("c19_all_width_ratios", "dataset_id bar_index a b ~width_ratio", up.width_ratios, oracles.WIDTH_RATIOS)
upload_query("c20_all_pairs", "dataset_id bar_index a b relation cross_event recency ~spread_z", up.pair_relations, oracles.PAIR_RELATIONS)
upload_query("c21_all_zones", "dataset_id bar_index label zone", up.zones, oracles.ZONES)
upload_query("c22_levels_or_changes", "dataset_id bar_index label kind ~reading", up.levels_or_changes, oracles.LEVELS_OR_CHANGES)

# ------------------------------------------------------------------ alignment

H, Q = src.HOUR, 900_000


def two(name: str, spec: str, operator: Operator, **options) -> None:
    """A query over quarter-hour (lower) and hourly (higher) bars."""
    add(name, spec, lambda d, **t: operator(d, quarter(d, **t) + " ql", hourly(d, **t) + " hb", **options))


two("j1_asof_completed", "dataset_id bar_index ts_ms src_index", lambda d, lo, hi: align.completed(d, lo, hi, Q, H))
two("j2_asof_context", "dataset_id bar_index src_index mtf_close mtf_volume", lambda d, lo, hi: align.context(d, lo, hi, Q, H, "close volume"))
two("j3_exit_levels", "dataset_id bar_index ~mtf_exit_box_high ~mtf_exit_box_low", lambda d, lo, hi: align.context(d, lo, f"(SELECT h.*, x.exit_box_high, x.exit_box_low FROM {hi.removesuffix(' hb')} h LEFT JOIN ({fx.box(d, hi)}) x ON h.dataset_id = x.dataset_id AND h.bar_index = x.bar_index) hx", Q, H, "exit_box_high exit_box_low"))
two("j4_developing_candle", "dataset_id bar_index ~progress ~body_pct ~range_pct ~location sweep_order", lambda d, lo, hi: align.developing(d, lo, hi, Q, H))
two("j5_intrabar_path", "dataset_id bar_index intrabars ~coverage extreme_order sweep_order ~efficiency turns ~up_excursion ~down_excursion", lambda d, lo, hi: align.intrabar(d, hi, lo, H, Q))
two("j7_contained_bars", "dataset_id src_index n", lambda d, lo, hi: f"SELECT dataset_id, src_index, count(*) AS n FROM ({align.covering(d, lo, hi, H)}) c GROUP BY dataset_id, src_index")
two("j8_covering_bar", "dataset_id bar_index src_index", lambda d, lo, hi: align.covering(d, lo, hi, H))
two("j9_prior_bar", "dataset_id bar_index src_index", align.prior_daily)
_AUDIT = "dataset_id relationship bars aligned leaks irregular ~coverage age_ms ~progress contained status"
two("j12_alignment_audit", _AUDIT, lambda d, lo, hi: align.audit(d, lo, hi, Q, H))
two("j12_lower_audit", _AUDIT, lambda d, lo, hi: align.audit(d, hi, lo, H, Q))
ORACLES["j4_developing_candle"] = f"SELECT dataset_id, bar_index, {columns(DUCKDB, '~progress ~body_pct ~range_pct ~location')}, sweep_order FROM ({oracles.DEVELOPING}) q"
ORACLES["j5_intrabar_path"] = f"SELECT dataset_id, bar_index, intrabars, {columns(DUCKDB, '~coverage ~efficiency ~up_excursion ~down_excursion')}, extreme_order, sweep_order, turns FROM ({oracles.INTRABAR}) q"


bar_query("j6_coincidences", "event_id dataset_id other_id distance", xr.coincidences)
bar_query("j11_dataset_selection", "dataset_id bar_index close", lambda d, b: f"SELECT * FROM (SELECT * FROM {b}) s WHERE dataset_id IN (SELECT k FROM {d.values([('click',), ('view',)], 'k')} w)")
bar_query("j13_prev_day_join", "dataset_id day_no pdh pdl pdc", fx.days)
bar_query("r1_series_facts", "dataset_id n ~mean ~sd usable", lambda d, b: f"SELECT dataset_id, count(*) AS n, avg(close) AS mean, CASE WHEN stddev_pop(close) = 0 THEN 1e0 ELSE stddev_pop(close) END AS sd, count(close) = count(*) AS usable FROM {b} GROUP BY dataset_id")
bar_query("r2_cross_events", "dataset_id event_id moment kind", xr.events)
bar_query("r3_event_counts", "dataset_id n driver", xr.counts)
bar_query("r4_correlation_strength", "event_id moment contributors ~strength band", xr.strengths)
bar_query("r5_event_order", "event_id dataset_id happened place", xr.order_of_events)
bar_query("r6_first_contribution", "event_id dataset_id other_id place", xr.contributions)
bar_query("r7_column_union", "label datasets", ct.selected_labels)

# ------------------------------------------------------------------ patterns

pattern_query("p1_condition_matches", "dataset_id bar_index cond", pt.matches)
pattern_query("p2_conjunctions", "dataset_id pattern_id depth n", lambda d, ev: f"SELECT dataset_id, pattern_id, cast({pt.depth('pattern_id')} AS bigint) AS depth, count(*) AS n FROM ({pt.matched(d, ev)}) m WHERE pattern_id > 0 GROUP BY dataset_id, pattern_id")
bar_query("p5_quantile_thresholds", "dataset_id q20 q40 q60 q80", pt.thresholds, x="users")
bar_query("p11_screening", "dataset_id ~close_strength ~volume_strength ~avg_value_strength ~users_strength", pt.screening)
pattern_query("p11_group_spread", "cond ~spread", pt.group_spread)
pattern_query("a1_forward_return", "dataset_id bar_index ~r12", lambda d, ev: f"SELECT * FROM {ev} WHERE r12 IS NOT NULL")
pattern_query("a2_excursions", "dataset_id bar_index ~u12 ~w12", lambda d, ev: f"SELECT * FROM {ev} WHERE r12 IS NOT NULL")
pattern_query("a3_outcomes_by_horizon", "dataset_id bar_index ~r1 ~u1 ~w1 ~r5 ~u5 ~w5 ~r34 ~u34 ~w34", lambda d, ev: f"SELECT * FROM {ev}")
pattern_query("a3_outcomes_h5", "dataset_id bar_index ~r5 ~u5 ~w5", lambda d, ev: f"SELECT * FROM {ev} WHERE r5 IS NOT NULL")
pattern_query("a4_pattern_eval", "dataset_id pattern_id n direction ~win_rate ~baseline ~lift ~avg_move ~mfe ~mae", pt.evaluate)
pattern_query("a5_baseline", "dataset_id n ~bullish ~bearish", pt.baseline)
pattern_query("a6_excursion_ratio", "dataset_id pattern_id ~excursion_ratio", pt.evaluate)
pattern_query("a7_trade_summary", "dataset_id pattern_id n ~win_pct ~mean_move ~median_move", pt.trades)
pattern_query("a8_non_overlapping", "dataset_id pattern_id n first_at last_at", pt.spaced)
pattern_query("a9_drawdown", "dataset_id pattern_id ~sd ~max_drawdown", pt.drawdown)
pattern_query("a10_horizon_curve", "dataset_id pattern_id h n ~win_rate ~mean_move trades ~trade_win ~avg_net ~max_drawdown ~delta ~base ~rec eligible", pt.horizons, oracles.HORIZONS)
pattern_query("a10_recommended_hold", "dataset_id pattern_id h", lambda d, ev: f"SELECT dataset_id, pattern_id, h FROM ({pt.horizons(d, ev)}) x WHERE choice = 1")
pattern_query("a11_outcome_profile", "dataset_id pattern_id n ~median_move ~median_mfe ~median_mae ~failure_rate", pt.profile, oracles.PROFILE)
pattern_query("a11_first_touches", "dataset_id pattern_id target stop n ~target_rate ~median_bars ~stop_rate ~target_first", pt.first_touches, oracles.FIRST_TOUCHES)
pattern_query("a12_p_value", "dataset_id pattern_id n ~z ~p", pt.p_values, oracles.P_VALUES)
pattern_query("a13_bh_qvalue", "dataset_id pattern_id ~p ~q", pt.q_values, oracles.Q_VALUES)
pattern_query("a14_frozen_direction", "dataset_id pattern_id ~win_rate", pt.frozen)
pattern_query("a15_adds_value", "dataset_id pattern_id ~win_rate ~best_part adds_value", pt.adds_value, oracles.ADDS_VALUE)
pattern_query("a16_similarity", "dataset_id a b ~jaccard", pt.similarity)
pattern_query("a16_signatures", "dataset_id pattern_id n first_pattern", pt.signatures)
pattern_query("a17_score_confidence", "dataset_id pattern_id n ~score confidence", pt.scores, oracles.SCORES)
pattern_query("a18_filter_audit", "dataset_id reason patterns", pt.filtered, oracles.FILTERED)
pattern_query("a20_ratio_search", "dataset_id ~threshold patterns ~set_score best", pt.ratio_search, oracles.RATIO_SEARCH)
pattern_query("a21_rank", "dataset_id pattern_id h n ~win_rate ~lift ~score rk ~q", pt.ranked, oracles.RANKED)
pattern_query("a22_coverage", "dataset_id pattern_id n first_ms last_ms ~share ~early_win ~late_win", pt.coverage)
pattern_query("a23_cross_symbol", "pattern_id symbols ~pooled ~equal ~pooled_move ~equal_move broad", pt.by_symbol)
pattern_query("a22_periods", "dataset_id pattern_id y n first_ms last_ms ~share", lambda d, ev: cov.periods(ev, "{spans}"), oracles.PERIODS)
pattern_query("a22_flags", "dataset_id pattern_id n ~early_win ~late_win steady flags", lambda d, ev: cov.flagged(ev, "{spans}"), oracles.COVERAGE_FLAGS)
pattern_query("a23_per_symbol", "dataset_id pattern_id n ~win_rate ~avg_move", lambda d, ev: cov.per_symbol(ev), oracles.PER_SYMBOL)
pattern_query("a23_pooled_coverage", "pattern_id symbols n ~win_rate ~equal_rate ~avg_move ~equal_move broad steady_up steady_down flags", lambda d, ev: cov.pooled(ev, "{spans}"), oracles.POOLED)
pattern_query("a24_histogram", "dataset_id pattern_id bin n", pt.histogram)
pattern_query("a25_wilson", "dataset_id pattern_id n ~lo ~hi", pt.wilson)
pattern_query("a26_costs", "dataset_id pattern_id ~net_move ~cost_multiple cushion economic", pt.costs)
pattern_query("a27_attribution", "dataset_id n ~share ~win ~move passed degraded", pt.attribution)
bar_query("v1_split", "dataset_id bar_index side", pt.split)
pattern_query("v3_out_of_sample", "dataset_id pattern_id n_in n_out ~win_in ~win_out ~move_in ~move_out", pt.out_of_sample)
pattern_query("v4_walk_forward", "dataset_id pattern_id fold n ~win_rate ~move passed", pt.walk_forward, oracles.WALK_FORWARD)
pattern_query("v5_market_side", "dataset_id pattern_id market n ~win_rate", pt.market_side)
pattern_query("v6_by_year", "dataset_id pattern_id y n ~win_rate", pt.by_year)
pattern_query("v7_per_condition", "dataset_id pattern_id cond side n ~win_rate ~move", pt.per_condition, oracles.PER_CONDITION)
pattern_query("v8_degradation", "dataset_id pattern_id degraded", pt.out_of_sample)
pattern_query("v9_survival", "dataset_id pattern_id evaluated ~survival", pt.survival, oracles.SURVIVAL)
pattern_query("v9_survival_on_intervals", "dataset_id pattern_id evaluated ~survival elsewhere ~interval_survival", pt.survival_on_intervals, oracles.SURVIVAL_ON_INTERVALS)
pattern_query("v10_held_up", "dataset_id pattern_id passed ~mean_win ~worst_win failure status", pt.held_up, oracles.HELD_UP)
pattern_query("v11_final_status", "dataset_id pattern_id final confidence", pt.finalised)
pattern_query("v12_summary", "patterns ~pass_rate ~mean_survival ~mean_ratio", pt.validation_summary)
pattern_query("o3_ranked", "dataset_id pattern_id rk", pt.ranked)
pattern_query("o4_top_ten", "dataset_id pattern_id list place", lambda d, ev: f"SELECT * FROM (SELECT dataset_id, pattern_id, 'rank' AS list, rk AS place FROM ({pt.ranked(d, ev)}) r UNION ALL SELECT dataset_id, pattern_id, 'ratio', row_number() OVER (PARTITION BY dataset_id ORDER BY floor(coalesce(excursion_ratio, 1e9) * 1e6) DESC, n DESC, pattern_id) FROM ({pt.kept(d, ev)}) k) x WHERE place <= 10")
pattern_query("o5_balanced_selection", "dataset_id pattern_id tier turn pos", pt.balanced)
pattern_query("o6_priority", "dataset_id pattern_id ~priority", pt.priority, oracles.PRIORITY)
pattern_query("x19_shortlist", "dataset_id pattern_id ~priority pos", pt.shortlist, oracles.SHORTLIST)


bar_query("v2_discovery_prefix", "dataset_id n", lambda d, b: f"SELECT dataset_id, count(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY dataset_id) AS c FROM {b}) x WHERE bar_index < greatest({pt.HORIZON + 2}, floor(c * 0.7e0)) GROUP BY dataset_id")
pattern_query("j10_lookup", "dataset_id pattern_id n status failure", lambda d, ev: f"SELECT e.dataset_id, e.pattern_id, e.n, h.status, h.failure FROM ({pt.evaluate(d, ev)}) e LEFT JOIN ({pt.held_up(d, ev)}) h ON e.dataset_id = h.dataset_id AND e.pattern_id = h.pattern_id")
_KEYS = {"win_rate": "win_rate", "samples": "n", "move": "avg_move", "net_move": "net_move", "cost_multiple": "cost_multiple", "confidence": "CASE confidence WHEN 'very high' THEN 3 WHEN 'high' THEN 2 WHEN 'moderate' THEN 1 ELSE 0 END"}
pattern_query("o1_result_order", "dataset_id pattern_id sort_key pos", lambda d, ev: " UNION ALL ".join(f"SELECT dataset_id, pattern_id, '{k}' AS sort_key, row_number() OVER (PARTITION BY dataset_id ORDER BY floor({x} * 1e6) DESC NULLS LAST, pattern_id) AS pos FROM (SELECT s.*, c.net_move, c.cost_multiple FROM ({pt.scores(d, ev)}) s JOIN ({pt.costs(d, ev)}) c ON s.dataset_id = c.dataset_id AND s.pattern_id = c.pattern_id) a" for k, x in _KEYS.items()))
_ORDERS = {"passed": "passed DESC", "mean_win": "floor(mean_win * 1e6) DESC", "status": "status DESC"}
pattern_query("o2_validation_order", "dataset_id pattern_id sort_key pos", lambda d, ev: " UNION ALL ".join(f"SELECT dataset_id, pattern_id, '{k}' AS sort_key, row_number() OVER (PARTITION BY dataset_id ORDER BY {x}, pattern_id) AS pos FROM ({pt.held_up(d, ev)}) h" for k, x in _ORDERS.items()))
pattern_query("o7_union", "dataset_id pattern_id source", lambda d, ev: f"SELECT dataset_id, pattern_id, 'bullish' AS source FROM ({pt.evaluate(d, ev)}) e WHERE direction = 'bullish' UNION ALL SELECT dataset_id, pattern_id, 'bearish' FROM ({pt.evaluate(d, ev)}) f WHERE direction = 'bearish'")
bar_query("o8_distinct", "candle_direction box_event", lambda d, b: f"SELECT DISTINCT candle_direction, box_event FROM ({pt.feature_row(d, b)}) f")
pattern_query("o9_exclusion", "dataset_id pattern_id", lambda d, ev: f"SELECT dataset_id, pattern_id FROM ({pt.evaluate(d, ev)}) e EXCEPT SELECT dataset_id, pattern_id FROM ({pt.ranked(d, ev)}) r WHERE rk <= 10")
pattern_query("o10_intersection", "a b dataset_id bar_index", lambda d, ev: f"SELECT x.cond AS a, y.cond AS b, x.dataset_id, x.bar_index FROM ({pt.matches(d, ev)}) x JOIN ({pt.matches(d, ev)}) y ON x.dataset_id = y.dataset_id AND x.bar_index = y.bar_index AND x.cond < y.cond")
pattern_query("o11_top_rejections", "dataset_id reason patterns", lambda d, ev: f"SELECT dataset_id, reason, patterns FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY patterns DESC, reason) AS rk FROM ({pt.filtered(d, ev)}) f WHERE reason <> 'kept') g WHERE rk <= 3")
pattern_query("p12_confluence", "dataset_id pattern_id families accepted", lambda d, ev: f"SELECT dataset_id, pattern_id, families, families >= 2 AS accepted FROM (SELECT dataset_id, pattern_id, " + " + ".join(f"max(CASE WHEN k IN ({ks}) THEN 1 ELSE 0 END)" for ks in ("1, 2, 12", "3, 4, 5, 10, 11", "6, 7", "8, 9")) + " AS families FROM (" + " UNION ALL ".join(f"SELECT dataset_id, pattern_id, {x} AS k FROM ({pt.evaluate(d, ev)}) e{n}" for n, x in enumerate(pt.digits(d, "pattern_id"))) + ") a GROUP BY dataset_id, pattern_id) b")

# ------------------------------------------------------------------ level-wise search over all feature columns

bar_query("p3_eligibility", "label eligible", lambda d, b: f"SELECT label, NOT {cj.drifting(d, 'label', 'true')} AS eligible FROM ({ct.catalogue(d, b)}) c")
level_query("p5_conditions", "dataset_id cond op ~v t", cj.made(SPARK, "{long}"), "SELECT * FROM made")
level_query("p11_screened_features", "dataset_id feature ~score place", cj.screened("{long}", "{ev}"), oracles.SCREENED)
level_query("p8_levelwise", "dataset_id pattern family depth n ups downs", "SELECT * FROM {found}", "SELECT * FROM sets")
level_query("a16_near_twins", "dataset_id early late ~jaccard", cj.similar("{words}", cj.judged("{ev}", "{found}")), "SELECT ds AS dataset_id, early, late, jaccard FROM twins")
level_query("a18_levelwise_filters", "dataset_id reason depth patterns", f"SELECT dataset_id, reason, depth, count(*) AS patterns FROM ({cj.filtered('{words}', '{ev}', '{found}')}) f GROUP BY dataset_id, reason, depth", "SELECT ds AS dataset_id, reason, depth, count(*) AS patterns FROM decided GROUP BY ALL")
level_query("a18_levelwise_kept", "dataset_id pattern depth n ~win_rate ~lift", f"SELECT * FROM ({cj.filtered('{words}', '{ev}', '{found}')}) f WHERE reason = 'kept'", "SELECT ds AS dataset_id, pattern, depth, n, win_rate, lift FROM decided WHERE reason = 'kept'")

# ------------------------------------------------------------------ simulation

bar_query("x3_exit_triggers", "dataset_id bar_index cross_above cross_below newly_equal", simulate.exit_triggers)
bar_query("x13_sessions", "dataset_id bar_index bar_no oh ol known_high known_low", simulate.sessions, quarter)
bar_query("x14_reversal_signals", "dataset_id bar_index side ~entry ~stop ~target", simulate.reversal_signals, quarter)
bar_query("x14_reversal_trades", "dataset_id signal_index side result ~gross_r", simulate.reversal_trades, quarter)
bar_query("x16_parameter_grid", "manipulation wick body location inside entry", lambda d, b: f"SELECT g.* FROM ({simulate.grid(d)}) g JOIN (SELECT count(*) AS c FROM {b}) x ON x.c >= 0")
bar_query("x18_source_choice", "dataset_id interval_ms", lambda d, b: f"SELECT dataset_id, interval_ms FROM (SELECT *, row_number() OVER (ORDER BY interval_ms, dataset_id) AS rn FROM ({src.facts(d, b)}) f) g WHERE rn = 1")


_FACTS = "dataset_id pattern_id cfg signals unfilled overlapping trades wins ambiguous ~win_rate ~expectancy_r ~profit_factor ~max_drawdown_pct ~daily_log ~capital_log"
_LOGS = f"SELECT *, {pt.log10('(1 + max_daily_drawdown)')} AS daily_log, {pt.log10('(%s + net_profit)' % tr.CAPITAL)} AS capital_log FROM ({{}}) r"
pattern_query("x1_simulate", _FACTS, lambda d, ev: _LOGS.format(tr.results(d, "SELECT * FROM {simulated}")), _LOGS.format(oracles.SIMULATED))
pattern_query("x1_trades", "dataset_id pattern_id cfg i exit_index state result ~r:unsigned", lambda d, ev: "SELECT * FROM {simulated} WHERE state = 'trade'", oracles.TRADES)
pattern_query("x1_first_exit", "dataset_id pattern_id cfg i filled exit_index result ~r:unsigned", lambda d, ev: f"SELECT dataset_id, pattern_id, cfg, i, filled, CASE WHEN filled THEN exit_index END AS exit_index, CASE WHEN filled THEN result END AS result, r, unsigned FROM ({tr.exits(d, ev)}) x", oracles.FIRST_EXIT)
pattern_query("x5_exit_states", "dataset_id cond n", tr.exit_states)
pattern_query("x9_system_folds", "dataset_id pattern_id cfg fold n ~mean_r", lambda d, ev: f"SELECT t.dataset_id, t.pattern_id, t.cfg, cast(least(floor(t.i * 4e0 / e.c), 3) AS bigint) AS fold, count(*) AS n, avg(t.r) AS mean_r FROM {{simulated}} t JOIN (SELECT DISTINCT dataset_id, c FROM {ev}) e ON t.dataset_id = e.dataset_id WHERE t.state = 'trade' GROUP BY t.dataset_id, t.pattern_id, t.cfg, cast(least(floor(t.i * 4e0 / e.c), 3) AS bigint)", oracles.FOLDS)
_METRICS = "dataset_id pattern_id cfg n ~win_rate ~expectancy ~profit_factor ~net_r ~max_drawdown ~stressed"
pattern_query("x15_r_metrics", _METRICS, lambda d, ev: tr.r_metrics(d), oracles.R_METRICS)
_BEST = lambda d, table: " UNION ALL ".join(f"SELECT dataset_id, pattern_id, '{label}' AS label, cfg FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, pattern_id ORDER BY {tr.floored(d, order)}, cfg) AS rk FROM ({table}) o WHERE score IS NOT NULL) w WHERE rk = 1" for label, order in tr.LABELS.items())
pattern_query("x11_candidate_labels", "dataset_id pattern_id label cfg", lambda d, ev: _BEST(d, tr.objective(d, tr.results(d, "SELECT * FROM {simulated}"), tr.SETTINGS)), f"WITH judged AS MATERIALIZED ({oracles.OBJECTIVE}) {_BEST(DUCKDB, 'SELECT * FROM judged')}")
bar_query("x2_wilder_atr", "dataset_id bar_index ~atr", tr.wilder)
pattern_query("x8_objective", "dataset_id pattern_id cfg trades ~complexity ~score", lambda d, ev: tr.objective(d, tr.results(d, "SELECT * FROM {simulated}"), tr.SETTINGS), oracles.OBJECTIVE)


bar_query("x17_viability", "dataset_id manipulation wick body location inside entry n ~expectancy good_folds neighbours place viable recommended", simulate.reversal_viability, quarter)


def x10_optimizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The optimizer on each target's first shortlisted pattern (staged; rows only)."""

    def run(text: str, **tables: DataFrame) -> DataFrame:
        return written(spark.sql(text, **kept_tables(spark, sf_dir, text), **tables))

    return tr.optimised(run, f"SELECT dataset_id, pattern_id, direction FROM ({tr.systems(SPARK, '{ev}')}) s WHERE pos = 1")


QUERIES["x10_optimizer"] = x10_optimizer

# ------------------------------------------------------------------ hygiene and catalogue

bar_query("h2_presence", "dataset_id feature present kept", hygiene.presence)
bar_query("h3_duplicates", "dataset_id a b", lambda d, b: hygiene.duplicates(d, f"(SELECT *, open AS again FROM {b}) w"))
bar_query("h6_statistics", "dataset_id lo hi ~mean p25 p50 p75", hygiene.statistics, x="users")
bar_query("h7_distribution", "bucket n ~pct", lambda d, b: hygiene.distribution(d, fx.volume(d, b), "rvol_bucket", ("Low", "Normal", "High", "Extreme")))
bar_query("h9_observed", "feature lo hi", lambda d, b: hygiene.observed(d, f"(SELECT open, close, volume, floor(avg_value * 100) / 100e0 AS avg_value, users, floor(k * 100) / 100e0 AS k FROM {b}) w"))

# ------------------------------------------------------------------ saved runs (orders stand for runs: the customer is the owner)

_RUNS = lambda d, t: f"(SELECT o_orderkey AS id, o_custkey AS owner, {d.epoch_ms('o_orderdate')} AS saved_ms, o_orderpriority AS config, o_totalprice AS size FROM {t['orders']})"
add("d2_list_runs", "id owner saved_ms", lambda d, **t: f"SELECT * FROM {_RUNS(d, t)} r WHERE owner = 42 ORDER BY saved_ms DESC")
add("d3_run_summaries", "id summary", lambda d, **t: f"SELECT id, config || ' / ' || cast(saved_ms AS {d.text_type}) AS summary FROM {_RUNS(d, t)} r WHERE owner = 42")
add("d4_get_runs", "pos id config", lambda d, **t: f"SELECT w.pos, r.id, r.config FROM {d.values([(k, i) for k, i in enumerate((7, 99999999, 3, 11, 5))], 'pos, id')} w JOIN {_RUNS(d, t)} r ON w.id = r.id")
add("d7_run_page", "id saved_ms more", lambda d, **t: f"SELECT id, saved_ms, c > 5 AS more FROM (SELECT *, count(*) OVER () AS c, row_number() OVER (ORDER BY saved_ms DESC, id) AS rn FROM {_RUNS(d, t)} r WHERE owner = 42) x WHERE rn <= 5")


# ------------------------------------------------------------------ parsing and typing (texts made from the tables)


def _digits(d: Dialect, x: str) -> str:
    return f"regexp_matches({x}, '^[0-9]+$')" if d.duck else f"{x} RLIKE '^[0-9]+$'"


def _iso(d: Dialect, x: str) -> str:
    return f"epoch_ms(try_cast({x} AS timestamp))" if d.duck else f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', try_cast({x} AS timestamp_ntz))"


def _number(d: Dialect, x: str) -> str:
    return f"try_cast(nullif(regexp_replace(trim({x}), ',', ''{', ' + chr(39) + 'g' + chr(39) if d.duck else ''}), '') AS double)"


def _texts(d: Dialect, **t: str) -> str:
    ms = d.epoch_ms("ts")
    v = f"cast(event_id AS {d.text_type})"
    return f"""(SELECT event_id, CASE event_id % 4 WHEN 0 THEN cast({d.div(ms, '1000')} AS {d.text_type}) WHEN 1 THEN cast({ms} AS {d.text_type}) WHEN 2 THEN '2024-01-02 03:04:05' ELSE 'no time' END AS t,
      CASE event_id % 4 WHEN 0 THEN concat(' ', {v}, ',000.5 ') WHEN 1 THEN {v} WHEN 2 THEN '' ELSE concat('x', {v}) END AS n FROM {t['events']})"""


add("s4_timestamp_parse", "event_id ms", lambda d, **t: f"SELECT event_id, CASE WHEN {_digits(d, 't')} THEN CASE WHEN try_cast(t AS bigint) < 100000000000 THEN try_cast(t AS bigint) * 1000 ELSE try_cast(t AS bigint) END ELSE {_iso(d, 't')} END AS ms FROM {_texts(d, **t)} x")
add("s5_number_parse", "event_id v", lambda d, **t: f"SELECT event_id, {_number(d, 'n')} AS v FROM {_texts(d, **t)} x")
add("s6_column_typing", "t_numeric n_numeric", lambda d, **t: f"SELECT max(CASE WHEN {_number(d, 't')} IS NOT NULL THEN 1 ELSE 0 END) = 1 AS t_numeric, max(CASE WHEN {_number(d, 'n')} IS NOT NULL THEN 1 ELSE 0 END) = 1 AS n_numeric FROM (SELECT * FROM {_texts(d, **t)} y WHERE event_id < 200) x")

# ------------------------------------------------------------------ more of search, validation and selection

add("d1_next_run_id", "next_id", lambda d, **t: f"SELECT max(id) + 1 AS next_id FROM {_RUNS(d, t)} r")
add("d5_delete_run", "id owner", lambda d, **t: f"SELECT id, owner FROM {_RUNS(d, t)} r WHERE owner = 42 AND NOT (id = (SELECT min(id) FROM {_RUNS(d, t)} q WHERE owner = 42))")

# ------------------------------------------------------------------ catalogue

bar_query("b36_catalogue", "label category n ~lo ~hi overridden", ct.catalogue)
bar_query("c1_inferred_roles", "dataset_id label role", ct.inferred)
bar_query("c2_resolve_definition", "dataset_id label definition", ct.resolved)
bar_query("c3_merge_definitions", "name origin ~confidence", ct.merged_definitions)
bar_query("h1_category_gating", "dataset_id label category allowed", ct.gated)
bar_query("h5_categories", "category n", ct.categories)
bar_query("h8_catalogue_search", "category n", ct.searched)
bar_query("h10_toggles", "label category enabled", ct.toggled)
bar_query("p1b_condition_readings", "dataset_id label op reading n", ct.matchers)
bar_query("p4_state_detection", "dataset_id label op ~value", ct.state_candidates)
bar_query("p6_manual_thresholds", "label op ~lo ~hi", ct.manual)
bar_query("p7_distinct_conditions", "label op ~v made", ct.distinct_conditions)
bar_query("x4_exit_levels", "dataset_id label n", ct.exit_levels)
add("a28_universe", "instrument rows_total intervals hierarchy_links", lambda d, **t: ct.universe(d, quarter(d, **t) + " u1", hourly(d, **t) + " u2", f"({src.resample(d, hourly(d, **t) + ' u3')}) u4"))

def _intervals(d: Dialect, **t: str) -> str:
    return ses.measured(d, **{n: f"({src.tick_bars(d, t['events'], ms)}) {n}" for n, ms in (("quarter", Q), ("hour", H), ("four_hours", 4 * H), ("day", src.DAY))})


def _days(d: Dialect, **t: str) -> str:
    return f"({src.tick_bars(d, t['events'], src.DAY)}) dd"


add("x13_session_atr", "dataset_id open_ms bars ~prior_atr ~completed_atr", lambda d, **t: ses.usable_sessions(d, quarter(d, **t) + " qs", _days(d, **t)))
ORACLES["x13_session_atr"] = f"SELECT {columns(DUCKDB, 'dataset_id open_ms bars ~prior_atr ~completed_atr')} FROM ({oracles.USABLE_SESSIONS}) q"
add("j9_prior_daily_atr", "dataset_id open_ms ~prior_atr", lambda d, **t: ses.prior_atr(d, quarter(d, **t) + " qs", _days(d, **t)))
add("x18_sources_by_instrument", "dataset_id interval_ms daily_source inner_source", lambda d, **t: ses.source_choice(d, _intervals(d, **t)))
add("a28_universe_totals", "instruments datasets rows_total links input_columns", lambda d, **t: ses.universe_totals(d, _intervals(d, **t), hourly(d, **t) + " hb"))
two("p12_confluence_of_intervals", "dataset_id a b origins accepted n", lambda d, lo, hi: ses.confluence(d, lo, hi, Q, H))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Win rate, baseline and lift of every single and paired condition over hourly bars."""
    return QUERIES["a4_pattern_eval"](spark, sf_dir)
