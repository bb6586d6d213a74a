import pytest
from oracle import same

import __spark_entry__
from flightlake.plans import telemetry

#: Every query of the library, so that none is lost unnoticed.
NAMES = """
    approach_maneuvering approach_starts asof_grid_hold boundary_rows circuit_episodes circuit_events circuit_segments column_profile column_roles command_rate_mae
    control_range_audit cv_summary dedup_keep_first dialect_detect duplicate_catalogue duplicate_columns elevator_split envelope_abort episode_slice epochs_to_train
    feature_table file_hash_manifest final_approach first_crossing first_sustained_run_count first_sustained_run_time flight_manager_batch gate_counts grid_summary
    heading_error_wrap holdout_pick islands lag_duplicate_verify landing_bounces landing_checks landing_complete landing_phases landing_review_flags
    landing_touchdown_rollout landing_transitions latest_only longest_run loso_folds lower_bound_lookup lowpass_fir lowpass_heading metric_flatten metrics_by_group metrics_report
    mlp_forward model_fit most_frequent phase_painting phase_spans predicate_ffill rate_limiter regression_metrics report_join residual_histogram role_pruning
    rolling_std_stable runway_geometry saturation_counter scaler_apply scaler_fit scenario_of_name scenario_signals semi_anti_union set_operations signal_decimation
    telemetry_decode telemetry_error_counts telemetry_rejects timing_audit transient_diagnostics value_counts variant_masks
""".split()


def test_no_query_is_lost():
    assert sorted(telemetry.QUERIES) == sorted(NAMES) and set(NAMES) <= set(__spark_entry__.queries())
    assert set(NAMES) - set(telemetry.SQL) == {"flight_manager_batch", "model_fit"}


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(telemetry.SQL))
def test_query_equals_sql(spark, sf, name):
    same(telemetry.QUERIES[name](spark, sf), telemetry.SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(telemetry.QUERIES) - set(telemetry.SQL)))
def test_query_without_sql_runs(spark, sf, name):
    telemetry.QUERIES[name](spark, sf).collect()


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
