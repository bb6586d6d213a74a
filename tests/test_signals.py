import math
import random

import pytest
from pyspark.sql import functions as F

from flightlake import schema
from flightlake.functions import geometry as G
from flightlake.functions import guards, protocol, text
from flightlake.operators import checks, features, ordered, profile, resample, runs, splits


def series(spark, n=300, gap=True, seed=1):
    rng, t, rows = random.Random(seed), 0.0, []
    for i in range(n):
        t += 1 / 60 * (1 + 0.01 * rng.random()) + (0.5 if gap and i == n // 2 else 0)
        rows.append(("a", t, rng.gauss(5, 2), float(i)))
    return spark.createDataFrame(rows, "ep string, t double, x double, z double"), rows


def recursion(values, b, a):
    out, x1, x2, y1, y2 = [], 0.0, 0.0, 0.0, 0.0
    for x in values:
        y = b[0] * x + b[1] * x1 + b[2] * x2 - a[0] * y1 - a[1] * y2
        x1, x2, y1, y2 = x, x1, y, y1
        out.append(y)
    return out


def test_filter_constants():
    b, a = resample.butterworth2(4.0, 60.0)
    assert [round(v, 8) for v in (*b, *a)] == [0.03357181, 0.06714362, 0.03357181, -1.41898265, 0.55326989]
    assert abs(resample.group_delay_ms(4.0, 60.00000000000) - 57.9496) < 0.01


def test_window_filter_equals_recursion(spark):
    df, rows = series(spark)
    fs = 1 / sorted(b[1] - a[1] for a, b in zip(rows, rows[1:]))[len(rows) // 2 - 1 : len(rows) // 2 + 1][0]
    want = recursion([r[2] for r in rows], *resample.butterworth2(4.0, 60.0))
    got = [r.x for r in resample.lowpass(df, ["ep"], ["t"], ["x"], 4.0, fs=60.0).orderBy("t").collect()]
    assert max(abs(p - q) for p, q in zip(got, want)) < 1e-9 and fs > 0
    many = [r.x for r in resample.lowpass_many(df, ["ep"], ["t"], ["x"], 4.0).orderBy("t").collect()]
    own = [r.x for r in resample.lowpass(df, ["ep"], ["t"], ["x"], 4.0).orderBy("t").collect()]
    assert max(abs(p - q) for p, q in zip(many, own)) < 1e-6


def test_steady_start_has_no_ramp(spark):
    df = spark.createDataFrame([("a", i / 60, 64.0) for i in range(40)], "ep string, t double, x double")
    assert abs(resample.lowpass(df, ["ep"], ["t"], ["x"], 4.0, init="steady").agg(F.min("x")).first()[0] - 64) < 1e-9
    assert resample.lowpass(df, ["ep"], ["t"], ["x"], 4.0).agg(F.min("x")).first()[0] < 3


def test_grid_hold_equals_search(spark):
    df, rows = series(spark, 200)
    got = resample.hold_on_grid(df, ["ep"], ["t"], 0.1).orderBy("grid_idx").collect()
    t0, t1 = rows[0][1], rows[-1][1]
    n = math.floor((t1 - t0) / 0.1) + 1
    assert [r.grid_idx for r in got] == list(range(n))
    for r in got:
        assert r.z == max(x[3] for x in rows if x[1] <= t0 + r.grid_idx * 0.1)
    assert not checks.not_uniform(spark.createDataFrame([("a", r.t_grid) for r in got], "ep string, t double"), ["ep"], "t", 0.1).count()


def test_rows_of_equal_time_keep_their_order(spark):
    """Whatever order the rows come in, the position decides among equal times."""
    rows = [("a", i // 2 / 10, i, float(i * i % 7)) for i in range(30)]
    order, got = ["t", "p"], []
    for data in (rows, rows[::-1], rows[1::2] + rows[::2]):
        df = spark.createDataFrame(data, "ep string, t double, p int, x double")
        held = [(r.grid_idx, r.p, r.x) for r in resample.hold_on_grid(df, ["ep"], order, 0.1).orderBy("grid_idx").collect()]
        smooth = [[round(r.x, 12) for r in f(df, ["ep"], order, ["x"], 1.0).orderBy("p").collect()] for f in (resample.lowpass, resample.lowpass_many)]
        got.append((held, *smooth))
    assert got[0] == got[1] == got[2] and [p for _, p, _ in got[0][0]] == [2 * k + 1 for k in range(len(got[0][0]))]


def test_state_is_carried_over_batches(spark):
    """Slices of seven rows, two episodes in one partition, a null key: as the recursion row by row."""
    rng = random.Random(2)
    rows = [(k, i / 60, rng.gauss(0, 1), rng.gauss(0, 1)) for k in ("a", "b", None) for i in range(150)]
    df = spark.createDataFrame(rows, "ep string, t double, x double, y double").repartition(1)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = resample.lowpass_many(df.where("ep IS NOT NULL"), ["ep"], ["t"], ["x", "y"], 4.0).collect()
        limited = ordered.rate_limited(df, ["ep"], ["t"], {"x": (0.3, 0.0)}).collect()
        steady = resample.lowpass_many(df.where("ep = 'a'").withColumn("x", F.lit(5.0)), ["ep"], ["t"], ["x"], 4.0, "steady").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    for k in ("a", "b"):
        for j, c in enumerate(("x", "y")):
            want = recursion([r[2 + j] for r in rows if r[0] == k], *resample.butterworth2(4.0, 60.0))
            assert max(abs(r[c] - v) for r, v in zip(sorted((r for r in got if r.ep == k), key=lambda r: r.t), want)) < 1e-9
    for k in ("a", "b", None):
        y, want = 0.0, []
        for x in (r[2] for r in rows if r[0] == k):
            y += max(-0.3, min(0.3, x - y))
            want.append(y)
        assert [r.x_out for r in sorted((r for r in limited if r.ep == k), key=lambda r: r.t)] == want
    assert all(abs(r.x - 5) < 1e-9 for r in steady)


@pytest.mark.parametrize("most", [3, 10_000])
def test_percentiles_are_exact(spark, most, monkeypatch):
    """Groups of every size against numpy, narrowed down to three values or sorted at once; ties, equal values, missing ones, a null group."""
    import numpy as np

    from flightlake.operators import metrics

    monkeypatch.setattr(metrics, "MOST_SORTED", most)
    monkeypatch.setattr(metrics, "BINS", 4)
    rng = random.Random(4)
    groups = {"one": [5.0], "two": [1.0, 2.0], "same": [3.0] * 50, "ties": [rng.choice([1.0, 2.0, 9.0]) for _ in range(80)], "halves": [1.0] * 10 + [9.0] * 10, None: [rng.gauss(0, 1) for _ in range(120)], "odd": [None, float("nan"), -1.0, 7.0], "none": [None]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    for p in (0.0, 0.5, 0.95, 1.0):
        got = {r.k: r.q for r in metrics.exact_percentile(df, ["k"], "v", p, "q").collect()}
        for k, vs in groups.items():
            vs = [v for v in vs if v is not None and v == v]
            assert (got[k] is None) if not vs else abs(got[k] - np.quantile(vs, p)) < 1e-9, (k, p)
    assert abs(metrics.exact_percentile(df, [], "v", 0.5, "q").first().q - np.quantile([v for vs in groups.values() for v in vs if v is not None and v == v], 0.5)) < 1e-9


def test_percentiles_with_infinities_and_outliers(spark, monkeypatch):
    """More values than one task sorts, spread over all magnitudes, with infinite ones: against numpy, in at most seven rounds."""
    import numpy as np

    from flightlake.operators import metrics

    rounds = []
    monkeypatch.setattr(metrics, "MOST_SORTED", 20)
    monkeypatch.setattr(metrics, "settled", lambda df, settle=metrics.settled: rounds.append(0) or settle(df))
    rng, inf = random.Random(8), float("inf")
    close = [1.0 + rng.random() * 2e-16 * k for k in range(3000)]  # doubles next to one another
    wide = [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(5000)] + [5e-324, -5e-324, 0.0, -0.0, 1.7e308]
    groups = {"inf": close + [inf] * 40 + [1e300], "both": wide + [inf] * 9 + [-inf] * 700, "wide": wide, "all": [inf] * 60, "some": [inf, 1.0], "edge": [1.0] * 19 + [inf]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double").repartition(4)
    for p in (0.05, 0.5, 0.95, 0.99):
        rounds.clear()
        got = {r.k: r.q for r in metrics.exact_percentile(df, ["k"], "v", p, "q").collect()}
        assert len(rounds) <= 8
        for k, vs in groups.items():
            vs = sorted(vs)
            at, share = int((len(vs) - 1) * p), (len(vs) - 1) * p % 1
            low, high = vs[at], vs[min(at + 1, len(vs) - 1)]
            if low == high or not share:
                assert got[k] == low, (k, p)
            elif inf in (abs(low), abs(high)):
                assert got[k] == (low if abs(low) == inf else high), (k, p)
            else:
                assert got[k] == pytest.approx(float(np.quantile(vs, p)), rel=1e-12), (k, p)


def test_clip_keeps_missing_values(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (9.0,), (-9.0,)], "x double")
    got = [r[0] for r in df.select(guards.clip(F.col("x"), -5, 5)).collect()]
    assert got[0] is None and math.isnan(got[1]) and got[2:] == [5.0, -5.0]


@pytest.mark.parametrize("d,n", [(0.3, 3), (0.8, 8), (0.25, 3), (0.0, 1)])
def test_steps_round_up(spark, d, n):
    assert spark.range(1).select(guards.steps(d, F.lit(0.1))).first()[0] == n


def test_geometry(spark):
    lat, lon = G.point_at(-3000, 0, G.RUNWAYS["02"])
    assert abs(lat - 63.937566339319524) < 1e-9 and abs(lon + 22.605474154108432) < 1e-9
    back = spark.createDataFrame([(lat, lon)], "a double, b double").select(*G.along_cross(F.col("a"), F.col("b"), G.RUNWAYS["02"])).first()
    assert abs(back[0] + 3000) < 1e-6 and abs(back[1]) < 1e-6
    h = spark.createDataFrame([(10.0,), (269.965,), (89.0,)], "h double").select(G.heading_error(F.col("h"), 269.965)).collect()
    assert [round(r[0], 3) for r in h] == [100.035, 0.0, 179.035]


def test_two_conventions_for_runs(spark):
    df = spark.createDataFrame([("a", i, i / 10, i in (3, 4, 5)) for i in range(10)], "k string, idx int, t double, f boolean")
    r = runs.islands(df, ["k"], "t", F.col("f"))
    assert runs.first_run_by_count(r, ["k"], 3).count() == 1 and runs.first_run_by_time(r, ["k"], 0.3).count() == 0
    assert runs.first_run_by_time(r, ["k"], 0.15).first().start_idx == 3


def test_rate_limits(spark):
    df = spark.createDataFrame([("a", i, x, x) for i, x in enumerate([0.5, 0.5, -1.0])], "k string, i int, rudder double, throttle double")
    got = ordered.rate_limited(df, ["k"], ["i"], {"rudder": (0.2, 0.0), "throttle": (0.1, None)}).orderBy("i").collect()
    assert [round(r.rudder_out, 6) for r in got] == [0.2, 0.4, 0.2] and [round(r.throttle_out, 6) for r in got] == [0.5, 0.5, 0.4]


def test_roles_and_units(spark):
    names = [*schema.PROPERTY_PATHS.values(), "/engines[0]/rpm[0]", "/constant[0]", "/x/other-ft[0]"]
    got = {r.column_name: r for r in profile.assign_roles(spark.createDataFrame([(n, n == "/constant[0]") for n in names], "column_name string, is_constant boolean")).collect()}
    assert got["frame"].role == "metadata" and got["frame"].unit == "count"
    assert got["/position[0]/altitude-agl-ft[0]"].role == "neural_input" and got["/position[0]/altitude-agl-ft[0]"].unit == "ft"
    assert got["/engines[0]/rpm[0]"].exclusion_reason == "forbidden_input_family_section10"
    assert got["/constant[0]"].exclusion_reason == "constant_or_not_applicable_to_c172p"
    assert got["/gear[0]/gear[1]/rollspeed-ms[0]"].unit == "m/s" and got["/controls[0]/flight[0]/elevator-trim[0]"].role == "derived_feature_source"
    dup = spark.createDataFrame([("/x/other-ft[0]", "frame", "f1", 1), ("/x/other-ft[0]", "sim_time", "f2", 2)], "drop_column string, keep_column string, formula string, seq int")
    cat = profile.assign_roles(spark.createDataFrame([(n, False) for n in names], "column_name string, is_constant boolean"))
    assert {r.column_name: r.duplicate_of for r in profile.apply_duplicates(cat, dup).collect()}["/x/other-ft[0]"] == "sim_time"


def test_profile_of_odd_values(spark):
    df = spark.createDataFrame([(float("nan"), 1.0), (float("inf"), 1.0), (None, 1.0), (2.0, 1.0)], "a double, b double")
    got = {r.column_name: r for r in profile.column_profile(df, ["a", "b"]).collect()}
    assert (got["a"].missing_count, got["a"].inf_count, got["a"].min, got["a"].n_unique) == (2, 1, 2.0, 2) and got["b"].is_constant


def test_protocol(spark):
    good = ",".join("1" for _ in protocol.TELEMETRY)
    df = spark.createDataFrame([(good,), (good + ",1",), (good.replace("1", "x", 1),), ("",)], "value string")
    rows = protocol.decode(df).collect()
    assert len(rows) == 1 and rows[0].frozen == 1 and len(rows[0]) == 33
    line = spark.range(1).select(protocol.encode({"aileron": F.lit(0.5)})).first()[0]
    assert line == "0.500000,0.000000,0.000000,0.000000,0.000000,0.000000,0.000000"
    assert protocol.description_xml("output", protocol.TELEMETRY, protocol.WHOLE, protocol.TELEMETRY_NODES).count("<chunk>") == 33


def test_names_and_scenarios(spark):
    df = spark.createDataFrame([("/d/voo_Inicio-TESTE.csv",), ("voo-2-com-16-nos.csv",), ("other.csv",)], "p string")
    got = df.select(text.is_familiarisation(F.col("p")), text.scenario_of(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(True, "unknown"), (False, "wind_16kt"), (False, "unknown")]


def test_published_holdout_and_folds(spark):
    s = spark.createDataFrame([(x, "wind_16kt") for x in ("voo-2-com-16-nos", "voo-3-com-16-nos", "voo-com-16-nos")], "session_id string, scenario_id string")
    assert splits.holdout(s, "wind_16kt").first()[0] == "voo-2-com-16-nos"
    folds = splits.loso_folds(s)
    assert folds.count() == 9 and not checks.leaking_folds(folds).count()


def test_scalers_do_not_divide_by_nothing(spark):
    df = spark.createDataFrame([(0, 1.0, 5.0), (0, 3.0, 5.0)], "fold_id int, a double, b double")
    sc = splits.fit_scalers(df, ["fold_id"], ["a", "b"])
    got = {r.variable: (r.mean, r.std, r.degenerate) for r in sc.collect()}
    assert got == {"a": (2.0, 1.0, False), "b": (5.0, 1.0, True)}
    assert sorted(r.a for r in splits.apply_scalers(df, sc, ["fold_id"], ["a", "b"]).collect()) == [-1.0, 1.0]


def test_failed_check_raises(spark):
    with pytest.raises(checks.CheckFailed, match="order"):
        checks.enforce(order=checks.not_rising(spark.createDataFrame([("a", 0, 1.0), ("a", 1, 1.0)], "k string, p int, t double"), ["k"], ["p"], "t"))


def test_wheels_and_startup_sample(spark):
    checks.gear_mapping(0, [1, 2])
    for nose, mains in ((1, [1, 2]), (0, [1, 1]), (0, [1, 2, 3])):
        with pytest.raises(checks.CheckFailed):
            checks.gear_mapping(nose, mains)
    got = checks.startup_sample(spark, G.RUNWAYS["29"], {f: (0.0, 1000.0) for f in schema.SCALED})
    assert len(got) == 20 and -4 < got["along_track_m"] < 4 and got["heading_error_cos"] == 1.0
    with pytest.raises(checks.CheckFailed, match="agl_ft"):
        checks.startup_sample(spark, G.RUNWAYS["29"], {"agl_ft": (0.0, float("nan"))})


def test_rules_find_what_breaks_them(spark):
    bounds = spark.createDataFrame([("a", 1.0, 2.0, 3.0), ("b", 2.0, 1.0, 3.0), ("c", 1.0, 2.0, 1.5), ("d", None, None, None)], "ep string, touchdown_confirmed_s double, rollout_s double, complete_s double")
    assert {r.ep for r in checks.out_of_order(bounds, ["ep"]).collect()} == {"b", "c"}
    rows = spark.createDataFrame([("a", 0, "BOUNCE", None), ("b", 0, "BOUNCE", 3), ("c", 0, "BOUNCE", None)], "ep string, idx int, phase string, rollout_idx int")
    flags = spark.createDataFrame([("c", "window_ended")], "ep string, flag string")
    assert [r.ep for r in checks.bounce_without_rollout(rows, ["ep"], flags).collect()] == ["a"]
    times = spark.createDataFrame([("a", i, t) for i, t in enumerate((1.0, 2.0, 2.0))] + [("b", i, float(i)) for i in range(3)], "k string, p int, t double")
    for strictly, want in ((True, {"a": False, "b": True}), (False, {"a": True, "b": True})):
        assert {r.k: r.increasing for r in ordered.is_increasing(times, ["k"], ["p"], "t", strictly).collect()} == want
    with pytest.raises(ValueError, match="missing columns: c"):
        profile.required_columns(times.withColumnRenamed("t", "d"), ["k", "c"])


def test_other_runways_keep_their_rows(spark):
    df = spark.createDataFrame([("a", r, 0.0, 63.95, -22.6, 10.0, 300.0, 65.0, 100.0) for r in ("02", "29", "99", None)], "episode_id string, runway_id string, sim_time double, lat_deg double, lon_deg double, heading_deg double, alt_msl_ft double, airspeed_kt double, alt_agl_ft double")
    got = {r.runway_id: r for r in features.geometry(df.withColumn("episode_id", F.col("runway_id")), G.RUNWAYS).collect()}
    assert len(got) == 4 and got["99"].along_track_m is None and got["02"].heading_error_deg != got["29"].heading_error_deg
    for k in ("02", "29"):
        want = G.runway_features(df.where(F.col("runway_id") == k), G.RUNWAYS[k]).first()
        assert abs(want.cross_track_error_m - got[k].cross_track_error_m) < 1e-9 and abs(want.glideslope_error_deg - got[k].glideslope_error_deg) < 1e-9


def test_feature_table(spark):
    from flightlake.plans.batch import features_of
    from approach import approaches

    out = features_of(approaches(spark, runs=2, hz=60.0, seconds=140.0)).persist()
    assert out.select("episode_id").distinct().count() == 2
    assert [c for c in out.columns if c.startswith("lat__")] == [f"lat__{f}" for f in schema.LATERAL_FEATURES]
    assert not checks.not_finite(out.where("baseline_core = 1"), ["episode_id"], [c for c in out.columns if "__" in c]).count()
    phases = {r.phase for r in out.select("phase").distinct().collect()}
    assert {"FINAL_APPROACH_ESTABLISHED", "FLARE", "ROLLOUT", "COMPLETE"} <= phases
    assert not out.where("baseline_core = 1 AND phase IN ('ROLLOUT', 'COMPLETE')").count()
    assert features.dataset_summary(out.groupBy("episode_id").count()).count() == 2


def test_envelope_of_angles_at_the_limit_equals_sql(spark, sf, tmp_path):
    """Every k with the values that put the roll at 45 degrees or next to it, and values below the rudder's range before one above it."""
    import os

    import duckdb
    from oracle import TABLES, same

    from flightlake.plans import telemetry

    for name in set(TABLES) - {"events"}:
        os.symlink(f"{sf}/{name}.parquet", tmp_path / f"{name}.parquet")
    values = "SELECT k, (k * 7 + s * 450 + d) / 10.0::DOUBLE AS v FROM range(100) a(k), unnest([-1, 1]) b(s), unnest([-1, 0, 1]) c(d) UNION ALL SELECT 50, unnest([-70.0, 65.0, 65.0, 61.0])"
    rows = f"SELECT row_number() OVER () AS event_id, TIMESTAMP '2024-01-01' + to_seconds(row_number() OVER ()) AS ts, k % 3 AS user_id, 'view' AS event_type, v AS value, '{{\"k\": ' || k || '}}' AS props FROM ({values})"
    duckdb.sql(f"COPY ({rows}) TO '{tmp_path}/events.parquet'")
    same(telemetry.QUERIES["envelope_abort"](spark, str(tmp_path)), telemetry.SQL["envelope_abort"], str(tmp_path))
