"""The batch plan's stages, and the small stream operators."""

import json

import approach
import pytest
from pyspark.sql import functions as F

from flightlake import schema
from flightlake.functions import text
from flightlake.operators import checks, features, ordered
from flightlake.plans import batch
from flightlake.streaming import live


def test_validated_slices_after_dedup(spark):
    rows = [("f", p, t, float(p)) for p, t in enumerate((0.0, 0.1, 0.1, 0.2, 0.3, 0.4))] + [("g", 0, 5.0, 1.0)]
    recordings = spark.createDataFrame(rows[::-1], "source_file string, input_pos long, sim_time double, x double")
    episodes = spark.createDataFrame([("e1", "s", "f", "normal", "02", 1, 3), ("e2", "s", "f", "normal", "02", None, None), ("e3", "s", "f", "normal", "02", 3, 99), ("e4", "s", "none", "normal", "02", 0, 1)], "episode_id string, session_id string, source_file string, scenario_id string, runway_id string, raw_row_start long, raw_row_end long")
    got = {}
    for r in batch.validated(recordings, episodes).orderBy("episode_id", "sim_time").collect():
        got.setdefault(r.episode_id, []).append((r.orig_row_index, r.sim_time, r.x))
    whole = [(0, 0.0, 0.0), (1, 0.1, 1.0), (2, 0.2, 3.0), (3, 0.3, 4.0), (4, 0.4, 5.0)]  # of equal times the first place in the file
    assert got == {"e1": whole[1:4], "e2": whole, "e3": whole[3:]}
    assert not checks.not_rising(batch.validated(recordings, episodes), ["episode_id"], ["orig_row_index"], "sim_time").count()


def test_bounds_past_the_end_paint_nothing(spark):
    grid = spark.createDataFrame([("a", 0.0), ("a", 7.0), ("b", 3.0)], "episode_id string, sim_time double")
    bounds = spark.createDataFrame([("a", 5.0, None), ("c", 1.0, 2.0)], "episode_id string, flare_s double, transient_end_s double")
    assert {tuple(r) for r in features.episode_bounds(grid, bounds).collect()} == {("a", 5.0, None), ("b", 4.0, None)}


@pytest.fixture(scope="module")
def table(spark):
    samples = approach.approaches(spark, runs=3, hz=20.0, seconds=130.0)
    return batch.features_of(samples.withColumn("airspeed_kt", F.col("airspeed_kt") + F.substring("run_id", 5, 1).cast("int"))).persist()


def test_scaled_splits_see_training_rows_only(spark, table):
    rows = batch.scaled_splits(table).select("fold_id", "role", "session_id", "sim_time", "lon__airspeed_kt", "lat__heading_error_cos").persist()
    assert not checks.leaking_folds(rows.select("fold_id", "session_id", "role").distinct()).count()
    core = table.where("baseline_core = 1").select("session_id", "lon__airspeed_kt").collect()
    sessions = sorted({r.session_id for r in core})
    for fold, out in enumerate(sessions):
        values = [r[1] for r in core if r.session_id != out]
        mean = sum(values) / len(values)
        std = (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5
        got = rows.where(f"fold_id = {fold}").groupBy("role").agg(F.collect_list("lon__airspeed_kt").alias("z"), F.count("*").alias("n")).collect()
        raw = {"val": [r[1] for r in core if r.session_id == out], "train": values}
        for r in got:
            want = sorted(max(-5.0, min(5.0, (v - mean) / std)) for v in raw[r.role])
            assert r.n == len(want) and max(abs(a - b) for a, b in zip(sorted(r.z), want)) < 1e-6


def test_names_and_differences(spark):
    df = spark.createDataFrame([(3, "voo", 1, 5.0), (3, "voo", 2, 7.5)], "fold int, s string, i int, x double")
    assert [r[0] for r in df.select(text.fold_name(F.col("fold"), F.col("s"))).collect()] == ["fold_03_voo"] * 2
    assert [r.d for r in ordered.backward_difference(df, ["s"], ["i"], "x", "d").orderBy("i").collect()] == [None, 2.5]


def test_small_streams(spark, tmp_path):
    rows = [("r1", 1, 10.0), ("r1", 2, 20.0), ("r2", 1, 5.0)]
    kind = "run_id string, sim_time long, x double"
    for k, part in enumerate((rows, [("r1", 3, 30.0)])):
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    source = lambda: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    seen = []
    q = live.latest_per_trigger(source(), lambda df, n: seen.append(sorted(tuple(r) for r in df.collect()))).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and seen == [[("r1", 2, 20.0), ("r2", 1, 5.0)], [("r1", 3, 30.0)]]
    q = live.cycle_log(source(), str(tmp_path / "log"), str(tmp_path / "c2")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    lines = [json.loads(x) for f in (tmp_path / "log").glob("*.json") for x in f.read_text().splitlines()]
    assert sorted((x["run_id"], x["sim_time"], x["x"]) for x in lines) == sorted([*rows, ("r1", 3, 30.0)])
    counts = live.events_per_window(source().withColumn("at", F.timestamp_seconds("sim_time")), "at", "1 minute", "2 seconds")
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted((r.run_id, r.n) for r in spark.table("counts").collect()) == [("r1", 1), ("r1", 2), ("r2", 1)]


def test_command_lines(spark):
    df = spark.createDataFrame([("r", 1.0, 0.2, -0.1, 0.5, 0.8, 0.35), ("r", 2.0, None, None, None, None, None)], "run_id string, sim_time double, aileron double, rudder double, elevator double, throttle double, brake double")
    # aileron, elevator, rudder, trim, throttle, brakes
    assert [r.value for r in live.command_lines(df).collect()] == ["0.200000,0.500000,-0.100000,0.031000,0.800000,0.350000,0.350000"]


def test_broken_samples_abort_before_anything_else(spark):
    from flightlake.operators import safety

    base = {"t": 1.0, "cross_track_m": 0.0, "heading_error_deg": 0.0, "roll_deg": 0.0, "pitch_deg": 0.0, "alt_agl_ft": 100.0, "airspeed_kt": 65.0, "rudder": 0.0, "crashed": False}
    changes = [{}, {"airspeed_kt": float("nan")}, {"roll_deg": None, "crashed": True}, {"airspeed_kt": 30.0, "roll_deg": 60.0}, {"airspeed_kt": 30.0, "crashed": True}, {"rudder": 2.0}, {"rudder": 2.0}, {"rudder": 2.0, "alt_agl_ft": 4000.0}]
    rows = [("r", *{**base, **c, "t": float(i)}.values()) for i, c in enumerate(changes)]
    df = spark.createDataFrame(rows, "run string, t double, cross_track_m double, heading_error_deg double, roll_deg double, pitch_deg double, alt_agl_ft double, airspeed_kt double, rudder double, crashed boolean")
    got = [r.abort_reason for r in safety.abort_reasons(df, ["run"], ["t"], {"rudder": (-1.0, 1.0)}, cycles=2).orderBy("t").collect()]
    assert got == ["", "telemetry_contains_nan_or_inf", "telemetry_contains_nan_or_inf", "bank_angle_exceeded", "flightgear_reported_crashed", "", "rudder_saturated", "agl_exceeded"]
    e = spark.createDataFrame([(2.0,), (0.5,), (None,)], "x double").select(safety.elevator_command(F.col("x"))).collect()
    assert [r[0] for r in e] == [1.0, 0.469, None]


def test_fixed_orders():
    assert len(schema.LATERAL_FEATURES) == 11 and len(schema.LONGITUDINAL_FEATURES) == 12 and len(schema.SCALED) == 16
