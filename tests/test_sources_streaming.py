import json
import math
import random

import approach as mock
import pytest
from pyspark.sql import functions as F

from flightlake import schema
from flightlake.functions import geometry as G
from flightlake.operators import model
from flightlake.sources import recordings
from flightlake.streaming import live


@pytest.fixture
def files(tmp_path):
    head = [schema.PROPERTY_PATHS[c] for c in ("frame", "sim_time", "lat_deg")]
    (tmp_path / "a.csv").write_text(",".join(head) + "\n1,0.5,63.9\n2,0.6,63.8\n")
    (tmp_path / "b.csv").write_text(";".join(head) + "\n1;0,5;63,9\n2;0,6;nan\n")
    (tmp_path / "voo_Inicio-TESTE.csv").write_bytes((",".join([*head, "observação"]) + "\n1,0.5,63.9,1\n").encode("latin-1"))
    return str(tmp_path)


def test_inventory_and_scan(spark, files):
    inv = recordings.inventory(spark, files).persist()
    rows = {r.source_file: r for r in inv.collect()}
    assert (rows["a.csv"].delimiter, rows["a.csv"].decimal, rows["a.csv"].n_cols_header, rows["a.csv"].n_rows_incl_header_minus1) == (",", ".", 3, 2)
    assert (rows["b.csv"].delimiter, rows["b.csv"].decimal) == (";", ",")
    assert rows["voo_Inicio-TESTE.csv"].encoding == "latin-1" and not rows["voo_Inicio-TESTE.csv"].eligible_for_training
    assert not recordings.changed_copies(inv, inv).count()
    got = recordings.scan(spark, inv)
    seen = {(r.source_file, r.sim_time, r.lat_deg) for r in got.where("source_file <> 'voo_Inicio-TESTE.csv'").collect()}
    assert seen == {("a.csv", 0.5, 63.9), ("a.csv", 0.6, 63.8), ("b.csv", 0.5, 63.9), ("b.csv", 0.6, None)}
    assert got.count() == 5 and "observa_o" in got.columns


def test_lines_keep_their_order(spark, tmp_path):
    """However the files are dealt, input_pos follows the lines of each; a file of another header is read beside them."""
    for k in range(3):
        (tmp_path / f"r{k}.csv").write_text("sim_time,x\n" + "\n".join(f"{9000 - i},{i}" for i in range(3000)) + "\n")
    (tmp_path / "z.csv").write_text("x,sim_time,y\n1,2,3\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = recordings.scan(spark, recordings.inventory(spark, str(tmp_path))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for k in range(3):
        assert [r.x for r in sorted((r for r in rows if r.source_file == f"r{k}.csv"), key=lambda r: r.input_pos)] == list(range(3000))
    assert [(r.x, r.sim_time, r.y) for r in rows if r.source_file == "z.csv"] == [(1.0, 2.0, 3.0)]
    pruned = recordings.scan(spark, recordings.inventory(spark, str(tmp_path)), ["x"])
    assert pruned.columns == ["source_file", "input_pos", "x"]


def test_ingest_and_manifests(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "src").mkdir()
    (tmp_path / "raw/a.csv").write_text("sim_time\n1\n")
    inv, action = recordings.ingest(spark, str(tmp_path / "src"), str(tmp_path / "raw"))
    assert action == "source_missing_raw_dir_already_canonical" and inv.count() == 1
    (tmp_path / "src/a.csv").write_text("sim_time\n1\n")
    (tmp_path / "src/b.csv").write_text("sim_time\n2\n")
    inv, action = recordings.ingest(spark, str(tmp_path / "src"), str(tmp_path / "raw"))
    assert action == "source" and {r.source_file: r.copy_action for r in inv.collect()} == {"a.csv": "already_present_verified", "b.csv": "not_copied_yet"}
    (tmp_path / "src/a.csv").write_text("sim_time\n9\n")
    with pytest.raises(ValueError, match="a.csv"):
        recordings.ingest(spark, str(tmp_path / "src"), str(tmp_path / "raw"))
    (tmp_path / "m.csv").write_text("fold_id,val_session,session_id,role\n0,02,02,val\n0,02,03,train\n")
    assert [(r.fold_id, r.session_id) for r in recordings.read_manifest(spark, str(tmp_path / "m.csv"), "folds").orderBy("session_id").collect()] == [(0, "02"), (0, "03")]
    text = recordings.overrides_yaml(spark.createDataFrame([("a", 3, "02"), ("b", None, "29")], "episode_id string, flare_idx int, runway_id string"), "episode_id")
    assert recordings.read_configs(text, "yaml") == {"a": {"flare_idx": 3, "runway_id": "02"}, "b": {"flare_idx": None, "runway_id": "29"}}
    assert recordings.read_configs('{"a": 1}', "json") == {"a": 1}
    rows = spark.createDataFrame([("e1", 1.0), ("e2", 2.0)], "episode_id string, x double")
    recordings.write_episodes(rows, str(tmp_path / "ep"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "ep")).select("episode_id", "x").collect()} == {("e1", 1.0), ("e2", 2.0)}


def test_report_and_manifest(spark, files):
    from flightlake.operators import profile

    inv = recordings.inventory(spark, files)
    rows = recordings.scan(spark, inv)
    cols = ["frame", "sim_time", "lat_deg"]
    prof = profile.assign_roles(profile.column_profile(rows, cols))
    text = recordings.qa_report(inv, prof, profile.timing_audit(rows, ["source_file"], ["input_pos"], "sim_time").where("n_rows > 1"))
    assert "- files: 2" in text and "| a.csv | 2 | 10.00 | 0 | 0.100 |" in text and "voo_Inicio-TESTE.csv" in text
    doc = json.loads(model.manifest({"lateral": 15}, {"lateral": schema.LATERAL_FEATURES, "longitudinal": schema.LONGITUDINAL_FEATURES}, {"lateral": schema.LATERAL_LABELS, "longitudinal": schema.LONGITUDINAL_LABELS}))
    assert doc["networks"]["longitudinal"]["layers"] == [12, 64, 64, 2] and doc["networks"]["lateral"]["epochs"] == 15


def test_scaler_document(spark):
    df = spark.createDataFrame([(0, "a", 1.0, 2.0, False), (0, "b", 3.0, 1.0, True)], "fold_id int, variable string, mean double, std double, degenerate boolean")
    doc = json.loads(recordings.scaler_json(df).first().json)
    assert doc["mean"] == {"a": 1.0, "b": 3.0} and doc["degenerate_std_variables"] == ["b"]


def test_online_manager_confirms_at_the_last_sample():
    m = live.Manager(0.1)
    assert m.step(30, False, False, False, 60) == "FINAL_APPROACH_ESTABLISHED"
    assert m.step(10, False, True, True, 60) == "CONTACT_CANDIDATE"  # flare and contact in one sample
    assert [m.step(0, False, True, True, 60) for _ in range(2)] == ["CONTACT_CANDIDATE", "TOUCHDOWN_CONFIRMED"]
    assert [m.step(0, False, True, True, 60) for _ in range(5)][-1] == "ROLLOUT"
    assert [m.step(0, False, True, True, 1) for _ in range(20)][-1] == "COMPLETE"


def test_online_bounce_and_loss():
    m = live.Manager(0.1)
    m.step(10, False, True, False, 60)
    assert m.step(10, False, False, False, 60) == "FLARE" and m.s["unconfirmed"] == 1
    for _ in range(3):
        m.step(0, False, True, True, 60)
    assert m.s["phase"] == "TOUCHDOWN_CONFIRMED"
    assert m.step(2, False, False, False, 60) == "BOUNCE" and m.s["bounces"] == 1
    assert m.step(1, True, False, False, 60) == "BOUNCE"  # the nose alone does not end it
    assert m.step(0, False, True, False, 60) == "CONTACT_CANDIDATE"


@pytest.mark.parametrize("change,reason", [({"cross_track_m": 151}, "cross_track_exceeded"), ({"airspeed_kt": 39.8}, "airspeed_too_low"), ({"cross_track_m": 151, "roll_deg": 50}, "cross_track_exceeded"), ({"roll_deg": 50, "crashed": 1}, "flightgear_reported_crashed"), ({}, "")])
def test_envelope(change, reason):
    base = {"cross_track_m": 0, "heading_error_deg": 0, "roll_deg": 0, "pitch_deg": 0, "alt_agl_ft": 100, "airspeed_kt": 65, "crashed": 0}
    assert live.abort_reason({**base, **change}, {}) == reason
    assert live.abort_reason(base, {"rudder": 30}) == "rudder_saturated"


def test_the_envelope_holds_only_in_the_air():
    slow = {"cross_track_m": 0, "heading_error_deg": 0, "roll_deg": 0, "pitch_deg": 0, "alt_agl_ft": 0, "airspeed_kt": 5, "crashed": 0}
    assert live.abort_reason(slow, {}) == "airspeed_too_low" and live.abort_reason(slow, {}, neural=False) == ""


def test_rollout_law():
    got = live.rollout_commands(2.0, 10.0, 30.0)
    assert (got["rudder"], got["brake"], got["throttle"], got["aileron"]) == (0.3, 0.35, 0.0, 0.0)
    got = live.rollout_commands(0.0, -90.0, 1.0)
    assert (got["rudder"], got["brake"]) == (-0.6, 0.7)


SAMPLE = {
    "lat_deg": 63.95, "lon_deg": -22.605, "alt_msl_ft": 300.0, "alt_agl_ft": 165.0, "heading_deg": 0.0, "roll_deg": 0.0, "pitch_deg": 3.0, "airspeed_kt": 65.0, "groundspeed_kt": 60.0,
    "gear_wow_nose": 0, "gear_wow_left": 0, "gear_wow_right": 0, "crashed": 0, "frozen": 0,
}


def cycles(*changes, dt=0.1):
    r = live.Replay(None, dt, G.RUNWAYS["02"])
    return [r.handle({"sim_time": 1 + i * dt, **SAMPLE, **c}) for i, c in enumerate(changes)]


def test_all_four_commands_are_limited():
    wanted = {"aileron_pred": 0.5, "rudder_pred": -2.0, "elevator_effective_pred": 0.331, "throttle_pred": 0.8}
    got = cycles(wanted, wanted, {**wanted, "throttle_pred": 0.1, "aileron_pred": -1.0})
    take = lambda c: [round(x[c], 6) for x in got]
    assert take("aileron") == [0.2, 0.4, 0.2] and take("rudder") == [-0.2, -0.4, -0.6]  # saturated at -1 first
    assert take("elevator") == [0.2, 0.3, 0.3] and take("throttle") == [0.8, 0.8, 0.7]  # trim taken off once; the first throttle is its target


def test_saturation_lasts_thirty_cycles():
    got = cycles(*[{"rudder_pred": 1.5}] * 31)
    assert [x["abort_reason"] for x in got] == [""] * 29 + ["rudder_saturated"] * 2


@pytest.mark.parametrize("value", [None, float("nan"), float("inf")])
def test_broken_telemetry_ends_a_run(value):
    got = cycles({}, {"airspeed_kt": value}, {})
    assert [x["abort_reason"] for x in got] == ["", *["telemetry_contains_nan_or_inf"] * 2] and got[1]["along_track_m"] is None


def test_broken_outputs_end_a_run():
    assert cycles({"throttle_pred": float("nan")})[0]["abort_reason"] == "longitudinal_model_output_non_finite"
    assert cycles({"aileron_pred": float("inf")})[0]["abort_reason"] == "lateral_model_output_non_finite"


def test_readiness_takes_five_sane_samples():
    got = cycles({}, {}, {}, {}, {}, {"frozen": 1}, {}, {}, {}, {}, {})
    assert [x["ready"] for x in got] == [False] * 4 + [True] + [False] * 5 + [True]
    r = live.Replay(None, 0.1, G.RUNWAYS["02"])
    rows = [r.handle({"sim_time": t, **SAMPLE}) for t in (1, 2, 3, 3, 4, 5, 6, 7, 8)]
    assert rows[3] is None and [x["ready"] for x in rows if x] == [False] * 7 + [True]  # the repeated sample starts the count again


def test_completion_after_three_seconds_at_rest():
    down = {"gear_wow_left": 1, "gear_wow_right": 1, "alt_agl_ft": 0.0}
    got = cycles(*[{"alt_agl_ft": 10.0}] * 2, *[down] * 12, *[{**down, "groundspeed_kt": 1.0, "airspeed_kt": 0.0}] * 70)
    at = next(i for i, x in enumerate(got) if x["phase"] == "COMPLETE")
    first = next(i for i, x in enumerate(got) if x["finished"])
    assert got[first]["sim_time"] - got[at]["sim_time"] > 3 and not got[first]["abort_reason"] and first - at == 31
    assert [x["reason"] for x in got if x["reason"]] == ["first_main_gear_contact", "both_main_gear_contact", "any_gear_contact", "groundspeed_below_threshold"] or got[0]["reason"] == "flare_height_reached"


def test_snapshot_log_and_summary(spark):
    samples = mock.approaches(spark, runs=2, seconds=150.0)
    runs = live.replay_batch(samples).persist()
    snap = live.touchdown_snapshot(runs, samples, ["airspeed_kt", "roll_deg"]).collect()
    first = {r.run_id: r.t for r in runs.where("phase = 'TOUCHDOWN_CONFIRMED'").groupBy("run_id").agg(F.min("sim_time").alias("t")).collect()}
    speed = {(r.run_id, r.sim_time): r.airspeed_kt for r in samples.collect()}
    assert {r.run_id: (r.sim_time, r.airspeed_kt) for r in snap} == {k: (t, speed[k, t]) for k, t in first.items()} and len(snap) == 2
    log = [r.new_state for r in live.transition_log(runs).where("run_id = 'run-0'").orderBy("sim_time").collect()]
    assert log[0] == "FLARE" and log[-1] == "COMPLETE"
    assert {(r.run_id, r.outcome, r.final_phase) for r in live.run_summary(runs).collect()} == {("run-0", "completed", "COMPLETE"), ("run-1", "completed", "COMPLETE")}


def test_manager_equals_its_rules():
    """Random samples against the rules told in one place: each phase's counter, then the first rule that applies."""
    rng = random.Random(3)
    for _ in range(60):
        m, phase, n = live.Manager(0.1), "FINAL_APPROACH_ESTABLISHED", 0
        state = [30.0, False, False, False, 60.0]
        for _ in range(120):
            if rng.random() < 0.3:
                state = [rng.choice([5.0, 30.0]), *(rng.random() < 0.6 for _ in range(3)), rng.choice([1.0, 60.0])]
            agl, nose, left, right, gs = state
            both, main, touch = left and right, left or right, left or right or nose
            if phase == "FINAL_APPROACH_ESTABLISHED" and agl <= 20:
                phase = "FLARE"
            if phase in ("FLARE", "BOUNCE") and main:
                phase, n = "CONTACT_CANDIDATE", int(both)
            elif phase == "CONTACT_CANDIDATE":
                n = n + 1 if both else 0
                if n >= 3:
                    phase = "TOUCHDOWN_CONFIRMED"
                elif not main:
                    phase = "FLARE"
            elif phase == "TOUCHDOWN_CONFIRMED":
                n += 1
                if not touch:
                    phase, n = "BOUNCE", 0
                elif n >= 8:
                    phase, n = "ROLLOUT", 0
            elif phase == "ROLLOUT":
                n = n + 1 if gs < 5 else 0
                phase = "COMPLETE" if n >= 20 else phase
            assert m.step(agl, nose, left, right, gs) == phase


def test_stale_stream_row():
    """A timer without a sample ends a live run as stale; here the state that it leaves."""
    r = live.Replay(None, 0.1, G.RUNWAYS["02"])
    r.handle({"sim_time": 1.0, **SAMPLE})
    late = r.handle({"sim_time": 1.0 + live.STALE_S + 0.1, **SAMPLE})
    assert late["abort_reason"] == "telemetry_stale" and json.loads(json.dumps(r.s))["abort"] == "telemetry_stale" and math.isfinite(late["along_track_m"])


def test_online_geometry_equals_columns(spark):
    d = mock.approaches(spark, seconds=5).limit(20)
    want = {r.sim_time: r for r in G.runway_features(d.withColumn("h", F.col("heading_deg")), G.RUNWAYS["02"]).collect()}
    for r in d.collect():
        g = live.geometry(r.asDict(), G.RUNWAYS["02"])
        assert abs(g["along_track_m"] - want[r.sim_time].along_track_m) < 1e-9 and abs(g["glideslope_error_deg"] - want[r.sim_time].glideslope_error_deg) < 1e-9


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    samples = mock.approaches(spark, runs=2, seconds=150.0)
    for k, cut in enumerate(((0, 100), (100, 200))):
        samples.where(f"sim_time >= {cut[0]} AND sim_time < {cut[1]}").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    source = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = live.replay_stream(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    got = spark.read.parquet(str(tmp_path / "out"))
    want = live.replay_batch(samples)
    cols = ["run_id", "sim_time", "phase", "ready", "abort_reason", "brake"]
    a, b = ({tuple(r) for r in x.select(*cols).collect()} for x in (got, want))
    assert a == b and {r[2] for r in b} >= {"FLARE", "ROLLOUT", "COMPLETE"}


def test_network_learns_and_loads(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 11))
    y = np.column_stack([np.tanh(x[:, 0]), 0.3 * x[:, 1]])
    rows = [(0, "val" if i % 5 == 0 else "train", *map(float, x[i]), *map(float, y[i])) for i in range(len(x))]
    names = [f"f{i}" for i in range(11)]
    df = spark.createDataFrame(rows, ["fold_id", "role", *names, "a", "b"]).withColumn("fold_id", F.col("fold_id").cast("int"))
    fitted = model.fit(df, "lateral", names, ["a", "b"], epochs=40).persist()
    assert fitted.first().best_val_loss < 0.1 * float(y.var())
    with pytest.raises(ValueError, match="order"):
        model.load_weights(fitted, "lateral", names, schema.LATERAL_LABELS[::-1])
    w = model.load_weights(fitted, "lateral", names, schema.LATERAL_LABELS)
    assert 150 < model.bounded(df, ["fold_id", "role"], names, 100).count() < 250 and model.bounded(df, ["fold_id", "role"], names, 1000).count() == 600
    got = model.predict(df, w, names, ["p", "q"], ("linear", "linear")).orderBy("f0").collect()
    want = {r[2]: model.forward(np.array([r[2:13]]), w, ("linear", "linear"))[0][0] for r in rows}
    assert all(abs(r.p - want[r.f0][0]) < 1e-9 for r in got)
    jvm = df.limit(5).select("f0", *model.predict_expressions(F.array(*names), w, ("linear", "linear"))).collect()
    assert all(abs(r[1] - want[r.f0][0]) < 1e-9 for r in jvm)


def test_gradients_match_differences():
    import numpy as np

    w = model.start_weights(12, 2, 1)
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(7, 12)), rng.random((7, 2))
    act = ("linear", "sigmoid")
    out, kept = model.forward(x, w, act)
    g = model.gradients(out, y, kept, w, act)
    for k in range(3):
        e = np.zeros_like(w[k][0])
        e[0, 0] = 1e-6
        up, down = ([(a + s * e if i == k else a, b) for i, (a, b) in enumerate(w)] for s in (1, -1))
        diff = (np.mean((model.forward(x, up, act)[0] - y) ** 2) - np.mean((model.forward(x, down, act)[0] - y) ** 2)) / 2e-6
        assert abs(diff - g[k][0][0, 0]) < 1e-6


def test_split_has_a_contract(spark):
    cols = [f"lat__{f}" for f in schema.LATERAL_FEATURES] + [f"laty__{f}" for f in schema.LATERAL_LABELS]
    rows = spark.createDataFrame([("e", *map(float, range(13)))], ["episode_id", *cols])
    r = model.split(rows, "lateral").first()
    assert r.x == list(map(float, range(11))) and r.y == [11.0, 12.0] and r.episode_id == "e"
    with pytest.raises(ValueError, match="missing columns: laty__rudder_command"):
        model.split(rows.drop("laty__rudder_command"), "lateral")
    for bad in (None, float("nan"), float("inf")):
        with pytest.raises(Exception, match="is no finite number"):
            model.split(rows.withColumn("lat__agl_ft", F.lit(bad).cast("double")), "lateral").collect()
