"""Gates that count in the writing pass, the fit on all rows, angles, decimation and exact duplicates."""

import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from flightlake.operators import gates, model, plots, profile, resample
from flightlake.operators.checks import CheckFailed

RULES = gates.recording_rules("t", 0.1, ("x",))


def rows(faults=()):
    out = [["a", i, i / 10, 1.0] for i in range(50)] + [["b", i, i / 10, 2.0] for i in range(50)]
    for kind in faults:
        if kind == "rising":
            out[20][2] = out[19][2]
        elif kind == "uniform":
            out[70][2] += 0.01
        else:
            out[90][3] = float(kind)
    return [tuple(r) for r in out]


def frame(spark, faults=()):
    return spark.createDataFrame(rows(faults), "ep string, idx long, t double, x double")


def test_sound_rows_are_written(spark, tmp_path):
    path = f"{tmp_path}/out"
    assert gates.write_checked(frame(spark), ["ep"], ["idx"], RULES, path, ("ep",)) == {"rising": 0, "uniform": 0, "finite": 0}
    got = spark.read.parquet(path)
    assert got.count() == 100 and set(got.columns) == {"ep", "idx", "t", "x"} and not os.path.exists(f"{path}.unchecked")


@pytest.mark.parametrize("fault,rule,n", [("rising", "rising", 1), ("uniform", "uniform", 2), ("nan", "finite", 1), ("inf", "finite", 1)])
def test_planted_faults_raise_and_nothing_takes_the_place(spark, tmp_path, fault, rule, n):
    path = f"{tmp_path}/out"
    gates.write_checked(frame(spark).where("ep = 'a'"), ["ep"], ["idx"], RULES, path)
    with pytest.raises(CheckFailed, match=f"{rule}: {n} rows, such as .*ep"):
        gates.write_checked(frame(spark, [fault]), ["ep"], ["idx"], RULES, path)
    assert spark.read.parquet(path).count() == 50 and spark.read.parquet(f"{path}.unchecked").count() == 100


def test_the_gate_scans_once(spark, tmp_path):
    frame(spark).write.parquet(f"{tmp_path}/in")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.read.parquet(f"{tmp_path}/in")
    gates.write_checked(df.mapInArrow(counted, df.schema), ["ep"], ["idx"], RULES, f"{tmp_path}/out")
    assert seen.value == 100


def made(n, inputs, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x = [rng.gauss(0, 1) for _ in range(inputs)]
        out.append((i % 3, *x, math.tanh(x[0] - x[1]), 1 / (1 + math.exp(-x[2]))))
    return out


@pytest.mark.parametrize("network,batches", [("lateral", 1), ("longitudinal", 3)])
def test_shared_fit_equals_one_task_on_the_same_batches(spark, network, batches):
    import numpy as np

    n, activations = model.NETWORKS[network]
    names = [f"f{i}" for i in range(n)]
    df = spark.createDataFrame(made(240, n), f"fold int, {', '.join(f'{c} double' for c in names)}, y0 double, y1 double").repartition(3)
    epochs = 4
    got = {(r.fold_id, r.layer): r for r in model.fit_shared(df, network, names, ["y0", "y1"], epochs, batches).collect()}
    held = df.withColumn("b", model.batch_of([*names, "y0", "y1"], batches)).toPandas()
    for fold in range(3):
        state = model.AdamW(model.start_weights(n, 2, model.TRAINING["seed"]))
        losses, kept = [], []
        for _ in range(epochs):
            for b in range(batches):
                part = held[(held.fold != fold) & (held.b == b)]
                x, y = part[names].to_numpy(), part[["y0", "y1"]].to_numpy()
                out, steps = model.forward(x, state.weights, activations)
                state.step([a for pair in model.gradients(out, y, steps, state.weights, activations) for a in pair])
            part = held[held.fold == fold]
            losses.append(float(np.mean((model.forward(part[names].to_numpy(), state.weights, activations)[0] - part[["y0", "y1"]].to_numpy()) ** 2)))
            kept.append([a.copy() for a in state.flat])
        best = int(np.argmin(losses))
        assert got[fold, 0].best_epoch == best and abs(got[fold, 0].best_val_loss - losses[best]) < 1e-9
        for k in range(3):
            assert np.abs(np.array(got[fold, k].weight) - kept[best][2 * k]).max() < 1e-9 and np.abs(np.array(got[fold, k].bias) - kept[best][2 * k + 1]).max() < 1e-9


def test_shared_fit_stops_early_and_refuses_odd_rows(spark):
    cfg = {**model.TRAINING, "patience": 1, "lr": 0.5}
    names = [f"f{i}" for i in range(11)]
    schema = f"fold int, {', '.join(f'{c} double' for c in names)}, y0 double, y1 double"
    df = spark.createDataFrame(made(60, 11), schema)
    assert all(r.best_epoch < 40 for r in model.fit_shared(df, "lateral", names, ["y0", "y1"], 12, 1, cfg).collect())
    final = model.fit_shared(df.withColumn("fold", F.lit(None).cast("int")), "lateral", names, ["y0", "y1"], 3)
    assert final.count() == 3 and final.first().best_epoch == 2
    with pytest.raises(Exception, match="no finite number"):
        model.fit_shared(df.withColumn("f3", F.lit(float("inf"))), "lateral", names, ["y0", "y1"], 1)


def test_angles_are_filtered_across_north(spark):
    data = [("a", i / 60, 359.99 if i % 2 else 0.01) for i in range(200)] + [("b", i / 60, None if i == 3 else 270.0) for i in range(30)]
    df = spark.createDataFrame(data, "ep string, t double, h double")
    plain = resample.lowpass_many(df, ["ep"], ["t"], ["h"], 4.0).where("ep = 'a' AND t > 1").collect()
    assert all(abs(r.h - 180) < 1 for r in plain)
    for turned in (resample.lowpass_many(df, ["ep"], ["t"], ["h"], 4.0, angles=["h"]), resample.lowpass(df, ["ep"], ["t"], ["h"], 4.0, angles=["h"])):
        rows = turned.where("ep = 'a' AND t > 1").collect()
        assert rows and all(min(r.h, 360 - r.h) < 0.01 and 0 <= r.h < 360 for r in rows)
    # a steady heading shows no start-up, although the filter starts from rest
    steady = resample.lowpass_many(df.where("h IS NOT NULL"), ["ep"], ["t"], ["h"], 4.0, angles=["h"]).where("ep = 'b'").collect()
    assert all(abs(r.h - 270) < 1e-6 for r in steady)


def test_long_gaps_are_held_in_chunks(spark, monkeypatch):
    df = spark.createDataFrame([("a", 0.0, 1), ("a", 100.0, 2), ("a", 100.3, 3)], "ep string, t double, v int")
    whole = [tuple(r) for r in resample.hold_on_grid(df, ["ep"], ["t"], 0.1).orderBy("grid_idx").collect()]
    monkeypatch.setattr(resample, "GAP_CHUNK", 7)
    assert [tuple(r) for r in resample.hold_on_grid(df, ["ep"], ["t"], 0.1).orderBy("grid_idx").collect()] == whole and len(whole) > 1000


def test_decimation_keeps_peaks(spark):
    data = [("a", float(i), 100.0 if i == 777 else math.sin(i)) for i in range(5000)] + [("b", 3.0, 1.0), ("c", 1.0, None), ("d", 1.0, 2.0), ("d", 1.0, -2.0)]
    got = plots.decimated(spark.createDataFrame(data, "ep string, t double, v double"), ["ep"], "t", ["v"], 50).collect()
    a = [r for r in got if r.ep == "a"]
    assert len(a) == 50 and max(r.high for r in a) == 100.0 and sum(r.n for r in a) == 5000
    assert [(r.bucket, r.low, r.high) for r in got if r.ep == "d"] == [(0, -2.0, 2.0)] and not [r for r in got if r.ep == "c"]


def test_signatures_that_clash_are_not_duplicates(spark):
    df = spark.createDataFrame([(i, float(i), float(i), float(i) + (i == 7), -float(i)) for i in range(30)], "pos long, a double, b double, c double, d double")
    assert {tuple(r) for r in profile.duplicate_columns(df, ["pos"], list("abcd")).collect()} == {("a", "b")}
    # were all four signatures equal, only the equal columns would be taken
    got = profile.confirmed_duplicates(df, list("abcd"), [("a", "b"), ("a", "c"), ("a", "d")]).collect()
    assert [tuple(r) for r in got] == [("a", "b")]
    assert profile.confirmed_duplicates(df, list("abcd"), [("c", "d")]).count() == 0


def test_pruning_keeps_what_the_catalogue_carries(spark):
    roles = [("a", "neural_input"), ("b", "excluded"), ("c", "label"), ("d", "qa_only"), ("frame", "metadata"), ("sim_time", "metadata"), ("gone", "label")]
    catalog = spark.createDataFrame(roles, "column_name string, role string")
    df = spark.createDataFrame([(1, 2.0, 3.0, 4.0, 5.0, 6.0)], "frame long, sim_time double, a double, b double, c double, d double")
    kept = set(profile.pruned(df, catalog, ["sim_time"]).columns)
    assert {"sim_time", "a", "c"} <= kept and not {"frame", "b", "gone"} & kept


def test_roles_and_units_as_published(spark):
    """Written out by hand, so that a changed constant shows."""
    want = {
        "sim_time": ("metadata", "s"), "frame": ("metadata", "count"), "/controls[0]/flight[0]/aileron[0]": ("label", ""), "/controls[0]/engines[0]/engine[0]/throttle[0]": ("label", ""),
        "/controls[0]/flight[0]/elevator-trim[0]": ("derived_feature_source", ""), "/position[0]/latitude-deg[0]": ("derived_feature_source", "deg"), "/gear[0]/gear[1]/wow[0]": ("flight_manager_only", ""),
        "/gear[0]/gear[2]/compression-norm[0]": ("flight_manager_only", "norm[0..1 or -1..1]"), "/gear[0]/gear[0]/rollspeed-ms[0]": ("flight_manager_only", "m/s"), "/velocities[0]/groundspeed-kt[0]": ("flight_manager_only", "kt"),
        "/environment[0]/wind-speed-kt[0]": ("qa_only", "kt"), "/position[0]/altitude-agl-m[0]": ("qa_only", "m"), "/surface-positions[0]/rudder-pos-norm[0]": ("qa_only", "norm[0..1 or -1..1]"),
        "/position[0]/altitude-agl-ft[0]": ("neural_input", "ft"), "/orientation[0]/roll-rate-degps[0]": ("neural_input", "deg/s"), "/orientation[0]/side-slip-rad[0]": ("neural_input", "rad"),
        "/velocities[0]/vertical-speed-fps[0]": ("neural_input", "ft/s"), "/controls[0]/flight[0]/flaps[0]": ("neural_input", ""), "/gear[0]/gear[1]/steering-norm[0]": ("excluded", "norm[0..1 or -1..1]"), "/gear[0]/wheel-m[0]": ("excluded", ""),
        "/engines[0]/engine[0]/rpm[0]": ("excluded", ""),
    }
    rows = profile.assign_roles(spark.createDataFrame([(n, False) for n in want], "column_name string, is_constant boolean")).collect()
    assert {r.column_name: (r.role, r.unit) for r in rows} == want
    assert {r.exclusion_reason for r in rows if r.column_name.endswith(("steering-norm[0]", "rpm[0]"))} == {"forbidden_input_family_section10"}
