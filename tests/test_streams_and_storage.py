"""Sinks that survive a crash, the source that skips its backlog, routed lines in a stream, and storage that saves exchanges."""

import json
import random

import pytest
from pyspark.sql import functions as F

from flightlake.functions import protocol
from flightlake.operators import ordered, phases, resample
from flightlake.sources import episodes, latest
from flightlake.streaming import sinks

KIND = "run_id string, n long"


def parts(spark, folder, n=3):
    for k in range(n):
        spark.createDataFrame([("r1", 10 * k + i) for i in range(4)], KIND).coalesce(1).write.parquet(f"{folder}/{k}")


def source(spark, folder):
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def test_a_batch_that_is_run_again_writes_nothing_twice(spark, tmp_path):
    parts(spark, f"{tmp_path}/in")
    out, checkpoint = f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    write, tries = sinks.batch_writer(out), []

    def crashing(batch, number):
        write(batch, number)
        tries.append(number)
        if number == 1 and tries.count(1) == 1:
            raise RuntimeError("lost after the write, before the commit")

    start = lambda: source(spark, f"{tmp_path}/in").writeStream.foreachBatch(crashing).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="lost after the write"):
        start().awaitTermination(120)
    assert start().awaitTermination(120)
    assert tries == [0, 1, 1, 2]
    got = sinks.written_once(spark, out, KIND)
    assert sorted(r.n for r in got.collect()) == sorted(10 * k + i for k in range(3) for i in range(4))
    assert {r.batch for r in got.collect()} == {0, 1, 2}
    with pytest.raises(ValueError, match="none of"):
        sinks.batch_writer(out, "xml")


def test_command_lines_are_written_once_by_run(spark, tmp_path):
    kind = "run_id string, sim_time double, aileron double, rudder double, elevator double, throttle double, brake double"
    for k in range(2):
        spark.createDataFrame([("r", float(2 * k + i), 0.1 * k, 0.0, 0.0, 1.0, 0.0) for i in (1, 0)] + [("s", float(k), None, None, None, None, None)], kind).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second start finds nothing left to do
        q = sinks.command_sink(stream, f"{tmp_path}/out", f"{tmp_path}/c").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    got = spark.read.text(f"{tmp_path}/out").collect()
    assert len(got) == 4 and {r.run_id for r in got} == {"r"} and all(len(r.value.split(",")) == len(protocol.COMMANDS) for r in got)


def append(path, lines, end="\n"):
    with open(path, "a") as f:
        f.write("\n".join(lines) + end)


def test_the_source_gives_the_newest_line_of_each_trigger_and_resumes(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    append(folder / "a.txt", [f"a{i}" for i in range(5000)])
    append(folder / "b.txt", ["b0"])

    def start():
        keep = lambda batch, number: seen.append(sorted(tuple(r) for r in batch.collect()))
        return latest.latest_lines(spark, str(folder)).writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/c").start()

    q = start()
    q.processAllAvailable()
    assert [x for x in seen if x] == [[("a.txt", "a4999"), ("b.txt", "b0")]]
    append(folder / "a.txt", ["late1", "late2", "half a li"], end="")
    q.processAllAvailable()
    q.stop()
    append(folder / "a.txt", ["ne", "after"])
    seen.clear()
    q = start()
    q.processAllAvailable()
    q.stop()
    assert [x for x in seen if x] == [[("a.txt", "after")]]


def test_newest_line_equals_split(monkeypatch):
    monkeypatch.setattr(latest, "BLOCK", 5)
    rng = random.Random(2)
    for _ in range(400):
        raw = b"".join(rng.choice([b"x", b"yz", b"\n", b"\n", b"\r\n", b"longer line"]) for _ in range(rng.randrange(12)))
        start = rng.randrange(len(raw) + 1)
        stop = rng.randrange(start, len(raw) + 1)
        ends = [i for i in range(start, stop) if raw[i : i + 1] == b"\n"]
        want = raw[: ends[-1]].split(b"\n")[-1].rstrip(b"\r") if ends else None
        assert latest.newest_line(lambda at, n: raw[at : at + n], start, stop) == want, (raw, start, stop)


def test_lines_are_routed_with_their_reason(spark):
    fields, whole = ["a", "b", "n"], {"n"}
    cases = {"1,2,3": None, " 1 , -2e3 ,+4 ": None, "nan,inf,0": None, "1,2": "field_count", "": "field_count", "1,2,3,4": "field_count", "x,2,3": "not_a_number:a", "1,,3": "not_a_number:b", "1,2,3.0": "not_whole:n", "1,y,3.5": "not_a_number:b", None: "no_line"}
    df = spark.createDataFrame([("r", x, "keep") for x in cases], "run_id string, value string, a string")
    got = protocol.routed(df, fields=fields, whole=whole).collect()
    assert {r.value: r.reason for r in got} == cases and all((r.fields is None) == (r.reason is not None) for r in got)
    assert protocol.decode(df.drop("a"), fields=fields, whole=whole).count() == 3
    assert {r.reason for r in protocol.rejected(df, fields=fields, whole=whole).collect()} == set(cases.values()) - {None}


def test_running_error_counts_of_a_stream(spark, tmp_path):
    for k, lines in enumerate((["1,2,3", "1,2", None], ["x,2,3", "4,5,6", "7,8,9.5"])):
        spark.createDataFrame([("r", x) for x in lines], "run_id string, value string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("run_id string, value string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    counts = protocol.error_counts(protocol.routed(stream, fields=["a", "b", "n"], whole={"n"}), ["run_id"])
    seen = []
    q = counts.writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend(json.loads(x) for x in df.toJSON().collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert seen == [
        {"run_id": "r", "n_received": 1, "n_decode_errors": 2, "no_line": 1, "field_count": 1, "not_a_number": 0, "not_whole": 0},
        {"run_id": "r", "n_received": 2, "n_decode_errors": 4, "no_line": 1, "field_count": 1, "not_a_number": 1, "not_whole": 1},
    ]


def test_a_chain_over_stored_episodes_has_no_exchange(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"e{e}", i / 60, rng.random(), 100.0 - i, 50.0, 0.2, *(int(i > 40) for _ in range(3))) for e in range(6) for i in range(120)]
    df = spark.createDataFrame(rows, "episode_id string, sim_time double, x double, agl double, gs double, thr double, left int, right int, nose int")
    episodes.store(df, "stored_episodes", 3, path=f"{tmp_path}/episodes")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:

        def chain(d):
            smooth = resample.lowpass(d, ["episode_id"], ["sim_time"], ["x", "agl"], 4.0)
            grid = resample.hold_on_grid(smooth, ["episode_id"], ["sim_time"], 0.1).withColumns({"idx": F.col("grid_idx"), "t": F.col("t_grid")})
            flare = ordered.first_crossing(grid, ["episode_id"], "idx", F.col("agl") <= 60, "t").select("episode_id", F.col("idx").alias("_f"))
            return phases.landing_rows(grid.join(flare, "episode_id").where("idx >= _f"), ["episode_id"])

        plan = lambda d: chain(d)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan(episodes.stored(spark, "stored_episodes")) and "Exchange" in plan(df)
        many = resample.lowpass_many(spark.table("stored_episodes"), ["episode_id"], ["sim_time"], ["x", "agl"], 4.0)
        assert "Exchange" not in many._jdf.queryExecution().executedPlan().toString()
        columns = ["episode_id", "idx", "x", "touchdown_idx", "phase"]
        assert sorted(map(str, chain(spark.table("stored_episodes")).select(*columns).collect())) == sorted(map(str, chain(df).select(*columns).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("DROP TABLE stored_episodes")
