"""The report by groupings and episodes: what it shuffles, and its rows against the measures and rates of each grouping alone."""

import math
import random

import pytest

from flightlake.operators import metrics
from flightlake.plans import telemetry

GROUPS = ["phase", "scenario", "episode"]


def shuffled(spark) -> int:
    """Records that all stages so far wrote for a shuffle."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    stages = context.statusStore().stageList(jvm.java.util.ArrayList(), False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_report_shuffles_each_row_once(spark):
    df = telemetry.predictions(spark, "/root/testdata/sf0.01")
    n, before = df.count(), shuffled(spark)
    metrics.report(df, ["fold"], GROUPS, "episode", ["time"], "y", "p", 0.1, 0.9).collect()
    assert n == 60_000 and n <= shuffled(spark) - before < 2 * n


@pytest.mark.parametrize("most", [3, 10_000])
def test_percentiles_of_few_groups_shuffle_no_rows(spark, most, monkeypatch):
    """Where Spark takes the table for too large to be sent, as it does with more rows than these."""
    monkeypatch.setattr(metrics, "MOST_SORTED", most)
    df = telemetry.predictions(spark, "/root/testdata/sf0.01")
    before, threshold = shuffled(spark), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(threshold, "1KB")
    try:
        metrics.exact_percentile(df, ["fold", "phase"], "p", 0.95, "q").collect()
    finally:
        spark.conf.unset(threshold)
    assert shuffled(spark) - before < df.count() / 4


@pytest.mark.parametrize("sent", [0, 10_000])
def test_report_of_odd_rows(spark, sent, monkeypatch):
    """Missing, NaN and infinite values, null groups and episodes, episodes of one row and of more than a window keeps in memory."""
    monkeypatch.setattr(metrics, "MOST_SENT", sent)
    rng, nan, inf, rows = random.Random(3), math.nan, math.inf, []
    sizes = {1: 1, 2: 2, 3: 40, 4: 5000, 5: 21, 6: 3, None: 30, 8: 2}
    for episode, n in sizes.items():
        for i in range(n):
            y, p = rng.random(), rng.gauss(0.5, 0.3)
            y, p = (None, p) if episode == 3 and i % 7 == 0 else (y, nan) if episode == 5 and i % 5 == 0 else (y, inf) if episode == 6 and i else (None, None) if episode == 8 else (y, p)
            rows.append(("ab"[i % 2 if episode != 1 else 0], rng.choice(["x", "y", None]), str(i % 3), episode, float(i), y, p))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "fold string, phase string, scenario string, episode long, time double, y double, p double")
    by = ["fold", "grouping", "group"]
    keyed = lambda d: {tuple(r[c] for c in by): r.asDict() for r in d.collect()}
    got = keyed(metrics.report(df, ["fold"], GROUPS, "episode", ["time"], "y", "p", 0.1, 0.9))
    want = keyed(metrics.by_groupings(df, ["fold"], GROUPS, "y", "p", 0.1, 0.9))
    marked = metrics._in_groupings(df.withColumn("e", df.episode), ["fold"], GROUPS, ["e", "time", "y", "p"])
    rates = keyed(metrics.command_rate_mae(marked, by, ["e"], "time", "y", "p"))
    assert set(got) == set(want) == set(rates)
    for k, row in got.items():
        for name, x in (want[k] | rates[k]).items():
            assert x == row[name] or (isinstance(x, float) and (math.isnan(x) and math.isnan(row[name]) or row[name] == pytest.approx(x, rel=1e-9, abs=1e-12))), (k, name, x, row[name])
    alone = keyed(metrics.report(df, ["fold"], ["phase"], "episode", ["time"], "y", "p", 0.1, 0.9))
    assert set(alone) == {k for k in got if k[1] in ("global", "phase")}
