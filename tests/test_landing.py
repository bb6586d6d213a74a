"""The landing state machine against row-by-row expectations."""

import random

import pytest

from flightlake.operators import checks, phases
from flightlake.schema import LANDING

CFG = {**LANDING, "complete_s": 1.0}
COLUMNS = "ep string, idx long, t double, agl double, gs double, thr double, left int, right int, nose int"


def frame(n, left=(), right=(), nose=(), gs=60.0, agl=30.0, thr=0.3, ep="a"):
    pick = lambda x, i: x(i) if callable(x) else x
    return [(ep, i, i / 10, float(pick(agl, i)), float(pick(gs, i)), float(pick(thr, i)), int(i in left), int(i in right), int(i in nose)) for i in range(n)]


def run(spark, data, gap="flare"):
    rows = phases.landing_rows(spark.createDataFrame(data, COLUMNS), ["ep"], gap, CFG)
    return rows.persist()


def one(rows):
    r = rows.orderBy("idx").collect()
    return r[0], [x.phase for x in r]


def both(*spans):
    s = {i for a, b in spans for i in range(a, b + 1)}
    return {"left": s, "right": s}


def test_one_wheel_only(spark):
    r, p = one(run(spark, frame(20, left=range(5, 20))))
    assert (r.candidate_idx, r.touchdown_idx) == (5, None) and p[5:] == ["CONTACT_CANDIDATE"] * 15


def test_nose_only(spark):
    rows = run(spark, frame(20, nose=range(5, 20)))
    assert one(rows)[0].candidate_idx is None
    flags = phases.review_flags(rows, phases.contact_records(rows, ["ep"]), ["ep"], CFG)
    assert [f.flag for f in flags.collect()] == ["no_main_gear_contact_found_in_window"]
    assert not checks.nose_only_candidate(rows, ["ep"]).count()


@pytest.mark.parametrize("n,confirmed", [(2, None), (3, 10)])
def test_three_samples_confirm(spark, n, confirmed):
    rows = run(spark, frame(30, gs=20, **both((10, 9 + n))))
    assert one(rows)[0].touchdown_idx == confirmed
    assert not checks.unbacked_touchdown(rows, ["ep"], CFG).count()


def test_loss_before_confirmation(spark):
    rows = run(spark, frame(40, gs=lambda i: 2 if i >= 20 else 60, **both((5, 6), (20, 39))))
    r, p = one(rows)
    assert r.touchdown_idx == 20 and p[7:20] == [None] * 13
    rec = phases.contact_records(rows, ["ep"]).collect()
    assert [(x.kind, round(x.start_s, 3), round(x.duration_s, 3)) for x in rec] == [("unconfirmed_intermittent_contact", 0.5, 0.2)]


def test_bounce(spark):
    rows = run(spark, frame(40, gs=2, **both((5, 11), (14, 39))))
    r, p = one(rows)
    assert r.touchdown_idx == 5 and r.rollout_idx == 14 and p[12:14] == ["BOUNCE"] * 2
    rec = [x for x in phases.contact_records(rows, ["ep"]).collect() if x.kind == "bounce"]
    assert len(rec) == 1 and abs(rec[0].start_s - 1.2) < 1e-9
    names = [(x.previous_state, x.new_state) for x in phases.transitions(rows, ["ep"]).orderBy("idx").collect()]
    assert ("TOUCHDOWN_CONFIRMED", "BOUNCE") in names and ("BOUNCE", "FLARE") in names and ("ROLLOUT", "COMPLETE") in names


def test_long_loose_contact_is_flagged(spark):
    rows = run(spark, frame(60, left=range(5, 30)))
    rec = phases.contact_records(rows, ["ep"])
    flags = {f.flag for f in phases.review_flags(rows, rec, ["ep"], CFG).collect()}
    assert flags == {"long_unconfirmed_CONTACT_CANDIDATE_interval: t=[0.50,2.90]s duration=2.50s (>= diagnostic threshold 2.0s)", "touchdown_never_confirmed"}
    assert not checks.unflagged_long_contact(rec, phases.review_flags(rows, rec, ["ep"], CFG), ["ep"], CFG).count()


def test_touch_and_go(spark):
    data = frame(60, gs=lambda i: 40 + i, agl=lambda i: max(0, i - 30) * 2.0, thr=0.9, **both((5, 30)))
    r, p = one(run(spark, data))
    assert (r.complete_idx, r.complete_reason) == (31, "liftoff_after_rollout_touch_and_go") and p[31:] == ["COMPLETE"] * 29


def test_rows_after_the_rollout_run(spark):
    data = frame(40, gs=30, **both((5, 20), (24, 39)))
    assert one(run(spark, data))[1][21:24] == [None] * 3
    assert one(run(spark, data, "rollout"))[1][21:24] == ["ROLLOUT"] * 3


def naive(rows):
    """Row-by-row: the first N both-main samples, the first M any-wheel samples from there, the end by alternating runs."""
    need = {"t": 3, "r": 8, "c": 10, "l": 10}
    on = [(r[6] or r[7], r[6] and r[7], r[6] or r[7] or r[8]) for r in rows]

    def first(k, n, start):
        at = start
        while at < len(rows):
            end = at
            while end < len(rows) and on[end][k]:
                end += 1
            if end - at >= n:
                return at, end
            at = max(end, at + 1)
        return None, None

    td, _ = first(1, need["t"], 0)
    ro, re = first(2, need["r"], td) if td is not None else (None, None)
    done = why = None
    at = ro
    while ro is not None and at < len(rows) and done is None:
        slow, air = rows[at][4] < 5, not on[at][2]
        if not slow and not air:
            at += 1
            continue
        end = at
        while end < len(rows) and (rows[end][4] < 5 if slow else not on[end][2]):
            end += 1
        a, b = rows[at], rows[end - 1]
        if slow and end - at >= need["c"]:
            done, why = at, "groundspeed_below_threshold"
        elif not slow and end - at >= need["l"] and b[3] > a[3] and (b[4] > a[4] + 2 or b[5] >= 0.6):
            done, why = at, "liftoff_after_rollout_touch_and_go"
        at = end
    if ro is not None and done is None:
        done, why = len(rows) - 1, "end_of_recording_window"
    label = []
    for i in range(len(rows)):
        if done is not None and i >= done:
            label.append("COMPLETE")
        elif ro is not None and i >= ro:
            label.append("ROLLOUT" if i < re else None)
        elif td is not None and i >= td:
            label.append("TOUCHDOWN_CONFIRMED" if on[i][2] else "BOUNCE")
        else:
            label.append("CONTACT_CANDIDATE" if on[i][0] else None)
    return td, ro, done, why, label


def test_random_sequences(spark):
    rng, data, want = random.Random(3), [], {}
    for e in range(150):
        p, rows = rng.random() * 0.5 + 0.5, []
        state = [0, 0, 0]
        for i in range(rng.randint(1, 90)):
            state = [rng.random() < p if rng.random() < 0.3 else s for s in state]
            rows.append((f"e{e}", i, i / 10, rng.random() * 9, rng.choice([1.0, 3.0, 20.0, 40.0]) if rng.random() < 0.3 or not rows else rows[-1][4], rng.random(), *map(int, state)))
        data += rows
        want[f"e{e}"] = naive(rows)
    got = {}
    for r in run(spark, data).orderBy("ep", "idx").collect():
        got.setdefault(r.ep, [r.touchdown_idx, r.rollout_idx, r.complete_idx, r.complete_reason, []])[4].append(r.phase)
    for e, w in want.items():
        assert tuple(got[e][:4]) == w[:4], e
        assert got[e][4] == w[4], e
