"""From a circuit's recording to episodes: one made flight row by row, and what is missing from odd ones."""

import pytest

from flightlake.functions import geometry as G
from flightlake.operators import circuit, phases
from flightlake.schema import LANDING

SCHEMA = "ep string, idx long, t double, agl double, gs double, thr double, left int, right int, nose int, lat_deg double, lon_deg double, heading_deg double, vertical_speed_fps double, flaps double"


def row(i, ep="a", agl=100.0, gs=60.0, thr=0.3, wheels="", heading=0.0, along=-5000.0, cross=0.0, vs=0.0, flaps=0.0, runway="02"):
    lat, lon = G.point_at(along, cross, G.RUNWAYS[runway])
    return (ep, i, i / 10, agl, gs, thr, int("l" in wheels), int("r" in wheels), int("n" in wheels), lat, lon, heading, vs, flaps)


def flight(ep="a"):
    """Touch-and-go on 02 (touchdown on row 40), 30 s in the air, a turn to 29, and a landing there (row 520) that stops."""
    rows = []
    for i in range(700):
        r = {"ep": ep}
        if i < 40:
            r |= {"agl": 40.0 - i, "vs": -10.0}
        elif i < 80:
            r |= {"agl": 0.0, "wheels": "lrn", "gs": 50.0}
        elif i < 140:
            r |= {"agl": i - 80.0, "gs": 50.0 + (i - 80), "thr": 1.0}
        elif i < 520:
            r |= {"agl": 300.0 if i < 480 else (519.5 - i), "heading": 180.0 if i < 300 else 270.0, "runway": "29", "along": -3000.0 + 7 * (i - 100), "vs": -10.0 if i >= 320 else 0.0, "flaps": 0.3 if i >= 320 else 0.0}
            r["cross"] = 1000.0 if i < 350 else 20.0
        else:
            r |= {"agl": 0.0, "wheels": "" if i in (530, 531) else "lrn" if i >= 521 else "l", "gs": max(0.0, 40.0 - (i - 520) / 2), "heading": 270.0, "runway": "29", "along": 0.0}
        rows.append(row(i, **r))
    return rows


def of(spark, data):
    got = circuit.circuit_episodes(spark.createDataFrame(data, SCHEMA), ["ep"]).orderBy("ep", "window").collect()
    return [r.asDict() for r in got]


def test_touch_and_go_then_a_landing_on_another_runway(spark):
    first, second = of(spark, flight())
    assert first["episode_id"] == "a__landing-01" and first["runway_id"] == "02" and second["runway_id"] == "29"
    assert (first["raw_row_start"], first["touchdown_idx"], first["complete_idx"], first["complete_reason"]) == (0, 40, 80, "liftoff_after_rollout_touch_and_go")
    assert first["raw_row_end"] == 80 and first["n_samples_raw"] == 81 and first["duration_s_raw"] == pytest.approx(8.0)
    # window 2 begins with the gap's last row above 50 ft; the approach was prepared long before
    assert second["gap_start_idx"] == 131 and second["gap_end_idx"] == 479
    assert (second["full_approach_start_idx"], second["raw_row_start"]) == (320, 320) and second["baseline_core_start_idx"] == 350
    assert (second["candidate_idx"], second["touchdown_idx"], second["flare_idx"]) == (520, 521, 500)
    assert second["complete_reason"] == "groundspeed_below_threshold" and second["complete_idx"] == 591 == second["raw_row_end"]
    assert first["has_known_initialization_transient"] and not second["has_known_initialization_transient"] and not second["manual_review_needed"]


def test_bounces_along_the_tiers(spark):
    # no run of both wheels lasts 0.3 s, one of the left wheel does
    data = [row(i, wheels="lr" if i in (5, 6, 9) else "l" if 20 <= i < 30 else "", agl=1.0) for i in range(40)]
    e = phases.circuit_events(phases.circuit_rows(spark.createDataFrame(data, SCHEMA), ["ep"]), ["ep"]).collect()
    got = sorted((r.event, r.idx, r.tier) for r in e)
    one, two = phases.TIER_NAMES[:2]
    assert [x for x in got if x[0] == "BOUNCE"] == [("BOUNCE", 6, one), ("BOUNCE", 6, two), ("BOUNCE", 9, one), ("BOUNCE", 9, two)]
    assert [x[:2] for x in got if x[0] != "BOUNCE"] == [("COMPLETE", 39), ("CONTACT_CANDIDATE", 5), ("ROLLOUT", 20), ("TOUCHDOWN_CONFIRMED", 20)]


def test_recordings_without_gap_contact_or_approach(spark):
    still = [row(i, "still", wheels="lrn" if i >= 10 else "", agl=0.0, gs=1.0) for i in range(60)]
    air = [row(i, "air", agl=500.0) for i in range(300)]
    # the second landing is never sinking nor turned to the runway
    blunt = [(*r[:11], 90.0 if 81 <= r[1] < 521 else r[11], 0.0, 0.0) for r in flight("blunt")]
    got = {(r["ep"], r["window"]): r for r in of(spark, still + air + blunt)}
    s = got["still", 1]
    assert s["episode_id"] == "still" and (s["raw_row_start"], s["raw_row_end"], s["complete_idx"]) == (0, 59, 10) and s["gap_start_idx"] is None
    assert not got["air", 1]["eligible"] and got["air", 1]["exclusion_reason"] == "no_touchdown_found_in_window" and got["air", 1]["runway_id"] is None
    b = got["blunt", 2]
    assert b["manual_review_needed"] and b["full_approach_start_idx"] == b["gap_end_idx"] == b["baseline_core_start_idx"] and b["approach_maneuvering_detection"].endswith("REVIEW_NEEDED")
    assert circuit.circuit_episodes(spark.createDataFrame([], SCHEMA), ["ep"]).count() == 0


def test_the_end_goes_by_time_where_samples_are_uneven(spark):
    # 2 s below 5 kt, but in few samples
    data = [row(i, wheels="lrn", gs=30.0 if i < 30 else 2.0, agl=0.0) for i in range(30)]
    data += [(*row(30 + k, wheels="lrn", gs=2.0, agl=0.0)[:2], 3.0 + k * 0.7, *row(30 + k, wheels="lrn", gs=2.0, agl=0.0)[3:]) for k in range(4)]
    got = of(spark, data)[0]
    assert (got["complete_idx"], got["complete_reason"]) == (30, "groundspeed_below_threshold")
    rows = phases.circuit_rows(spark.createDataFrame(data[:-1], SCHEMA), ["ep"], LANDING).select("complete_idx", "complete_reason").distinct().collect()
    assert [tuple(r) for r in rows] == [(32, "end_of_recording_window")]


def test_one_exchange_serves_the_whole_chain(spark):
    plan = circuit.circuit_episodes(spark.createDataFrame(flight(), SCHEMA), ["ep"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
