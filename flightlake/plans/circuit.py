"""The segmenter of circuits over ``events``: a user is a recording, with landings on both sides of its longest airborne gap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import circuit, phases
from .telemetry import DAY, SLOW, TEL, indexed, landing_input, query, r6

GAP = {"least_s": 0.5 * DAY, "agl_ft": 10.0}
PREPARING = {"heading_deg": 120.0, "sink_fps": 2.0, "flaps_more": 0.2, "least_s": 0.3 * DAY}
ESTABLISHED = {"heading_deg": 120.0, "cross_m": 2500.0, "along_m": 500.0, "sink_fpm": 300.0, "least_s": 0.2 * DAY}

_ROWS = """x AS (SELECT user_id, idx, t, k::DOUBLE AS agl, value AS gs, value / 100.0 AS thr, k % 10 < 5 AS l, k % 10 BETWEEN 2 AND 6 AS r, k % 7 = 0 AS n, k * 5.0::DOUBLE AS hdg, (k - 50) / 4.0 AS vs, floor(k / 25) / 5.0 AS flaps,
  63.975::DOUBLE + (k - 50) / 5000.0::DOUBLE AS lat, -22.6::DOUBLE + (value - 50) / 2000.0::DOUBLE AS lon FROM tel)"""


def circuit_input(spark, d) -> DataFrame:
    """Rows of ``landing_input`` with a place, a heading and flaps from k and value."""
    k, v = F.col("k"), F.col("value")
    more = indexed(spark, d).select(
        "user_id", "event_id", (k * F.lit(5.0)).alias("heading_deg"), (F.floor(k / 25) / F.lit(5.0)).alias("flaps"),
        (F.lit(63.975) + (k - 50) / F.lit(5000.0)).alias("lat_deg"), (F.lit(-22.6) + (v - 50) / F.lit(2000.0)).alias("lon_deg"),
    )
    return landing_input(spark, d).join(more, ["user_id", "event_id"])


def _landing(rows: str, key: str) -> str:
    """CTEs cand, r0..r2, td, roll and done of the older segmenter: runs by time in ``rows``, which has ``key``."""
    flags = ("l AND r", "l OR r", "l OR r OR n")
    least = (SLOW["touchdown_s"], SLOW["touchdown_s"], SLOW["rollout_s"])
    runs = ", ".join(
        f"r{i} AS (SELECT {key}, min(idx) AS s, max(idx) AS e, arg_max(t, idx) AS te, max(t) - min(t) AS d FROM (SELECT z.*, idx - row_number() OVER (PARTITION BY z.{key} ORDER BY idx) AS g FROM {rows} z JOIN cand USING ({key}) WHERE idx >= ca AND ({flag})) GROUP BY {key}, g)"
        for i, flag in enumerate(flags)
    )
    return f"""cand AS (SELECT {key}, min(idx) AS ca FROM {rows} WHERE l OR r GROUP BY {key}), {runs},
{", ".join(f"a{i} AS (SELECT {key}, min(s) AS a FROM r{i} WHERE d >= {s} GROUP BY {key})" for i, s in enumerate(least))},
td AS (SELECT {key}, ca, a0.a AS x0, a1.a AS x1, a2.a AS x2, coalesce(a0.a, a1.a, a2.a) AS td,
  CASE WHEN a0.a IS NOT NULL THEN 'tier1_both_main_gear' WHEN a1.a IS NOT NULL THEN 'tier2_either_main_gear' WHEN a2.a IS NOT NULL THEN 'tier3_rollout_proxy_bouncy_landing' END AS tier
  FROM cand LEFT JOIN a0 USING ({key}) LEFT JOIN a1 USING ({key}) LEFT JOIN a2 USING ({key})),
roll AS (SELECT {key}, coalesce(min(s) FILTER (d >= {SLOW["rollout_s"]}), any_value(td)) AS ro FROM (SELECT {key}, td, min(idx) AS s, max(t) - min(t) AS d
  FROM (SELECT z.{key}, td, idx, t, idx - row_number() OVER (PARTITION BY z.{key} ORDER BY idx) AS g FROM {rows} z JOIN td USING ({key}) WHERE idx >= td AND (l OR r OR n)) GROUP BY {key}, td, g) GROUP BY {key}),
y AS (SELECT {key}, idx, t, agl, gs, thr, gs < {SLOW["complete_kt"]} AS slow, NOT (l OR r OR n) AS air, max(idx) OVER (PARTITION BY {key}) AS z FROM {rows} JOIN roll USING ({key}) WHERE idx >= ro),
walk AS (SELECT {key}, idx, z, CASE WHEN slow THEN 's' WHEN air THEN 'a' ELSE '' END AS m, idx AS f, t AS t0, gs AS g0, agl AS a0, t AS t1, gs AS g1, agl AS a1, thr AS h1, ''::VARCHAR AS why, NULL::BIGINT AS ended_at FROM y JOIN roll USING ({key}) WHERE idx = ro
  UNION ALL
  SELECT {key}, idx, z, CASE WHEN goes THEN m WHEN slow THEN 's' WHEN air THEN 'a' ELSE '' END, CASE WHEN goes THEN f ELSE idx END, CASE WHEN goes THEN t0 ELSE t END, CASE WHEN goes THEN g0 ELSE gs END, CASE WHEN goes THEN a0 ELSE agl END,
    t, gs, agl, thr, CASE WHEN goes THEN '' ELSE ended END, CASE WHEN NOT goes AND ended <> '' THEN f END
  FROM (SELECT walk.{key}, y.idx, y.z, m, f, t0, g0, a0, y.t, y.gs, y.agl, y.thr, slow, air, (m = 's' AND slow) OR (m = 'a' AND air) AS goes, {_ENDED} AS ended FROM walk JOIN y ON y.{key} = walk.{key} AND y.idx = walk.idx + 1 WHERE why = '')),
done AS (SELECT {key}, CASE WHEN why <> '' THEN ended_at WHEN ended <> '' THEN f ELSE z END AS done, CASE WHEN why <> '' THEN why WHEN ended <> '' THEN ended ELSE 'end_of_recording_window' END AS why
  FROM (SELECT *, {_ENDED} AS ended FROM walk QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY idx DESC) = 1))"""


_ENDED = f"CASE WHEN m = 's' AND t1 - t0 >= {SLOW['complete_s']} THEN 'groundspeed_below_threshold' WHEN m = 'a' AND t1 - t0 >= {SLOW['liftoff_s']} AND a1 > a0 AND (g1 > g0 + 2.0 OR h1 >= 0.6) THEN 'liftoff_after_rollout_touch_and_go' ELSE '' END"


@query(
    "circuit_segments",
    f"""WITH {TEL}, fl AS (SELECT *, k % 10 < 5 AS l, k % 10 BETWEEN 2 AND 6 AS r, k % 7 = 0 AS n FROM tel), ca AS (SELECT user_id, min(idx) AS ca FROM fl WHERE l OR r GROUP BY user_id),
f2 AS (SELECT * FROM fl JOIN ca USING (user_id) WHERE idx >= ca),
t1 AS (SELECT user_id, min(s) AS a FROM (SELECT user_id, min(idx) AS s, max(t) - min(t) AS d FROM (SELECT *, idx - row_number() OVER (PARTITION BY user_id ORDER BY idx) AS g FROM f2 WHERE l AND r) GROUP BY user_id, g) WHERE d >= {SLOW["touchdown_s"]} GROUP BY user_id),
t2 AS (SELECT user_id, min(s) AS a FROM (SELECT user_id, min(idx) AS s, max(t) - min(t) AS d FROM (SELECT *, idx - row_number() OVER (PARTITION BY user_id ORDER BY idx) AS g FROM f2 WHERE l OR r) GROUP BY user_id, g) WHERE d >= {SLOW["touchdown_s"]} GROUP BY user_id),
t3 AS (SELECT user_id, min(s) AS a FROM (SELECT user_id, min(idx) AS s, max(t) - min(t) AS d FROM (SELECT *, idx - row_number() OVER (PARTITION BY user_id ORDER BY idx) AS g FROM f2 WHERE l OR r OR n) GROUP BY user_id, g) WHERE d >= {SLOW["rollout_s"]} GROUP BY user_id),
p AS (SELECT ca.user_id, ca.ca, coalesce(t1.a, t2.a, t3.a) AS td, CASE WHEN t1.a IS NOT NULL THEN 'tier1_both_main_gear' WHEN t2.a IS NOT NULL THEN 'tier2_either_main_gear' WHEN t3.a IS NOT NULL THEN 'tier3_rollout_proxy_bouncy_landing' END AS tier FROM ca LEFT JOIN t1 USING (user_id) LEFT JOIN t2 USING (user_id) LEFT JOIN t3 USING (user_id)),
ro AS (SELECT user_id, min(s) AS a FROM (SELECT user_id, min(idx) AS s, max(t) - min(t) AS d FROM (SELECT fl.*, idx - row_number() OVER (PARTITION BY fl.user_id ORDER BY idx) AS g FROM fl JOIN p USING (user_id) WHERE idx >= td AND (l OR r OR n)) GROUP BY user_id, g) WHERE d >= {SLOW["rollout_s"]} GROUP BY user_id)
SELECT p.user_id, ca::BIGINT AS candidate_idx, td::BIGINT AS touchdown_idx, tier, coalesce(ro.a, td)::BIGINT AS rollout_idx FROM p LEFT JOIN ro USING (user_id)""",
)
def circuit_segments(spark, d):
    s = phases.circuit_landing(landing_input(spark, d), ["user_id"], SLOW)
    return s.select("user_id", F.col("candidate_idx").cast("long").alias("candidate_idx"), F.col("touchdown_idx").cast("long").alias("touchdown_idx"), "tier", F.col("rollout_idx").cast("long").alias("rollout_idx"))


@query(
    "circuit_events",
    f"""WITH RECURSIVE {TEL}, {_ROWS}, {_landing("x", "user_id")},
b AS ({" UNION ALL ".join(f"SELECT user_id, 'BOUNCE' AS event, e AS idx, '{name}' AS tier FROM r{i} JOIN td USING (user_id) WHERE d < {SLOW[least]} AND coalesce(e < x{i}, true)" + "".join(f" AND x{j} IS NULL" for j in range(i)) for i, ((_, least), name) in enumerate(zip(phases.TIERS, phases.TIER_NAMES)))}
 UNION ALL SELECT user_id, 'CONTACT_CANDIDATE', ca, NULL FROM td UNION ALL SELECT user_id, 'TOUCHDOWN_CONFIRMED', td, NULL FROM td WHERE td IS NOT NULL UNION ALL SELECT user_id, 'ROLLOUT', ro, NULL FROM roll UNION ALL SELECT user_id, 'COMPLETE', done, NULL FROM done)
SELECT b.user_id, event, b.idx::BIGINT AS idx, round(t, 6) AS t, tier FROM b JOIN tel USING (user_id, idx)""",
)
def circuit_events(spark, d):
    e = phases.circuit_events(phases.circuit_rows(landing_input(spark, d), ["user_id"], SLOW), ["user_id"])
    return e.select("user_id", "event", F.col("idx").cast("long").alias("idx"), r6("t").alias("t"), "tier")


_err = lambda h, to: f"abs(((({h} - {to} + 180) % 360) + 360) % 360 - 180)"
_C = {i: G.constants(r) for i, r in G.RUNWAYS.items()}
_of = lambda k: f"CASE rw WHEN '02' THEN {_C['02'][k]!r}::DOUBLE ELSE {_C['29'][k]!r}::DOUBLE END"
_ROW_NUMBERS = "idx - row_number() OVER (PARTITION BY user_id ORDER BY idx)"
INDEXES = ["raw_row_start", "raw_row_end", "n_samples_raw", "full_approach_start_idx", "baseline_core_start_idx", "flare_idx", "gap_start_idx", "gap_end_idx", "candidate_idx", "touchdown_idx", "rollout_idx", "complete_idx"]


@query(
    "circuit_episodes",
    f"""WITH RECURSIVE {TEL}, {_ROWS},
gap AS (SELECT user_id, s AS gs_, e AS ge FROM (SELECT user_id, min(idx) AS s, max(idx) AS e, max(t) - min(t) AS d FROM (SELECT *, {_ROW_NUMBERS} AS g FROM x WHERE NOT (l OR r) AND agl > {GAP["agl_ft"]}) GROUP BY user_id, g)
  WHERE d >= {GAP["least_s"]} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY d DESC, s) = 1),
v AS (SELECT * FROM (SELECT x.*, user_id * 2 + CASE WHEN ge IS NULL OR idx <= gs_ THEN 0 WHEN idx >= ge THEN 1 END AS uw FROM x LEFT JOIN gap USING (user_id)) WHERE uw IS NOT NULL),
{_landing("v", "uw")},
span AS (SELECT uw, any_value(user_id) AS user_id, uw % 2 + 1 AS w, min(idx) AS lo, max(idx) AS hi FROM v GROUP BY uw),
one AS (SELECT span.*, gs_, ge, ca, td, tier, ro, done, why, CASE WHEN td IS NOT NULL THEN CASE WHEN {_err("hdg", _C["02"]["heading"])} <= {_err("hdg", _C["29"]["heading"])} THEN '02' ELSE '29' END END AS rw
  FROM span LEFT JOIN gap USING (user_id) LEFT JOIN td USING (uw) LEFT JOIN roll USING (uw) LEFT JOIN done USING (uw) LEFT JOIN (SELECT uw, idx AS td, hdg FROM v) USING (uw, td)),
app AS (SELECT b.user_id, coalesce(a.done, 0) AS low, b.td AS high, b.rw, b.ca, b.ge FROM one b LEFT JOIN one a ON a.user_id = b.user_id AND a.w = 1 WHERE b.w = 2 AND b.td IS NOT NULL),
q AS (SELECT x.*, low, high, ge, ca, rw, {_of("flare")} AS flare_ft, abs(((hdg - {_of("heading")} + 180) % 360 + 360) % 360 - 180) AS err, (lat - {_of("lat")}) * {_of("per_lat")} AS north, (lon - {_of("lon")}) * {_of("per_lon")} AS east, (SELECT max(z.flaps) FROM x z WHERE z.user_id = x.user_id AND z.idx = low) AS f0 FROM x JOIN app USING (user_id) WHERE idx BETWEEN low AND high),
am AS (SELECT user_id, min(s) AS am FROM (SELECT user_id, min(idx) AS s, max(t) - min(t) AS d FROM (SELECT *, {_ROW_NUMBERS} AS g FROM q WHERE err <= {PREPARING["heading_deg"]} AND (vs < {PREPARING["sink_fps"]} OR flaps > f0 + {PREPARING["flaps_more"]})) GROUP BY user_id, g) WHERE d >= {PREPARING["least_s"]} GROUP BY user_id),
fa AS (SELECT user_id, min(s) AS fa FROM (SELECT user_id, min(idx) AS s, max(t) - min(t) AS d FROM (SELECT *, {_ROW_NUMBERS} AS g FROM q WHERE err <= {ESTABLISHED["heading_deg"]} AND abs(east * {_of("cos")} - north * {_of("sin")}) <= {ESTABLISHED["cross_m"]} AND east * {_of("sin")} + north * {_of("cos")} <= {ESTABLISHED["along_m"]} AND vs * 60 <= {ESTABLISHED["sink_fpm"]}) GROUP BY user_id, g) WHERE d >= {ESTABLISHED["least_s"]} GROUP BY user_id),
starts AS (SELECT app.user_id, am, fa, coalesce(am, app.ge) AS am2, coalesce(fa, am, app.ge) AS fa2 FROM app LEFT JOIN am USING (user_id) LEFT JOIN fa USING (user_id)),
flare AS (SELECT user_id, coalesce(min(idx) FILTER (idx >= fa2 AND agl <= flare_ft), any_value(ca)) AS fl FROM q JOIN starts USING (user_id) GROUP BY user_id),
e AS (SELECT one.*, am, fa, am2, fa2, fl, w = 2 AND td IS NOT NULL AS ap, CASE WHEN w = 2 AND td IS NOT NULL THEN least(am2, ge) ELSE lo END AS a, CASE WHEN ge IS NOT NULL AND td IS NOT NULL THEN done ELSE hi END AS z FROM one LEFT JOIN starts USING (user_id) LEFT JOIN flare USING (user_id))
SELECT e.user_id, w::INTEGER AS "window", CASE WHEN ge IS NOT NULL THEN e.user_id || '__landing-0' || w ELSE e.user_id::VARCHAR END AS episode_id, td IS NOT NULL AS eligible, CASE WHEN td IS NULL THEN 'no_touchdown_found_in_window' ELSE '' END AS exclusion_reason, rw AS runway_id,
  a::BIGINT AS raw_row_start, z::BIGINT AS raw_row_end, (z - a + 1)::BIGINT AS n_samples_raw, round(q2.t - q1.t, 6) AS duration_s_raw, (CASE WHEN ap THEN am2 ELSE a END)::BIGINT AS full_approach_start_idx, (CASE WHEN ap THEN fa2 ELSE a END)::BIGINT AS baseline_core_start_idx, (CASE WHEN ap THEN fl END)::BIGINT AS flare_idx,
  CASE WHEN ap THEN CASE WHEN am IS NOT NULL THEN 'auto_detected' ELSE 'not_detected_automatically_defaulted_to_end_of_airborne_gap_REVIEW_NEEDED' END END AS approach_maneuvering_detection,
  CASE WHEN ap THEN CASE WHEN fa IS NOT NULL THEN 'auto_detected' ELSE 'not_detected_automatically_defaulted_to_approach_maneuvering_start_REVIEW_NEEDED' END END AS final_approach_established_detection,
  NOT ap AND td IS NOT NULL AS has_known_initialization_transient, ap AND (am IS NULL OR fa IS NULL) AS manual_review_needed, gs_::BIGINT AS gap_start_idx, ge::BIGINT AS gap_end_idx, ca::BIGINT AS candidate_idx, td::BIGINT AS touchdown_idx, tier, ro::BIGINT AS rollout_idx, done::BIGINT AS complete_idx, why AS complete_reason
FROM e JOIN tel q1 ON q1.user_id = e.user_id AND q1.idx = a JOIN tel q2 ON q2.user_id = e.user_id AND q2.idx = z""",
)
def circuit_episodes(spark, d):
    """Windows, landings, runways and approaches of every user's recording, as episode rows."""
    got = circuit.circuit_episodes(circuit_input(spark, d), ["user_id"], G.RUNWAYS, GAP, SLOW, PREPARING, ESTABLISHED)
    return got.withColumns({c: F.col(c).cast("long") for c in INDEXES}).withColumn("duration_s_raw", r6("duration_s_raw"))
