"""The batch plan over ``events``: a user is a recording of 60 rows a second, validated, held on the grid, painted, and turned into features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..schema import CORE_PHASES, FULL_APPROACH_PHASES, LANDING, LATERAL_FEATURES, LONGITUDINAL_FEATURES, RECOVERY_PHASES
from . import batch
from .telemetry import _LABELS, TEL, indexed, landing_flags, landing_walk, query

#: Every signal of the plan from k and value of a row, as an expression that Spark and DuckDB read alike (literals with an exponent are doubles in both).
SIGNALS = {
    "lat_deg": "63.96e0 + k / 10000.0e0", "lon_deg": "-22.6e0 + value / 5000.0e0", "alt_msl_ft": "200.0e0 + value * 3.0e0", "alt_agl_ft": "k * 1.0e0 + 5.0e0", "heading_deg": "k * 3.6e0", "roll_deg": "(k - 50) / 10.0e0",
    "pitch_deg": "value / 20.0e0", "alpha_deg": "k / 29.0e0", "sideslip_rad": "value / 977.0e0", "roll_rate_degps": "k / 100.0e0", "pitch_rate_degps": "value / 100.0e0", "yaw_rate_degps": "(k - value) / 100.0e0",
    "airspeed_kt": "40.0e0 + value / 2.0e0", "vertical_speed_fps": "(k - 50) / 4.0e0", "vbody_fps": "k / 20.0e0", "groundspeed_kt": "value * 1.0e0", "aileron_cmd": "(k - 50) / 40.0e0", "elevator_cmd": "(value - 50) / 37.0e0",
    "rudder_cmd": "(k - value) / 59.0e0", "elevator_trim": "k / 400.0e0", "throttle0": "value / 77.0e0",
}
HELD = {"wow_nose": "CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END", "wow_left": "CASE WHEN k % 10 < 5 THEN 1 ELSE 0 END", "wow_right": "CASE WHEN k % 10 BETWEEN 2 AND 6 THEN 1 ELSE 0 END", "flaps_cmd": "floor(k / 25.0e0) / 5.0e0"}
#: Digits that doubles are rounded to: metres have fewer, as degrees times their length leave a rest of 1e-9.
DIGITS = {"along_track_m": 2, "cross_track_error_m": 2, "glideslope_error_deg": 3, "height_above_threshold_ft": 3}

_ORDER = list(SIGNALS)
_x = lambda name: f"f[{_ORDER.index(name) + 1}]"
_C = {i: G.constants(r) for i, r in G.RUNWAYS.items()}
_of = lambda k: f"(CASE runway_id WHEN '02' THEN {_C['02'][k]!r}::DOUBLE ELSE {_C['29'][k]!r}::DOUBLE END)"
_clipped = lambda name: f"greatest({batch.BOUNDS[name][0]}, least({batch.BOUNDS[name][1]}, {_x(name)}))"
_names = lambda phases: ", ".join(f"'{p}'" for p in phases)

#: Filtered from a steady start, held ten times a second, with the controls clipped.
_GRID = f"""{TEL},
cut AS (SELECT user_id, CASE WHEN user_id % 4 = 0 THEN 2 ELSE 0 END AS lo, CASE WHEN user_id % 4 = 1 THEN 50 ELSE max(idx) END AS hi, max(idx) AS z FROM tel GROUP BY user_id),
s AS (SELECT tel.user_id, idx, row_number() OVER (PARTITION BY tel.user_id ORDER BY idx) - 1 AS n, idx / 60.0::DOUBLE AS t, event_id, [{", ".join(f"({e})::DOUBLE" for e in SIGNALS.values())}] AS x, {", ".join(f"{e} AS {n}" for n, e in HELD.items())}
  FROM tel JOIN cut USING (user_id) WHERE idx BETWEEN least(lo, z) AND least(hi, z)),
rate AS (SELECT user_id, tan(pi() * least(4.0 / ((1 / med) / 2), 0.99) / 2) AS kk FROM (SELECT user_id, quantile_cont(d, 0.5) AS med FROM (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY n) AS d FROM s) GROUP BY user_id)),
co AS (SELECT user_id, kk * kk * m AS b0, 2 * kk * kk * m AS b1, kk * kk * m AS b2, 2 * (kk * kk - 1) * m AS a1, (1 - sqrt(2.0) * kk + kk * kk) * m AS a2 FROM (SELECT user_id, kk, 1 / (1 + sqrt(2.0) * kk + kk * kk) AS m FROM rate)),
fil AS (SELECT user_id, n, x AS first, list_transform(x, lambda v: 0.0::DOUBLE) AS x1, list_transform(x, lambda v: 0.0::DOUBLE) AS x2, list_transform(x, lambda v: 0.0::DOUBLE) AS y1, list_transform(x, lambda v: 0.0::DOUBLE) AS y2 FROM s WHERE n = 0
  UNION ALL SELECT s.user_id, s.n, first, list_transform(range(1, {len(_ORDER) + 1}), lambda i: s.x[i] - first[i]), x1, list_transform(range(1, {len(_ORDER) + 1}), lambda i: b0 * (s.x[i] - first[i]) + b1 * x1[i] + b2 * x2[i] - a1 * y1[i] - a2 * y2[i]), y1
  FROM fil JOIN s ON s.user_id = fil.user_id AND s.n = fil.n + 1 JOIN co ON co.user_id = fil.user_id),
smooth AS (SELECT s.* EXCLUDE (x), list_transform(range(1, {len(_ORDER) + 1}), lambda i: first[i] + y1[i]) AS f FROM fil JOIN s USING (user_id, n)),
span AS (SELECT user_id, min(t) AS t0, max(t) AS t1 FROM s GROUP BY user_id),
ticks AS (SELECT user_id, g, t0 + g * (1 / 10.0::DOUBLE) AS moment FROM span, LATERAL (SELECT unnest(range(0, floor((t1 - t0) / (1 / 10.0::DOUBLE))::BIGINT + 1)) AS g)),
grid AS (SELECT k.user_id, g, moment, m.* EXCLUDE (user_id, t, idx, n), CASE WHEN k.user_id % 2 = 0 THEN '02' ELSE '29' END AS runway_id FROM ticks k ASOF JOIN smooth m ON k.user_id = m.user_id AND k.moment >= m.t),
fl0 AS (SELECT user_id, coalesce(min(g) FILTER ({_x("alt_agl_ft")} <= 20), max(g)) AS fi FROM grid GROUP BY user_id)"""
#: Rows from the flare on, as the landing state machine's SQL takes them.
_FROM_FLARE = f"""{_GRID},
flare AS (SELECT fl0.user_id, moment AS flare_s FROM fl0 JOIN grid ON grid.user_id = fl0.user_id AND g = fi), low AS (SELECT grid.* EXCLUDE (moment), g AS idx, moment AS t, 0 AS k FROM grid JOIN fl0 USING (user_id) WHERE g >= fi)"""


def _sql() -> str:
    flags = landing_flags(_FROM_FLARE, LANDING, "wow_left = 1 AS l, wow_right = 1 AS r, wow_nose = 1 AS n").replace("AS d FROM tel)", "AS d FROM low)", 1)
    walk = landing_walk(flags, LANDING, f"f.{_x('alt_agl_ft')}", f"f.{_x('groundspeed_kt')}", f"greatest(0.0, least(1.0, f.{_x('throttle0')}))")
    rounded = lambda name, e: f"round({e}, {DIGITS.get(name, 4)})"
    plain = {n: _x(s) for n, s in {**{f: f for f in ("roll_deg", "sideslip_rad", "roll_rate_degps", "yaw_rate_degps", "airspeed_kt", "pitch_deg", "alpha_deg", "pitch_rate_degps", "vertical_speed_fps")}, "agl_ft": "alt_agl_ft", "lateral_body_speed_fps": "vbody_fps"}.items()}
    made = {
        "along_track_m": "along", "cross_track_error_m": "across", "heading_error_sin": "sin(radians(err))", "heading_error_cos": "cos(radians(err))", "glideslope_error_deg": "held", "height_above_threshold_ft": "high",
        "airspeed_error_kt": f"{_x('airspeed_kt')} - {_of('target')}", "flaps_state_norm": "flaps_cmd",
    }
    feature = lambda n: "flare_flag" if n == "flare_flag" else rounded(n, {**plain, **made}[n])
    columns = [f"{feature(n)} AS lat__{n}" for n in LATERAL_FEATURES] + [f"{feature(n)} AS lon__{n}" for n in LONGITUDINAL_FEATURES]
    labels = {"laty__aileron_command": _clipped("aileron_cmd"), "laty__rudder_command": _clipped("rudder_cmd"), "lony__elevator_effective": f"{_clipped('elevator_cmd')} + {_clipped('elevator_trim')}", "lony__throttle_command": _clipped("throttle0")}
    columns += [f"round({e}, 4) AS {n}" for n, e in labels.items()]
    return f"""{walk}, {_LABELS},
geo AS (SELECT *, east * {_of("sin")} + north * {_of("cos")} AS along, east * {_of("cos")} - north * {_of("sin")} AS across FROM (SELECT *, ({_x("lat_deg")} - {_of("lat")}) * {_of("per_lat")} AS north, ({_x("lon_deg")} - {_of("lon")}) * {_of("per_lon")} AS east,
  ((({_x("heading_deg")} - {_of("heading")} + 180) % 360) + 360) % 360 - 180 AS err, {_x("alt_msl_ft")} - {_of("elevation")} AS high, ({_x("alt_agl_ft")} <= {_of("flare")})::INTEGER AS flare_flag FROM grid)),
slope AS (SELECT *, degrees(atan2(high * 0.3048, -along)) - {_of("glideslope")} AS raw FROM geo),
held AS (SELECT *, coalesce(last_value(CASE WHEN -along >= 50 THEN raw END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY g ROWS UNBOUNDED PRECEDING), raw) AS held FROM slope),
starts AS (SELECT user_id, CASE WHEN user_id % 3 = 1 THEN t0 + 0.25 END AS tr, CASE WHEN user_id % 3 = 0 THEN t0 + 0.3 END AS am, CASE WHEN user_id % 3 = 0 THEN t0 + 0.6 END AS fa FROM span),
painted AS (SELECT held.*, tr, CASE WHEN lab.phase IS NOT NULL THEN lab.phase WHEN moment >= flare_s THEN 'FLARE' WHEN moment < tr THEN 'INITIALIZATION_TRANSIENT' WHEN moment < am THEN 'PRE_APPROACH_CIRCUIT' WHEN moment >= am AND moment < fa THEN 'APPROACH_MANEUVERING' ELSE 'FINAL_APPROACH_ESTABLISHED' END AS phase
  FROM held JOIN starts USING (user_id) JOIN flare USING (user_id) LEFT JOIN (SELECT user_id, idx AS g, phase FROM lab) lab USING (user_id, g))
SELECT 'ep-' || user_id AS episode_id, 's-' || user_id % 7 AS session_id, user_id::VARCHAR AS source_file, 'normal' AS scenario_id, runway_id, round(moment, 6) AS sim_time, g AS frame_10hz, phase, coalesce(moment < tr, false)::INTEGER AS initialization_transient,
  (phase IN ({_names(CORE_PHASES)}))::INTEGER AS baseline_core, (phase IN ({_names(FULL_APPROACH_PHASES)}))::INTEGER AS full_approach, (phase IN ({_names(RECOVERY_PHASES)}))::INTEGER AS recovery_ablation, {", ".join(columns)} FROM painted"""


def recordings(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(recordings, episodes, starts) made of ``events``."""
    e = indexed(spark, d)
    made = [F.expr(f"CAST({x} AS DOUBLE)").alias(n) for n, x in SIGNALS.items()] + [F.expr(x).cast("double").alias(n) for n, x in HELD.items()]
    rows = e.select(F.col("user_id").cast("string").alias("source_file"), F.col("event_id").alias("input_pos"), (F.col("idx") / F.lit(60.0)).alias("sim_time"), *made)
    u = F.col("user_id")
    users = e.groupBy("user_id").agg(F.max("idx").alias("z"))
    episodes = users.select(
        F.concat(F.lit("ep-"), u).alias("episode_id"), F.concat(F.lit("s-"), u % 7).alias("session_id"), u.cast("string").alias("source_file"), F.lit("normal").alias("scenario_id"),
        F.when(u % 2 == 0, "02").otherwise("29").alias("runway_id"), F.when(u % 4 == 0, F.lit(2).cast("long")).alias("raw_row_start"), F.when(u % 4 == 1, F.lit(50).cast("long")).alias("raw_row_end"),
    )
    t0 = F.when(u % 4 == 0, F.least(F.lit(2), "z") / F.lit(60.0)).otherwise(F.lit(0.0))
    starts = users.select(F.concat(F.lit("ep-"), u).alias("episode_id"), F.when(u % 3 == 1, t0 + 0.25).alias("transient_end_s"), F.when(u % 3 == 0, t0 + 0.3).alias("approach_maneuvering_s"), F.when(u % 3 == 0, t0 + 0.6).alias("final_approach_established_s"))
    return rows, episodes, starts


@query("feature_table", _sql())
def feature_table(spark, d):
    """Recordings to the feature table: slices with their meta columns, low-pass, grid, overlay of the landing, geometry of each row's runway, phases and labels."""
    rows, episodes, starts = recordings(spark, d)
    table = batch.table_of_features(batch.on_grid(batch.validated(rows, episodes), "steady"), starts)
    digits = lambda c: 6 if c == "sim_time" else DIGITS.get(c.split("__", 1)[-1], 4)
    return table.select(*[F.round(c, digits(c)).alias(c) if k == "double" else F.col(c).cast("long").alias(c) if c == "frame_10hz" else F.col(c) for c, k in table.dtypes])
