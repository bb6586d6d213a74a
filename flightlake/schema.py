"""Columns, roles, feature orders and thresholds of telemetry recordings."""

from __future__ import annotations

from pyspark.sql import types as T

# Property paths of the required columns and our names for them.
PROPERTY_PATHS = {
    "frame": "frame",
    "sim_time": "sim_time",
    "lon_deg": "/position[0]/longitude-deg[0]",
    "lat_deg": "/position[0]/latitude-deg[0]",
    "alt_msl_ft": "/position[0]/altitude-ft[0]",
    "alt_agl_ft": "/position[0]/altitude-agl-ft[0]",
    "heading_deg": "/orientation[0]/heading-deg[0]",
    "roll_deg": "/orientation[0]/roll-deg[0]",
    "pitch_deg": "/orientation[0]/pitch-deg[0]",
    "alpha_deg": "/orientation[0]/alpha-deg[0]",
    "sideslip_rad": "/orientation[0]/side-slip-rad[0]",
    "roll_rate_degps": "/orientation[0]/roll-rate-degps[0]",
    "pitch_rate_degps": "/orientation[0]/pitch-rate-degps[0]",
    "yaw_rate_degps": "/orientation[0]/yaw-rate-degps[0]",
    "airspeed_kt": "/velocities[0]/airspeed-kt[0]",
    "vertical_speed_fps": "/velocities[0]/vertical-speed-fps[0]",
    "vbody_fps": "/velocities[0]/vBody-fps[0]",
    "groundspeed_kt": "/velocities[0]/groundspeed-kt[0]",
    "aileron_cmd": "/controls[0]/flight[0]/aileron[0]",
    "elevator_cmd": "/controls[0]/flight[0]/elevator[0]",
    "rudder_cmd": "/controls[0]/flight[0]/rudder[0]",
    "elevator_trim": "/controls[0]/flight[0]/elevator-trim[0]",
    "flaps_cmd": "/controls[0]/flight[0]/flaps[0]",
    "throttle0": "/controls[0]/engines[0]/engine[0]/throttle[0]",
    **{f"wow_{g}": f"/gear[0]/gear[{i}]/wow[0]" for i, g in enumerate(("nose", "left", "right"))},
    **{f"compression_{g}": f"/gear[0]/gear[{i}]/compression-norm[0]" for i, g in enumerate(("nose", "left", "right"))},
    **{f"rollspeed_{g}": f"/gear[0]/gear[{i}]/rollspeed-ms[0]" for i, g in enumerate(("nose", "left", "right"))},
}
REQUIRED = list(PROPERTY_PATHS)

RECORDING = T.StructType([T.StructField(c, T.LongType() if c == "frame" else T.DoubleType()) for c in REQUIRED])

# Further columns that have a role of their own.
METADATA = {"frame", "sim_time"}
LABELS = {PROPERTY_PATHS[c] for c in ("aileron_cmd", "elevator_cmd", "rudder_cmd", "throttle0")}
DERIVED_SOURCES = {PROPERTY_PATHS[c] for c in ("elevator_trim", "lat_deg", "lon_deg")}
FLIGHT_MANAGER = {v for k, v in PROPERTY_PATHS.items() if k.startswith(("wow_", "compression_", "rollspeed_"))} | {
    PROPERTY_PATHS["groundspeed_kt"],
    "/controls[0]/gear[0]/gear-down[0]",
}
QA_ONLY = {
    "/environment[0]/wind-speed-kt[0]",
    "/environment[0]/wind-from-heading-deg[0]",
    "/environment[0]/turbulence[0]/magnitude-norm[0]",
    "/position[0]/ground-elev-m[0]",
    "/controls[0]/flight[0]/aileron-trim[0]",
    "/controls[0]/flight[0]/rudder-trim[0]",
    "/sim[0]/model[0]/c172p[0]/cockpit[0]/yoke-aileron[0]",
    "/sim[0]/model[0]/c172p[0]/cockpit[0]/yoke-elevator[0]",
    "/sim[0]/model[0]/c172p[0]/cockpit[0]/pedals-rudder[0]",
    "/sim[0]/model[0]/c172p[0]/cockpit[0]/flaps-lever[0]",
    "/surface-positions[0]/elevator-pos-norm[0]",
    "/surface-positions[0]/flap-pos-norm[0]",
    "/surface-positions[0]/left-aileron-pos-norm[0]",
    "/surface-positions[0]/right-aileron-pos-norm[0]",
    "/surface-positions[0]/rudder-pos-norm[0]",
    "/instrumentation[0]/slip-skid-ball[0]/indicated-slip-skid[0]",
    "/fdm[0]/jsbsim[0]/velocities[0]/vias-kts[0]",
    "/velocities[0]/speed-down-fps[0]",
    "/position[0]/altitude-agl-m[0]",
    "/controls[0]/engines[0]/engine[1]/throttle[0]",
    "/environment[0]/temperature-degc[0]",
    "/environment[0]/pressure-sea-level-inhg[0]",
    "/environment[0]/magnetic-variation-deg[0]",
    "/environment[0]/visibility-m[0]",
}
NEURAL_INPUTS = {
    PROPERTY_PATHS[c]
    for c in (
        "alt_msl_ft", "alt_agl_ft", "heading_deg", "roll_deg", "pitch_deg", "alpha_deg", "sideslip_rad", "roll_rate_degps",
        "pitch_rate_degps", "yaw_rate_degps", "airspeed_kt", "vertical_speed_fps", "vbody_fps", "flaps_cmd",
    )
}
ROLES = [
    ("metadata", METADATA),
    ("label", LABELS),
    ("derived_feature_source", DERIVED_SOURCES),
    ("flight_manager_only", FLIGHT_MANAGER),
    ("qa_only", QA_ONLY),
    ("neural_input", NEURAL_INPUTS),
]
#: Roles whose columns are carried on to the regular grid.
KEPT_ROLES = ["metadata", "label", "derived_feature_source", "flight_manager_only", "qa_only", "neural_input"]

# Families of columns that never feed a model, by a part of their name.
FORBIDDEN_PARTS = [
    "surface-positions", "yoke", "pedals", "flaps-lever", "brake", "steering-norm", "wow[0]", "compression-norm",
    "rollspeed-ms", "lighting", "door-positions", "circuit-breakers", "damage", "serviceable", "crash", "electrical",
    "fuel", "rpm", "egt", "oil-", "manifold", "mp-osi", "battery", "vacuum", "static", "pitot", "autopilot", "nav[",
    "adf", "magneto", "starter", "switches", "anti-ice", "hazards", "cabin", "fog", "frost", "icing", "alarms", "faults",
    "kill-engine", "killed", "cranking", "coughing", "exhaust", "instrumentation",
]

# Units by a part of the name, first match wins; the third entry must not occur.
UNIT_PARTS = [
    ("-deg[0]", "deg", None),
    ("-degps[0]", "deg/s", None),
    ("-rad[0]", "rad", None),
    ("-ft[0]", "ft", None),
    ("-m[0]", "m", "gear"),
    ("-kt[0]", "kt", None),
    ("-fps[0]", "ft/s", None),
    ("fps_sec", "ft/s", None),
    ("-ms[0]", "m/s", None),
    ("norm[0]", "norm[0..1 or -1..1]", None),
]

# Bounds of the normalised controls.
CONTROL_RANGES = {
    "/controls[0]/flight[0]/aileron[0]": (-1.0, 1.0),
    "/controls[0]/flight[0]/elevator[0]": (-1.0, 1.0),
    "/controls[0]/flight[0]/rudder[0]": (-1.0, 1.0),
    "/controls[0]/flight[0]/aileron-trim[0]": (-1.0, 1.0),
    "/controls[0]/flight[0]/rudder-trim[0]": (-1.0, 1.0),
    "/controls[0]/flight[0]/elevator-trim[0]": (-1.0, 1.0),
    "/controls[0]/flight[0]/flaps[0]": (0.0, 1.0),
    "/controls[0]/engines[0]/engine[0]/throttle[0]": (0.0, 1.0),
    "/controls[0]/engines[0]/engine[1]/throttle[0]": (0.0, 1.0),
    "/controls[0]/flight[0]/speedbrake[0]": (0.0, 1.0),
    "/controls[0]/flight[0]/spoilers[0]": (0.0, 1.0),
}

# Order of the model's inputs and labels.
LATERAL_FEATURES = [
    "along_track_m", "cross_track_error_m", "heading_error_sin", "heading_error_cos", "agl_ft", "roll_deg", "sideslip_rad",
    "roll_rate_degps", "yaw_rate_degps", "airspeed_kt", "lateral_body_speed_fps",
]
LATERAL_LABELS = ["aileron_command", "rudder_command"]
LONGITUDINAL_FEATURES = [
    "along_track_m", "glideslope_error_deg", "height_above_threshold_ft", "agl_ft", "pitch_deg", "alpha_deg", "pitch_rate_degps",
    "airspeed_kt", "airspeed_error_kt", "vertical_speed_fps", "flaps_state_norm", "flare_flag",
]
LONGITUDINAL_LABELS = ["elevator_effective", "throttle_command"]
#: Inputs that scalers leave as they are.
PASS_THROUGH = ["heading_error_sin", "heading_error_cos", "flaps_state_norm", "flare_flag"]
SCALED = [c for c in dict.fromkeys(LATERAL_FEATURES + LONGITUDINAL_FEATURES) if c not in PASS_THROUGH]

CORE_PHASES = ["FINAL_APPROACH_ESTABLISHED", "FLARE", "CONTACT_CANDIDATE"]
FULL_APPROACH_PHASES = [*CORE_PHASES, "APPROACH_MANEUVERING"]
RECOVERY_PHASES = [*CORE_PHASES, "INITIALIZATION_TRANSIENT"]

# Seconds and limits of the landing phases.
LANDING = {
    "touchdown_s": 0.3, "rollout_s": 0.8, "complete_kt": 5.0, "complete_s": 2.0, "liftoff_s": 1.0, "long_candidate_s": 2.0,
    "liftoff_gain_kt": 2.0, "liftoff_throttle": 0.6,
}

# Limits of the transient at the start, and of the detectors of the approach.
TRANSIENT = {"band_kt": (55.0, 75.0), "flaps_min": 0.05, "flaps_std": 0.01, "least_s": 2.0, "remaining_s": 5.0, "search_s": 30.0}
FINAL_APPROACH = {"heading_deg": 30.0, "cross_m": 150.0, "along_m": -200.0, "sink_fpm": -100.0, "least_s": 3.0}
MANEUVERING = {"heading_deg": 90.0, "sink_fps": -0.5, "flaps_more": 0.02, "least_s": 2.0}
AIRBORNE_GAP = {"least_s": 20.0, "agl_ft": 50.0}


def column_name(path: str) -> str:
    """A column name without the signs that need quoting; known paths have short names."""
    import re

    known = {v: k for k, v in PROPERTY_PATHS.items()}
    return known.get(path) or re.sub(r"[^A-Za-z0-9]+", "_", path.replace("[0]", "")).strip("_").lower()
