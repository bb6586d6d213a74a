"""The fixed feature and label columns of the two networks, and the episode report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import FPM_PER_FPS, Runway, runway_features
from ..schema import FINAL_APPROACH, LATERAL_FEATURES, LONGITUDINAL_FEATURES, MANEUVERING, TRANSIENT
from .ordered import hold_where, rolling_std
from .phases import paint, variant_masks
from .runs import first_run_by_time, islands, numbered, with_first_lasting

META = ["episode_id", "session_id", "source_file", "scenario_id", "runway_id", "sim_time"]
# Columns that only change their name.
RENAMED = {"agl_ft": "alt_agl_ft", "lateral_body_speed_fps": "vbody_fps", "flaps_state_norm": "flaps_cmd"}


def geometry(df: DataFrame, runways: dict[str, Runway], floor_m: float = 50.0, episode: str = "episode_id") -> DataFrame:
    """Runway features for the runway of each row, in one pass; the glideslope error is held inside ``floor_m`` of the threshold."""
    out = runway_features(df, runways)
    return hold_where(out, [episode], ["sim_time"], "glideslope_error_deg", -F.col("along_track_m") >= floor_m, "glideslope_error_deg")


def episode_bounds(grid: DataFrame, bounds: DataFrame, episode: str = "episode_id", time: str = "sim_time") -> DataFrame:
    """The landing's boundary times of every episode of ``grid``; one second past the end where there are none, so that nothing is painted."""
    end = grid.groupBy(episode).agg((F.max(time) + 1).alias("_end"))
    landing = [c for c in ("flare_s", "contact_candidate_s", "touchdown_confirmed_s", "rollout_s", "complete_s") if c in bounds.columns]
    joined = end.join(bounds, episode, "left")
    return joined.select(episode, *[F.coalesce(c, "_end").alias(c) if c in landing else F.col(c) for c in bounds.columns if c != episode])


def build(df: DataFrame, bounds: DataFrame, overlay: DataFrame, episode: str = "episode_id", frame: str = "frame_10hz") -> DataFrame:
    """Meta columns, phase, masks, and lat__/laty__/lon__/lony__ columns.

    bounds: one row per episode (flare_s, transient_end_s, approach_maneuvering_s, final_approach_established_s);
    overlay: (episode, frame, landing_phase) of the landing state machine.
    """
    d = df.join(bounds, episode, "left").join(overlay, [episode, frame], "left")
    t = F.col("sim_time")
    phase = paint(t, F.col("landing_phase"), F.col("flare_s"), F.col("transient_end_s"), F.col("approach_maneuvering_s"), F.col("final_approach_established_s"))
    d = d.withColumn("phase", phase)
    d = d.withColumns(variant_masks(F.col("phase"), t, F.col("transient_end_s")))
    source = lambda f: F.col(RENAMED.get(f, f))
    labels = {
        "laty__aileron_command": F.col("aileron_cmd"),
        "laty__rudder_command": F.col("rudder_cmd"),
        "lony__elevator_effective": F.col("elevator_cmd") + F.col("elevator_trim"),
        "lony__throttle_command": F.col("throttle0"),
    }
    return d.select(
        *META, frame, "phase", "initialization_transient", "baseline_core", "full_approach", "recovery_ablation",
        *[source(f).alias(f"lat__{f}") for f in LATERAL_FEATURES], *[source(f).alias(f"lon__{f}") for f in LONGITUDINAL_FEATURES],
        *[c.alias(n) for n, c in labels.items()],
    )


def dataset_summary(episodes: DataFrame, *tables: DataFrame, key: str = "episode_id") -> DataFrame:
    """One row per episode: left joins of whatever the stages produced for it."""
    for t in tables:
        episodes = episodes.join(t, key, "left")
    return episodes


def transients(df: DataFrame, keys: list[str], order: list[str], rate_hz: float, touchdown: str, cfg: dict = TRANSIENT) -> DataFrame:
    """One row per episode on the transient at its start: where settled flight begins, and what was before and after.

    df: keys, order (the time first), airspeed, flaps, along, agl and a column with the touchdown's time (null: none).
    Settled: airspeed in the band, flaps out and unchanged over the last second, before the threshold and with time left to the
    touchdown.  The first run of settled rows that lasts is taken; rows are searched up to the first one past ``search_s``
    seconds, or to the touchdown if that is earlier.
    """
    time = order[0]
    w, whole = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys)
    d = numbered(df.withColumn("t", F.col(time)), keys, *order)
    d = rolling_std(d, keys, order, "flaps", max(1, round(rate_hz)), "_sd")
    d = d.withColumns({"_t0": F.min("t").over(whole), "_td": F.coalesce(F.min(F.when(F.col("t") >= F.col(touchdown), F.col("t"))).over(whole), F.max("t").over(whole)), "_lag": F.lag("t").over(w)})
    ok = F.col("airspeed").between(*cfg["band_kt"]) & (F.col("flaps") > cfg["flaps_min"]) & (F.col("_sd") < cfg["flaps_std"]) & (F.col("along") < 0) & (F.col("_td") - F.col("t") >= cfg["remaining_s"])
    searched = F.col("_lag").isNull() | ((F.col("_lag") <= F.col("_t0") + cfg["search_s"]) & (F.col("_lag") < F.col("_td")))
    d = d.withColumn("_ok", F.coalesce(ok & searched, F.lit(False)))
    found = first_run_by_time(islands(d, keys, "t", F.col("_ok")), keys, cfg["least_s"]).select(*keys, F.col("start_t").alias("_end"), F.col("start_idx").alias("_at"))
    here = lambda c: F.max(F.when(F.col("idx") == F.col("_at"), F.col(c)))
    first = lambda c: F.min_by(c, "idx")
    got = d.join(found, keys, "left").groupBy(*keys).agg(
        F.coalesce(F.bool_or(F.col("_at").isNotNull()), F.lit(False)).alias("detected"),
        F.min("t").alias("t_start_s"), F.max("_end").alias("t_transient_end_s"), (F.max("_end") - F.min("t")).alias("duration_removed_s"),
        F.count_if(F.col("t") < F.col("_end")).alias("n_samples_removed_from_baseline_core"), F.count("*").alias("n_samples_total"),
        first("airspeed").alias("airspeed_kt_before"), here("airspeed").alias("airspeed_kt_after"), first("flaps").alias("flaps_before"), here("flaps").alias("flaps_after"),
        (-here("along")).alias("distance_to_threshold_m_at_end"), here("agl").alias("agl_ft_at_end"),
    )
    why = F.when(F.col("detected"), "auto_detected").otherwise("not_detected_within_max_search_window_keep_full_episode_REVIEW_NEEDED")
    return got.withColumn("reason", why)


def _established(cfg: dict):
    ok = (F.abs("heading_error_deg") <= cfg["heading_deg"]) & (F.abs("cross_track_error_m") <= cfg["cross_m"]) & (F.col("along_track_m") <= cfg["along_m"])
    return ok & (F.col("vertical_speed_fps") * FPM_PER_FPS <= cfg["sink_fpm"])


def _prepares(cfg: dict):
    return (F.abs("heading_error_deg") <= cfg["heading_deg"]) & ((F.col("vertical_speed_fps") < cfg["sink_fps"]) | (F.col("flaps") > F.col("_low.flaps") + cfg["flaps_more"]))


def _searched(df: DataFrame, keys: list[str], order: list[str], low: str, high: str, found: dict) -> DataFrame:
    """Rows with idx, t, _low (flaps and t of row ``low``), and for each name: (condition, seconds) where its first run begins that lasts among rows low..high."""
    d = numbered(df.withColumn("t", F.col(order[0])), keys, *order)
    d = d.withColumn("_low", F.max(F.when(F.col("idx") == F.col(low), F.struct("flaps", "t"))).over(Window.partitionBy(*keys)))
    inside = F.col("idx").between(F.col(low), F.col(high))
    d = d.withColumns({f"_ok_{n}": F.coalesce(inside & ok, F.lit(False)) for n, (ok, _) in found.items()})
    return with_first_lasting(d, keys, {n: (f"_ok_{n}", s) for n, (_, s) in found.items()})


def _one(d: DataFrame, keys: list[str], name: str) -> DataFrame:
    return d.where(F.col(name).isNotNull()).groupBy(*keys).agg(F.min(name).alias("x")).select(*keys, "x.idx", "x.t")


def final_approach(df: DataFrame, keys: list[str], order: list[str], low: str, high: str, cfg: dict = FINAL_APPROACH) -> DataFrame:
    """(keys, idx, t): where the final approach is established among the rows low..high (columns): aligned, near the line, before the threshold, descending.

    df: keys, order (the time first), heading_error_deg, cross_track_error_m, along_track_m, vertical_speed_fps, flaps.
    """
    return _one(_searched(df, keys, order, low, high, {"_fa": (_established(cfg), cfg["least_s"])}), keys, "_fa")


def approach_maneuvering(df: DataFrame, keys: list[str], order: list[str], low: str, high: str, cfg: dict = MANEUVERING) -> DataFrame:
    """(keys, idx, t): where the preparation of the approach begins: turned to the runway, and sinking or with more flaps than on row ``low``."""
    return _one(_searched(df, keys, order, low, high, {"_am": (_prepares(cfg), cfg["least_s"])}), keys, "_am")


def approach_starts(df: DataFrame, keys: list[str], order: list[str], low: str, high: str, preparing: dict = MANEUVERING, established: dict = FINAL_APPROACH) -> DataFrame:
    """(keys, approach_maneuvering_s, final_approach_established_s, ..._detection): both starts with the published fallbacks, in one pass.

    Without a detected preparation it begins on row ``low``; without a detected final approach that begins with the preparation.
    """
    d = _searched(df, keys, order, low, high, {"_am": (_prepares(preparing), preparing["least_s"]), "_fa": (_established(established), established["least_s"])})
    base = d.groupBy(*keys).agg(F.max("_low.t").alias("_low"), F.min("_am.t").alias("_am"), F.min("_fa.t").alias("_fa"))
    am = F.coalesce("_am", "_low")
    how = lambda c, other: F.when(F.col(c).isNotNull(), "auto_detected").otherwise(f"not_detected_automatically_defaulted_to_{other}_REVIEW_NEEDED")
    return base.select(
        *keys, am.alias("approach_maneuvering_s"), how("_am", "end_of_airborne_gap").alias("approach_maneuvering_detection"),
        F.coalesce(F.col("_fa"), am).alias("final_approach_established_s"), how("_fa", "approach_maneuvering_start").alias("final_approach_established_detection"),
    )
