"""The batch pipeline as one plan: recordings to validated episodes, a regular grid, phases, features, splits and scalers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import RUNWAYS
from ..operators import features, ordered, phases, resample, runs, splits
from ..schema import SCALED

RATE_HZ, CUTOFF_HZ = 10.0, 4.0
HELD = ["wow_nose", "wow_left", "wow_right", "flaps_cmd"]
SMOOTHED = [
    "lat_deg", "lon_deg", "alt_msl_ft", "alt_agl_ft", "heading_deg", "roll_deg", "pitch_deg", "alpha_deg", "sideslip_rad", "roll_rate_degps", "pitch_rate_degps", "yaw_rate_degps",
    "airspeed_kt", "vertical_speed_fps", "vbody_fps", "groundspeed_kt", "aileron_cmd", "elevator_cmd", "rudder_cmd", "elevator_trim", "throttle0",
]
BOUNDS = {"aileron_cmd": (-1.0, 1.0), "elevator_cmd": (-1.0, 1.0), "rudder_cmd": (-1.0, 1.0), "elevator_trim": (-1.0, 1.0), "throttle0": (0.0, 1.0)}
# Protocol fields by the names of recordings.
FROM_PROTOCOL = {
    "aileron_pos": "aileron_cmd", "elevator_pos": "elevator_cmd", "rudder_pos": "rudder_cmd", "elevator_trim_pos": "elevator_trim", "flaps_pos": "flaps_cmd", "throttle_pos": "throttle0",
    "gear_wow_nose": "wow_nose", "gear_wow_left": "wow_left", "gear_wow_right": "wow_right",
}


def validated(recordings: DataFrame, episodes: DataFrame) -> DataFrame:
    """Rows of every episode (episode_id, session_id, source_file, scenario_id, runway_id, raw_row_start, raw_row_end) from recordings (source_file, input_pos, sim_time, ...).

    Rows are ordered by time with the place in the file as tie-break, the first of equal times is kept, and the slice is taken after that.
    An episode without a first or last row begins or ends with its recording.
    """
    one = ordered.first_of_time(recordings, ["source_file"], "sim_time", "input_pos")
    joined = one.join(episodes, "source_file")
    first, last = F.coalesce("raw_row_start", F.lit(0)), F.coalesce("raw_row_end", F.lit((1 << 62)))
    sliced = ordered.row_slice(joined, ["episode_id"], ["sim_time"], first, last)
    return sliced.drop("raw_row_start", "raw_row_end")


def on_grid(rows: DataFrame, init: str = "zero", angle: str = "plain") -> DataFrame:
    """Ten rows a second: continuous columns low-passed, wheels and flaps held, controls clipped.

    init: the filter's start, "zero" as published or "steady".  angle: headings are filtered like any number with "plain", as published, or
    as unit vectors with "sincos".
    """
    order = [c for c in ("sim_time", "input_pos") if c in rows.columns]
    out = resample.to_rate(rows, ["episode_id"], order, SMOOTHED, CUTOFF_HZ, 1 / RATE_HZ, BOUNDS, init, ["heading_deg"] if angle == "sincos" else None)
    return out.withColumn("sim_time", F.col("t_grid")).withColumnRenamed("grid_idx", "frame_10hz").drop("t_grid")


def landing_overlay(grid: DataFrame, flare_agl_ft: float = 20.0, post_rollout_gap: str = "flare") -> tuple[DataFrame, DataFrame]:
    """(overlay, bounds): landing phase by episode and frame, and one row of boundary times per episode."""
    g = grid.select("episode_id", F.col("frame_10hz").alias("idx"), F.col("sim_time").alias("t"), F.col("alt_agl_ft").alias("agl"), F.col("groundspeed_kt").alias("gs"), F.col("throttle0").alias("thr"), F.col("wow_left").alias("left"), F.col("wow_right").alias("right"), F.col("wow_nose").alias("nose"))
    flare = ordered.first_crossing(g, ["episode_id"], "idx", F.col("agl") <= flare_agl_ft, "t").select("episode_id", F.col("idx").alias("_f"), F.col("t").alias("flare_s"))
    rows = phases.landing_rows(g.join(flare, "episode_id").where(F.col("idx") >= F.col("_f")).drop("_f"), ["episode_id"], post_rollout_gap)
    bounds = phases.boundaries(rows, ["episode_id"]).drop("t_start_s", "t_end_s").join(flare.drop("_f"), "episode_id", "right")
    return rows.select("episode_id", F.col("idx").alias("frame_10hz"), F.col("phase").alias("landing_phase")), bounds


def features_of(samples: DataFrame, post_rollout_gap: str = "flare") -> DataFrame:
    """Protocol samples (run_id, ...) to the feature table, each run as one episode on runway 02."""
    d = samples.withColumnsRenamed(FROM_PROTOCOL).withColumn("episode_id", F.col("run_id"))
    d = d.withColumns({"session_id": F.col("run_id"), "source_file": F.col("run_id"), "scenario_id": F.lit("normal"), "runway_id": F.lit("02")}).drop("run_id")
    return table_of_features(on_grid(d), post_rollout_gap=post_rollout_gap)


def table_of_features(grid: DataFrame, starts: DataFrame | None = None, post_rollout_gap: str = "flare") -> DataFrame:
    """The feature table of rows on the grid; starts: (episode_id, transient_end_s, approach_maneuvering_s, final_approach_established_s)."""
    overlay, bounds = landing_overlay(grid, post_rollout_gap=post_rollout_gap)
    bounds = features.episode_bounds(grid, bounds.select("episode_id", "flare_s"))
    if starts is not None:
        bounds = bounds.join(starts, "episode_id", "left")
    missing = [c for c in ("transient_end_s", "approach_maneuvering_s", "final_approach_established_s") if c not in bounds.columns]
    bounds = bounds.withColumns({c: F.lit(None).cast("double") for c in missing}) if missing else bounds
    return features.build(features.geometry(grid, RUNWAYS), bounds, overlay)


def scaled_splits(table: DataFrame, mask: str = "baseline_core") -> DataFrame:
    """Rows of every fold and role with z-scores from that fold's training rows only."""
    rows = table.where(F.col(mask) == 1)
    folds = splits.loso_folds(table.select("session_id").distinct())
    rows = splits.split_rows(rows, folds)
    names = {v: next(p + v for p in ("lat__", "lon__") if p + v in table.columns) for v in SCALED}
    cols = [c for c in table.columns if c.split("__", 1)[-1] in SCALED and c.startswith(("lat__", "lon__"))]
    fitted = splits.fit_scalers(rows.where("role = 'train'"), ["fold_id"], list(names.values()))
    both = fitted.select("fold_id", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(names[c.split("__", 1)[1]]).alias("from")) for c in cols])).alias("x"), "variable", "mean", "std")
    per_column = both.where("x.from = variable").select("fold_id", F.col("x.c").alias("variable"), "mean", "std")
    return splits.apply_scalers(rows, per_column, ["fold_id"], cols)
