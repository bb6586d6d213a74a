"""Checks that give the keys that break a rule: an empty result passes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import is_finite, steps
from ..schema import LANDING


class CheckFailed(ValueError):
    pass


def enforce(**checks: DataFrame) -> None:
    """Raises with the names of the checks that found something and one example each."""
    bad = {name: row.asDict() for name, df in checks.items() if (row := df.limit(1).first())}
    if bad:
        raise CheckFailed("; ".join(f"{k}: {v}" for k, v in bad.items()))


def not_rising(df: DataFrame, keys: list[str], position: list[str], time: str) -> DataFrame:
    """Keys whose times do not rise strictly."""
    w = Window.partitionBy(*keys).orderBy(*position)
    return df.withColumn("_d", F.col(time) - F.lag(time).over(w)).where("_d <= 0").select(*keys).distinct()


def not_uniform(df: DataFrame, keys: list[str], time: str, step: float, tolerance: float = 1e-6) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(time)
    return df.withColumn("_d", F.col(time) - F.lag(time).over(w)).where(F.abs(F.col("_d") - step) > tolerance).select(*keys).distinct()


def not_finite(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    bad = ~is_finite(F.col(columns[0]))
    for c in columns[1:]:
        bad = bad | ~is_finite(F.col(c))
    return df.where(bad).select(*keys).distinct()


def out_of_order(bounds: DataFrame, keys: list[str]) -> DataFrame:
    """Rollout before touchdown, or completion before rollout."""
    return bounds.where("rollout_s < touchdown_confirmed_s OR complete_s < rollout_s").select(*keys)


def unbacked_touchdown(rows: DataFrame, keys: list[str], cfg: dict = LANDING) -> DataFrame:
    """Touchdowns that the next N samples of both main wheels do not back."""
    need = steps(cfg["touchdown_s"], F.first("_dt"))
    span = F.count_if((F.col("idx") >= F.col("touchdown_idx")) & F.col("_both") & F.col("_lead"))
    w = Window.partitionBy(*keys).orderBy("idx")
    after = F.col("idx") >= F.col("touchdown_idx")
    broken = F.sum(F.when(after & ~F.col("_both"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = rows.where("touchdown_idx IS NOT NULL").withColumn("_lead", broken == 0)
    return d.groupBy(*keys).agg(span.alias("n"), need.alias("need")).where("n < need").select(*keys)


def nose_only_candidate(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.where((F.col("phase") == "CONTACT_CANDIDATE") & ~F.col("_main")).select(*keys).distinct()


def unflagged_long_contact(records: DataFrame, flags: DataFrame, keys: list[str], cfg: dict = LANDING) -> DataFrame:
    long = records.where((F.col("kind") == "unconfirmed_intermittent_contact") & (F.col("duration_s") >= cfg["long_candidate_s"]))
    return long.select(*keys).distinct().join(flags.where(F.col("flag").startswith("long_unconfirmed")).select(*keys), keys, "left_anti")


def bounce_without_rollout(rows: DataFrame, keys: list[str], flags: DataFrame) -> DataFrame:
    """Bounces after which no rollout came, unless the recording is flagged as cut short."""
    d = rows.groupBy(*keys).agg(F.max(F.when(F.col("phase") == "BOUNCE", F.col("idx"))).alias("b"), F.max("rollout_idx").alias("r")).where("b IS NOT NULL AND (r IS NULL OR r < b)")
    return d.select(*keys).join(flags.select(*keys).distinct(), keys, "left_anti")


def leaking_folds(folds: DataFrame) -> DataFrame:
    """Folds in which a session has two roles, or that do not have exactly one validating session."""
    per = folds.groupBy("fold_id", "session_id").agg(F.count_distinct("role").alias("roles"), F.max((F.col("role") == "val").cast("int")).alias("val"))
    return per.groupBy("fold_id").agg(F.max("roles").alias("m"), F.sum("val").alias("v")).where("m > 1 OR v <> 1").select("fold_id")


def gear_mapping(nose: int, mains: list[int]) -> None:
    """The wheels' numbers: two different main ones, neither of them the nose wheel's."""
    if nose in mains or len(set(mains)) != 2:
        raise CheckFailed(f"wheels: nose {nose}, main {mains}")


def startup_sample(spark, runway, scalers: dict[str, tuple[float, float]], flaps: float = 0.0) -> dict[str, float]:
    """The features of one made-up sample three kilometres out, scaled and clipped: all must be finite numbers."""
    from ..functions.geometry import runway_features
    from ..schema import LATERAL_FEATURES, LONGITUDINAL_FEATURES
    from .features import RENAMED

    sample = {
        "lat_deg": runway.lat - 0.03, "lon_deg": runway.lon, "heading_deg": runway.heading_deg, "alt_msl_ft": runway.elevation_ft + 800.0, "alt_agl_ft": 800.0, "airspeed_kt": 65.0, "roll_deg": 0.0,
        "pitch_deg": 3.0, "alpha_deg": 3.0, "sideslip_rad": 0.0, "roll_rate_degps": 0.0, "pitch_rate_degps": 0.0, "yaw_rate_degps": 0.0, "vertical_speed_fps": -10.0, "vbody_fps": 0.0, "flaps_cmd": float(flaps),
    }
    row = runway_features(spark.createDataFrame([tuple(sample.values())], list(sample)), runway).first().asDict()
    got = {}
    for f in dict.fromkeys(LATERAL_FEATURES + LONGITUDINAL_FEATURES):
        mean, std = scalers.get(f, (0.0, 1.0))
        z = (row[RENAMED.get(f, f)] - mean) / std
        if not math.isfinite(z):
            raise CheckFailed(f"{f} of the sample is {z}")
        got[f] = max(-5.0, min(5.0, z)) if f in scalers else z
    return got
