"""Approaches for tests and demonstrations, in closed form: constant speed down the glideslope, then the flare, then rolling out."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightlake.functions.geometry import FPS_PER_KT, MPS_PER_KT, RUNWAYS, Runway, metres_per_degree


def approaches(spark: SparkSession, runs: int = 1, hz: float = 10.0, seconds: float = 150.0, runway: Runway = RUNWAYS["02"], knots: float = 65.0, start_m: float = -3000.0, start_ft: float = 800.0) -> DataFrame:
    """Telemetry of ``runs`` landings at ``hz`` samples a second, by the fields of the protocol, and run_id."""
    agl0 = start_ft - runway.elevation_ft
    sink = knots * FPS_PER_KT * math.sin(math.radians(runway.glideslope_deg))
    flare_t = (agl0 - runway.flare_agl_ft) / sink
    ground_t = flare_t + runway.flare_agl_ft / 3.0
    slow = 4.0  # knots lost each second on the ground
    per_lat, per_lon = metres_per_degree(runway.lat)
    s, c = math.sin(math.radians(runway.heading_deg)), math.cos(math.radians(runway.heading_deg))
    d = spark.range(runs).select(F.format_string("run-%d", "id").alias("run_id")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(int(seconds * hz)))))
    t = F.col("k") / F.lit(hz)
    on_ground = F.greatest(F.lit(0.0), t - ground_t)
    rolling = F.least(on_ground, F.lit(knots / slow))
    agl = F.when(t < flare_t, agl0 - sink * t).otherwise(F.greatest(F.lit(0.0), runway.flare_agl_ft - 3.0 * (t - flare_t)))
    gs = F.greatest(F.lit(0.0), knots - slow * on_ground)
    along = start_m + MPS_PER_KT * (knots * F.least(t, F.lit(ground_t)) + knots * rolling - slow / 2 * rolling * rolling)
    wheels = (t > ground_t + 0.05).cast("int")
    zero = F.lit(0.0)
    fields = {
        "sim_time": t, "lat_deg": runway.lat + along * c / per_lat, "lon_deg": runway.lon + along * s / per_lon, "alt_msl_ft": agl + runway.elevation_ft, "alt_agl_ft": agl,
        "heading_deg": F.lit(runway.heading_deg), "roll_deg": zero, "pitch_deg": F.lit(3.0), "alpha_deg": F.lit(4.0), "sideslip_rad": zero, "roll_rate_degps": zero,
        "pitch_rate_degps": zero, "yaw_rate_degps": zero, "airspeed_kt": gs, "vertical_speed_fps": F.when(t < flare_t, -sink).when(agl > 0, -3.0).otherwise(0.0), "vbody_fps": zero,
        "groundspeed_kt": gs, "aileron_pos": zero, "elevator_pos": zero, "rudder_pos": zero, "elevator_trim_pos": F.lit(0.031), "flaps_pos": F.lit(0.99), "throttle_pos": F.lit(0.5),
        "gear_wow_nose": F.lit(0), "gear_wow_left": wheels, "gear_wow_right": wheels, "gear_compression_nose": zero, "gear_compression_left": wheels * 0.3, "gear_compression_right": wheels * 0.3,
        "wind_speed_kt": zero, "wind_from_heading_deg": zero, "crashed": F.lit(0), "frozen": F.lit(0),
    }
    return d.select("run_id", *[v.alias(n) for n, v in fields.items()])
