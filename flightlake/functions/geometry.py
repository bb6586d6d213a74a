"""Runway-relative geometry as column expressions; runway constants fold into literals."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FT_PER_M = 1 / 0.3048
FPM_PER_FPS = 60.0
FPS_PER_KT = 1.6878
MPS_PER_KT = 0.5144


@dataclass(frozen=True)
class Runway:
    runway_id: str
    lat: float
    lon: float
    heading_deg: float
    elevation_ft: float
    glideslope_deg: float = 3.0
    target_kt: float = 65.0
    flare_agl_ft: float = 20.0


# The two runways.
RUNWAYS = {
    "02": Runway("02", 63.96447778, -22.60545278, 0.02, 135.0),
    "29": Runway("29", 63.98504419, -22.59238152, 269.965, 150.0),
}


def metres_per_degree(lat: float) -> tuple[float, float]:
    """Metres in a degree of latitude and of longitude (series of the WGS 84 ellipsoid)."""
    p = math.radians(lat)
    return 111132.92 - 559.82 * math.cos(2 * p) + 1.175 * math.cos(4 * p), 111412.84 * math.cos(p) - 93.5 * math.cos(3 * p)


def constants(r: Runway) -> dict[str, float]:
    """What the geometry needs of a runway, computed once."""
    per_lat, per_lon = metres_per_degree(r.lat)
    angle = math.radians(r.heading_deg)
    return {
        "lat": r.lat, "lon": r.lon, "per_lat": per_lat, "per_lon": per_lon, "sin": math.sin(angle), "cos": math.cos(angle), "heading": r.heading_deg,
        "elevation": r.elevation_ft, "glideslope": r.glideslope_deg, "target": r.target_kt, "flare": r.flare_agl_ft,
    }


def of_runway(runway: Runway | dict[str, Runway], runway_id: str = "runway_id") -> dict[str, Column]:
    """The constants of one runway as literals, or of each row's runway by its id (null for an id that is not among them)."""
    if isinstance(runway, Runway):
        return {k: F.lit(v) for k, v in constants(runway).items()}
    known = {i: constants(r) for i, r in runway.items()}
    return {k: F.coalesce(*[F.when(F.col(runway_id) == i, F.lit(c[k])) for i, c in known.items()]) for k in next(iter(known.values()))}


def along_cross(lat: Column, lon: Column, r: Runway | dict[str, Column]) -> tuple[Column, Column]:
    """Metres along the runway's heading past the threshold, and to the right of its line."""
    c = of_runway(r) if isinstance(r, Runway) else r
    north, east = (lat - c["lat"]) * c["per_lat"], (lon - c["lon"]) * c["per_lon"]
    return east * c["sin"] + north * c["cos"], east * c["cos"] - north * c["sin"]


def point_at(along: float, cross: float, r: Runway) -> tuple[float, float]:
    """(lat, lon) of a point given by its distances: the inverse of ``along_cross``."""
    per_lat, per_lon = metres_per_degree(r.lat)
    s, c = math.sin(math.radians(r.heading_deg)), math.cos(math.radians(r.heading_deg))
    return r.lat + (along * c - cross * s) / per_lat, r.lon + (along * s + cross * c) / per_lon


def heading_error(heading: Column, runway_heading: float | Column) -> Column:
    """Degrees in [-180, 180), by floor-mod."""
    to = runway_heading if isinstance(runway_heading, Column) else F.lit(runway_heading)
    return F.pmod(heading - to + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def runway_features(df: DataFrame, runway: Runway | dict[str, Runway], lat="lat_deg", lon="lon_deg", heading="heading_deg", msl="alt_msl_ft", airspeed="airspeed_kt", agl="alt_agl_ft") -> DataFrame:
    """Adds along and cross track, heading error with sine and cosine, height, glideslope and airspeed errors, and the flare flag.

    runway: one for all rows, or several by the column runway_id; rows of any other runway keep null features.
    """
    c = of_runway(runway)
    along, cross = along_cross(F.col(lat), F.col(lon), c)
    df = df.withColumns({"along_track_m": along, "cross_track_error_m": cross, "heading_error_deg": heading_error(F.col(heading), c["heading"])})
    df = df.withColumns(
        {
            "heading_error_sin": F.sin(F.radians("heading_error_deg")),
            "heading_error_cos": F.cos(F.radians("heading_error_deg")),
            "height_above_threshold_ft": F.col(msl) - c["elevation"],
            "airspeed_error_kt": F.col(airspeed) - c["target"],
            "flare_flag": (F.col(agl) <= c["flare"]).cast("int"),
        }
    )
    angle = F.degrees(F.atan2(F.col("height_above_threshold_ft") / F.lit(FT_PER_M), -F.col("along_track_m")))
    return df.withColumn("glideslope_error_deg", angle - c["glideslope"])
