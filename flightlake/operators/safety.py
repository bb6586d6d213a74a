"""What ends a run: limits of the envelope, saturated channels, missing and broken telemetry; and the commands' last steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.guards import clip, is_finite, saturate
from .runs import running_count

# Limits of the envelope, in the order in which they are tested.
ENVELOPE = [
    ("cross_track_exceeded", "cross_track_m", "abs", 150.0),
    ("heading_error_exceeded", "heading_error_deg", "abs", 45.0),
    ("bank_angle_exceeded", "roll_deg", "abs", 45.0),
    ("pitch_angle_exceeded", "pitch_deg", "abs", 25.0),
    ("agl_exceeded", "alt_agl_ft", "above", 3000.0),
    ("airspeed_too_low", "airspeed_kt", "below", 40.0),
    ("airspeed_too_high", "airspeed_kt", "above", 120.0),
]
# Seconds until telemetry is stale, cycles until a saturated channel ends the run, the elevator's trim.
STALE_S, SATURATED_CYCLES, TRIM = 0.5, 30, 0.031


def outside(value, kind: str, limit: float):
    """Whether a value, a number or a column, is beyond a limit."""
    return abs(value) > limit if kind == "abs" else value > limit if kind == "above" else value < limit


def broken(columns: list[str]) -> Column:
    """Whether any of the columns is missing, NaN or infinite."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | ~F.coalesce(is_finite(F.col(c).cast("double")), F.lit(False))
    return bad


def envelope_reason(limits=ENVELOPE) -> Column:
    """The first limit of the envelope that a row exceeds, else null."""
    parts = [F.when(F.abs(c) > limit if kind == "abs" else outside(c, kind, limit), name) for name, column, kind, limit in limits for c in (F.col(column),)]
    return F.coalesce(*parts)


def abort_reasons(df: DataFrame, keys: list[str], order: list[str], channels: dict[str, tuple[float, float]], limits=ENVELOPE, cycles: int = SATURATED_CYCLES) -> DataFrame:
    """Adds abort_reason: why a row ends its run ("" if it does not).

    A row with a missing or non-finite value counts for nothing else; otherwise of saturation, envelope and crash the last
    one counts, of several saturated channels the last one, and inside the envelope the first limit.
    channels: column -> (low, high), saturated where the value is strictly outside; ``cycles`` rows in a row end the run.
    """
    reason = F.when(F.col("crashed"), "flightgear_reported_crashed") if "crashed" in df.columns else F.lit(None).cast("string")
    reason = F.coalesce(reason, envelope_reason(limits))
    for c, (low, high) in channels.items():
        df = running_count(df, keys, order, saturate(F.col(c), low, high)["saturated"], f"_n_{c}")
    for c in reversed(channels):
        reason = F.coalesce(reason, F.when(F.col(f"_n_{c}") >= cycles, f"{c}_saturated"))
    needed = [column for _, column, _, _ in limits]
    reason = F.when(broken(needed), "telemetry_contains_nan_or_inf").otherwise(reason)
    return df.withColumn("abort_reason", F.coalesce(reason, F.lit(""))).drop(*[f"_n_{c}" for c in channels])


def elevator_command(effective: Column, trim: float = TRIM) -> Column:
    """The elevator that together with the fixed trim gives the predicted effect, within the control's range."""
    return clip(effective - F.lit(trim), -1.0, 1.0)
