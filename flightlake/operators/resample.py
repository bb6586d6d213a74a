"""Causal low-pass filter and backward as-of hold on a regular grid.

The filter is a second-order Butterworth low-pass with zero initial state.  Its poles lie at 0.74
for 4 Hz at 60 Hz, so 121 terms of the impulse response are exact to double precision there; ``lowpass``
computes the response to as many terms as its argument asks for and convolves in a window.
"""

from __future__ import annotations

import cmath
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .carry import carried, schema_with

TAPS = 121
HIGHEST = 0.99  # of half the sampling rate


def butterworth2(cutoff_hz: float, fs_hz: float) -> tuple[tuple[float, float, float], tuple[float, float]]:
    """(b0, b1, b2), (a1, a2) of the bilinear second-order low-pass."""
    k = math.tan(math.pi * min(cutoff_hz / (fs_hz / 2), HIGHEST) / 2)
    n = 1 / (1 + math.sqrt(2) * k + k * k)
    return (k * k * n, 2 * k * k * n, k * k * n), (2 * (k * k - 1) * n, (1 - math.sqrt(2) * k + k * k) * n)


def group_delay_ms(cutoff_hz: float, fs_hz: float) -> float:
    """Delay of the filter at the cutoff frequency."""
    b, a = butterworth2(cutoff_hz, fs_hz)
    z = cmath.exp(-2j * math.pi * cutoff_hz / fs_hz)

    def slope(c):  # of the phase of a polynomial in z
        return (sum(i * x * z**i for i, x in enumerate(c)) / sum(x * z**i for i, x in enumerate(c))).real

    return (slope(b) - slope((1.0, *a))) / fs_hz * 1000


def coefficients(fs: Column, cutoff_hz: float) -> Column:
    """struct(b0, b1, b2, a1, a2) for a sampling rate that varies by episode."""
    k = F.tan(F.lit(math.pi) * F.least(F.lit(cutoff_hz) / (fs / 2), F.lit(HIGHEST)) / 2)
    n = 1 / (1 + F.lit(math.sqrt(2)) * k + k * k)
    return F.struct(
        (k * k * n).alias("b0"), (2 * k * k * n).alias("b1"), (k * k * n).alias("b2"),
        (2 * (k * k - 1) * n).alias("a1"), ((1 - F.lit(math.sqrt(2)) * k + k * k) * n).alias("a2"),
    )


def impulse_values(cutoff_hz: float, fs_hz: float, taps: int = TAPS) -> list[float]:
    """The first ``taps`` values of the filter's answer to a single 1."""
    b, a = butterworth2(cutoff_hz, fs_hz)
    out, y1, y2 = [], 0.0, 0.0
    for x in (*b, *[0.0] * max(0, taps - 3)):
        out.append(x - a[0] * y1 - a[1] * y2)
        y1, y2 = out[-1], y1
    return out[:taps]


def impulse_response(c: Column, taps: int = TAPS) -> Column:
    """The same as an array, for coefficients that are columns: the answer's closed form from the poles' modulus and angle.

    With d = -a1 / 2, r = sqrt(a2) and angle w = acos(d / r), a pole pair answers s(n) = r^n sin((n + 1) w) / sin(w), and
    the filter answers b0 s(n) + b1 s(n - 1) + b2 s(n - 2).  The poles of this filter are always a complex pair.
    """
    r = F.sqrt(c["a2"])
    w = F.acos(-c["a1"] / 2 / r)
    s = lambda n: F.when(n < 0, F.lit(0.0)).otherwise(F.pow(r, n) * F.sin((n + 1) * w) / F.sin(w))
    return F.transform(F.sequence(F.lit(0), F.lit(taps - 1)), lambda n: c["b0"] * s(n) + c["b1"] * s(n - 1) + c["b2"] * s(n - 2))


def episode_rate(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, fs): one over the exact median step; the first column of ``order`` is the time."""
    time = order[0]
    w = Window.partitionBy(*keys).orderBy(*order)
    dt = df.withColumn("_dt", F.col(time) - F.lag(time).over(w)).groupBy(*keys)
    return dt.agg((1 / F.nullif(F.percentile("_dt", F.lit(0.5)), F.lit(0.0))).alias("fs"))


def as_unit_vectors(df: DataFrame, angles: list[str]) -> tuple[DataFrame, list[str]]:
    """Adds the sine and cosine of every column of ``angles``, which are degrees, and names them."""
    parts = {f"_{f}_{c}": getattr(F, f)(F.radians(c)) for c in angles for f in ("sin", "cos")}
    return df.withColumns(parts) if parts else df, list(parts)


def as_degrees(df: DataFrame, angles: list[str]) -> DataFrame:
    """Replaces every column of ``angles`` by the direction, from 0 to below 360, of its sine and cosine; both gone: 0."""
    turned = {c: F.pmod(F.degrees(F.atan2(f"_sin_{c}", f"_cos_{c}")), F.lit(360.0)) for c in angles}
    # a direction a hair below 0 is 360 after the addition
    turned = {c: F.when(x >= 360.0, F.lit(0.0)).otherwise(x) for c, x in turned.items()}
    return df.withColumns(turned).drop(*[f"_{f}_{c}" for c in angles for f in ("sin", "cos")]) if angles else df


def lowpass(df: DataFrame, keys: list[str], order: list[str], columns: list[str], cutoff_hz: float, taps: int = TAPS, init: str = "zero", fs: float | None = None, angles: list[str] | None = None) -> DataFrame:
    """Filters ``columns`` in place, each by a dot product with the last ``taps`` values.

    angles: those of ``columns`` that are degrees and filtered as unit vectors, so that 359.99 and 0.01 are near one another; a missing
    angle stays missing.  Without them a heading is filtered like any number, as published.

    order: the time, then what tells rows of equal time apart.  init="zero" starts from rest, so the first rows of an
    episode are drawn to 0; "steady" starts as if the first value had always been there.  One window collects a struct of all
    columns.  Without ``fs`` the response is made once for each episode.  Suited to a few columns; for many, ``lowpass_many``
    runs the recursion itself.
    """
    if angles:
        turned, parts = as_unit_vectors(df, angles)
        return as_degrees(lowpass(turned, keys, order, [*(c for c in columns if c not in angles), *parts], cutoff_hz, taps, init, fs), angles).select(*df.columns)
    w = Window.partitionBy(*keys).orderBy(*order)
    if init == "steady":
        for c in columns:
            df = df.withColumn(f"_0{c}", F.first(c).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = df.withColumn("_past", F.reverse(F.collect_list(F.struct(*columns)).over(w.rowsBetween(-(taps - 1), 0))))
    if fs is None:
        rate = coefficients(F.coalesce("fs", F.lit(2 * cutoff_hz / HIGHEST)), cutoff_hz)
        d = d.join(episode_rate(df, keys, order).select(*keys, impulse_response(rate, taps).alias("_h")), keys, "left")
        response = F.col("_h")
    else:
        response = F.array(*map(F.lit, impulse_values(cutoff_hz, fs, taps)))
    for c in columns:
        base = F.col(f"_0{c}") if init == "steady" else F.lit(0.0)
        terms = F.zip_with(F.col("_past"), response, _weighted(c, base))
        d = d.withColumn(f"_f{c}", base + F.aggregate(terms, F.lit(0.0), lambda a, b: a + b))
    return d.select(*[F.col(f"_f{c}").alias(c) if c in columns else F.col(c) for c in df.columns if not c.startswith("_0")])


def _weighted(column: str, base: Column):
    def term(x: Column, h: Column) -> Column:
        return F.when(x.isNotNull(), (x[column] - base) * h).otherwise(0.0)

    return term


#: Rows that the recursion of ``lowpass_many`` answers at once.
BLOCK = 64


def lowpass_many(df: DataFrame, keys: list[str], order: list[str], columns: list[str], cutoff_hz: float, init: str = "zero", angles: list[str] | None = None) -> DataFrame:
    """The same recursion for many columns at once, with its last two inputs and outputs carried along an episode's rows.

    Blocks of rows are answered by one product with the response and one with the state, so no row is a step of its own.
    angles: those of ``columns`` that are degrees and filtered as unit vectors.
    """
    if angles:
        turned, parts = as_unit_vectors(df, angles)
        return as_degrees(lowpass_many(turned, keys, order, [*(c for c in columns if c not in angles), *parts], cutoff_hz, init), angles).select(*df.columns)
    rated = df.join(episode_rate(df, keys, order), keys, "left")

    def start():
        state = None

        def step(pdf):
            nonlocal state
            import numpy as np

            x = pdf[columns].to_numpy(np.float64)
            fs = pdf["fs"].iloc[0]
            if state is None:
                b, a = butterworth2(cutoff_hz, float(fs) if fs == fs and fs is not None else 2 * cutoff_hz / HIGHEST)
                h = np.array(impulse_values(cutoff_hz, float(fs) if fs == fs and fs is not None else 2 * cutoff_hz / HIGHEST, BLOCK))
                at = np.arange(BLOCK)
                whole = np.where(at[:, None] >= at[None, :], h[at[:, None] - at[None, :]], 0.0)
                carry = np.zeros((BLOCK, 4))  # answers to x1, x2, y1 and y2 alone
                for k, (x1, x2, y1, y2) in enumerate(np.eye(4)):
                    for n in range(BLOCK):
                        y = b[1] * x1 + b[2] * x2 - a[0] * y1 - a[1] * y2
                        carry[n, k] = y
                        x1, x2, y1, y2 = 0.0, x1, y, y1
                past = np.zeros((4, x.shape[1])) if init == "zero" else np.repeat(x[:1], 4, 0)
                state = whole, carry, past
            whole, carry, past = state
            y = np.empty_like(x)
            for at in range(0, len(x), BLOCK):
                part = x[at : at + BLOCK]
                m = len(part)
                y[at : at + m] = whole[:m, :m] @ part + carry[:m] @ past
                xs, ys = np.vstack([past[1::-1], part]), np.vstack([past[:1:-1], y[at : at + m]])
                past = np.vstack([xs[:-3:-1], ys[:-3:-1]])
            state = whole, carry, past
            return pdf.drop(columns="fs").assign(**{c: y[:, k] for k, c in enumerate(columns)})

        return step

    return carried(rated, keys, order, start, schema_with(df, {c: "double" for c in columns})).select(*df.columns)


#: Grid times that one array of ``hold_on_grid`` holds.
GAP_CHUNK = 65_536


def hold_on_grid(df: DataFrame, keys: list[str], order: list[str], step: float, grid: str = "t_grid", frame: str = "grid_idx") -> DataFrame:
    """Every grid time t0 + k * step up to the last time, with the newest row at or before it.

    order: the time, then what tells rows of equal time apart; of those the last one holds.  No join: each row covers the grid times from its own time to the next row's, so it is exploded into
    them.  Grid times come from one multiplication each, never from adding up.
    """
    time = order[0]
    w = Window.partitionBy(*keys).orderBy(*order)
    whole = Window.partitionBy(*keys)
    df = df.withColumns({"_next": F.lead(time).over(w), "_t0": F.min(time).over(whole), "_t1": F.max(time).over(whole)})
    last = F.floor((F.col("_t1") - F.col("_t0")) / F.lit(step))
    # one step more on either side: the exact test follows
    low = F.greatest(F.lit(0), F.floor((F.col(time) - F.col("_t0")) / F.lit(step)) - 1)
    high = F.least(last, F.ceil((F.coalesce("_next", "_t1") - F.col("_t0")) / F.lit(step)) + 1)
    # a long gap is exploded twice, so that no array is longer than a chunk of it
    none = F.array().cast("array<bigint>")
    chunks = F.when(low <= high, F.sequence(F.lit(0).cast("long"), F.floor((high - low) / F.lit(GAP_CHUNK)))).otherwise(none)
    df = df.withColumns({"_low": low, "_high": high, "_chunk": F.explode(chunks)})
    start = F.col("_low") + F.col("_chunk") * F.lit(GAP_CHUNK)
    df = df.withColumn(frame, F.explode(F.sequence(start, F.least("_high", start + F.lit(GAP_CHUNK - 1))))).drop("_low", "_high", "_chunk")
    df = df.withColumn(grid, F.col("_t0") + F.col(frame) * F.lit(step))
    df = df.where((F.col(time) <= F.col(grid)) & (F.col("_next").isNull() | (F.col(grid) < F.col("_next"))))
    return df.drop("_next", "_t0", "_t1")


def to_rate(df: DataFrame, keys: list[str], order: list[str], smooth: list[str], cutoff_hz: float, step: float, bounds: dict[str, tuple[float, float]] | None = None, init: str = "zero", angles: list[str] | None = None) -> DataFrame:
    """Low-pass the continuous columns (``angles`` as unit vectors), hold everything on the grid (other columns unfiltered), and clip controls to their bounds."""
    from ..functions.guards import clip

    out = hold_on_grid(lowpass_many(df, keys, order, smooth, cutoff_hz, init, angles), keys, order, step)
    return out.withColumns({c: clip(F.col(c), *b) for c, b in (bounds or {}).items()}) if bounds else out
