"""Operators on the rows of an episode in time order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .carry import carried, schema_with


def _w(keys, order):
    return Window.partitionBy(*keys).orderBy(*order)


def first_of_time(df: DataFrame, keys: list[str], time: str, position: str) -> DataFrame:
    """One row per key and time: the first by input position (dropDuplicates would keep any)."""
    w = Window.partitionBy(*keys, time).orderBy(position)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def row_slice(df: DataFrame, keys: list[str], order: list[str], low: Column | int, high: Column | int) -> DataFrame:
    """Rows low..high (from 0, inclusive, clamped to the last row) of every key, with orig_row_index."""
    n = F.count("*").over(Window.partitionBy(*keys))
    df = df.withColumn("orig_row_index", F.row_number().over(_w(keys, order)) - 1).withColumn("_last", n - 1)
    low, high = (F.lit(x) if isinstance(x, int) else x for x in (low, high))
    return df.where(F.col("orig_row_index").between(F.least(low, F.col("_last")), F.least(high, F.col("_last")))).drop("_last")


def backward_difference(df: DataFrame, keys: list[str], order: list[str], column: str, name: str) -> DataFrame:
    return df.withColumn(name, F.col(column) - F.lag(column).over(_w(keys, order)))


def rolling_std(df: DataFrame, keys: list[str], order: list[str], column: str, width: int, name: str) -> DataFrame:
    """Sample standard deviation of the last ``width`` rows; null until there are that many values."""
    w = _w(keys, order).rowsBetween(-(width - 1), 0)
    return df.withColumn(name, F.when(F.count(column).over(w) == width, F.stddev_samp(column).over(w)))


def hold_where(df: DataFrame, keys: list[str], order: list[str], column: str, valid: Column, name: str) -> DataFrame:
    """The last value of ``column`` on a valid row; before the first valid row, the value itself."""
    w = _w(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_v", F.when(valid, F.col(column)))
    return df.withColumn(name, F.coalesce(F.last("_v", ignorenulls=True).over(w), F.col(column))).drop("_v")


def first_crossing(df: DataFrame, keys: list[str], idx: str, condition: Column, time: str) -> DataFrame:
    """(keys, idx, t, found): the first row on which the condition holds, else the last row."""
    at = F.min(F.when(condition, F.struct(F.col(idx).alias("i"), F.col(time).alias("t"))))
    end = F.max(F.struct(F.col(idx).alias("i"), F.col(time).alias("t")))
    got = df.groupBy(*keys).agg(at.alias("a"), end.alias("e"))
    return got.select(*keys, F.coalesce("a.i", "e.i").alias(idx), F.coalesce("a.t", "e.t").alias("t"), F.col("a").isNotNull().alias("found"))


def lower_bound(df: DataFrame, keys: list[str], idx: str, time: str, x: Column) -> DataFrame:
    """(keys, idx): the first row whose time is not below x, else the last row."""
    return df.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col(time) >= x, F.col(idx))), F.max(idx)).alias(idx))


def is_increasing(df: DataFrame, keys: list[str], position: list[str], time: str, strictly: bool) -> DataFrame:
    """(keys, increasing): whether times never fall (or always rise) in the given order."""
    step = F.col(time) - F.lag(time).over(_w(keys, position))
    ok = step > 0 if strictly else step >= 0
    return df.withColumn("_ok", F.coalesce(ok, F.lit(True))).groupBy(*keys).agg(F.bool_and("_ok").alias("increasing"))


def rate_limited(df: DataFrame, keys: list[str], order: list[str], limits: dict[str, tuple[float, float | None]]) -> DataFrame:
    """Adds <column>_out: each step moves from the last output towards the target by at most the limit.

    limits: column -> (most per step, first output's predecessor; None: the first output is the first target).  A row
    without a target holds the last output.  One pass, with the last outputs carried along.
    """

    def start():
        last = {c: first for c, (_, first) in limits.items()}

        def step(pdf):
            out = {}
            for c, (most, _) in limits.items():
                y, got = last[c], []
                for x in pdf[c].astype("float64").tolist():
                    if x == x:  # a missing target is NaN here
                        y = x if y is None else y + max(-most, min(most, x - y))
                    got.append(y)
                last[c], out[f"{c}_out"] = y, got
            return pdf.assign(**out)

        return step

    return carried(df, keys, order, start, schema_with(df, {f"{c}_out": "double" for c in limits}))


def latest_only(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row per key: what a reader sees that drops its backlog."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("x")).select("x.*")
