"""Runs of rows on which a condition holds (gaps and islands), and picks among them.

Two conventions tell whether a run is long enough, and differ by one sample: by time, last minus
first time >= seconds; by count, number of samples >= n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: list[str], *order: str, name: str = "idx") -> DataFrame:
    """Adds the row number from 0 within each key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def mark_runs(df: DataFrame, keys: list[str], order: list[str], flag: Column, name: str = "run") -> DataFrame:
    """Adds the number of the run (from 1) on rows where ``flag`` is true, null elsewhere; a null flag is false."""
    w = Window.partitionBy(*keys).orderBy(*order)
    on = F.coalesce(flag, F.lit(False))
    df = df.withColumn("_on", on)
    first = F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False))
    df = df.withColumn("_first", first.cast("int"))
    so_far = F.sum("_first").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, F.when(F.col("_on"), so_far)).drop("_on", "_first")


def islands(df: DataFrame, keys: list[str], order: str, flag: Column, idx: str = "idx") -> DataFrame:
    """(keys, run, start_idx, end_idx, start_t, end_t, n): one row per run, ``order`` being its time."""
    marked = mark_runs(df, keys, [order, idx], flag).where("run IS NOT NULL")
    return marked.groupBy(*keys, "run").agg(
        F.min(idx).alias("start_idx"),
        F.max(idx).alias("end_idx"),
        F.min(order).alias("start_t"),
        F.max(order).alias("end_t"),
        F.count("*").alias("n"),
    )


def longest_run(runs: DataFrame, keys: list[str], least_s: float) -> DataFrame:
    """The longest run of at least ``least_s`` per key; the earliest of equal ones."""
    fit = runs.withColumn("duration_s", F.col("end_t") - F.col("start_t")).where(F.col("duration_s") >= least_s)
    cols = [c for c in fit.columns if c not in keys]
    return fit.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct("duration_s", -F.col("start_idx"))).alias("x")).select(*keys, "x.*")


def first_run_by_time(runs: DataFrame, keys: list[str], least_s: float) -> DataFrame:
    """The first run per key that lasts ``least_s`` from its first to its last sample."""
    return _first(runs.where(F.col("end_t") - F.col("start_t") >= least_s), keys)


def first_run_by_count(runs: DataFrame, keys: list[str], least_n: Column | int) -> DataFrame:
    """The first run per key with at least ``least_n`` samples."""
    return _first(runs.where(F.col("n") >= least_n), keys)


def _first(runs: DataFrame, keys: list[str]) -> DataFrame:
    cols = [c for c in runs.columns if c not in keys]
    return runs.groupBy(*keys).agg(F.min_by(F.struct(*cols), "start_idx").alias("x")).select(*keys, "x.*")


def running_count(df: DataFrame, keys: list[str], order: list[str], flag: Column, name: str = "count") -> DataFrame:
    """Adds how many rows the current run has had so far; 0 where the flag is not true."""
    marked = mark_runs(df, keys, order, flag, "_r")
    w = Window.partitionBy(*keys, "_r").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn(name, F.when(F.col("_r").isNull(), F.lit(0)).otherwise(F.count("*").over(w)).cast("long")).drop("_r")


def with_first_lasting(df: DataFrame, keys: list[str], flags: dict[str, tuple[str, float]]) -> DataFrame:
    """Adds, for each name: (flag, seconds), where the key's first run of rows with the flag begins that lasts, as a struct (idx, t), on every row.

    df has keys, idx and t.  All flags share one window, so any number of them costs one sort.
    """
    w, whole = Window.partitionBy(*keys).orderBy("idx"), Window.partitionBy(*keys)
    so_far, here = w.rowsBetween(Window.unboundedPreceding, 0), F.struct("idx", "t")
    d = df.withColumns({f"_from_{n}": F.when(F.col(f) & ~F.coalesce(F.lag(f).over(w), F.lit(False)), here) for n, (f, _) in flags.items()} | {f"_ends_{n}": F.col(f) & ~F.coalesce(F.lead(f).over(w), F.lit(False)) for n, (f, _) in flags.items()})
    d = d.withColumns({f"_from_{n}": F.last(f"_from_{n}", ignorenulls=True).over(so_far) for n in flags})
    d = d.withColumns({n: F.min(F.when(F.col(f"_ends_{n}") & (F.col("t") - F.col(f"_from_{n}.t") >= s), F.col(f"_from_{n}"))).over(whole) for n, (_, s) in flags.items()})
    return d.drop(*[f"_{x}_{n}" for x in ("from", "ends") for n in flags])
