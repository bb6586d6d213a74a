"""Tables behind plots: a signal cut down to what a plot can show, and the spans that are shaded beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def decimated(df: DataFrame, keys: list[str], time: str, columns: list[str], buckets: int) -> DataFrame:
    """(keys, column_name, bucket, t_start, t_end, low, high, n): smallest and largest value of each signal in even spans of a key's time.

    However long a recording is, it gives at most ``buckets`` rows for each signal, and no peak is lost.  Missing values do not count; a
    bucket of nothing else is left out.  All is summed before the shuffle, so a long recording is no hot key.
    """
    signals = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns]))
    t = F.col(time).cast("double")
    span = df.groupBy(*keys).agg(F.min(t).alias("_t0"), F.max(t).alias("_t1"))
    d = df.select(*keys, t.alias("_t"), signals.alias("x")).select(*keys, "_t", "x.*").where("v IS NOT NULL AND NOT isnan(v)").join(span, keys)
    width = (F.col("_t1") - F.col("_t0")) / F.lit(float(buckets))
    place = F.when(width == 0, F.lit(0)).otherwise(F.least(F.lit(buckets - 1), F.floor((F.col("_t") - F.col("_t0")) / width))).cast("int")
    got = d.groupBy(*keys, "column_name", place.alias("bucket")).agg(F.min("_t").alias("t_start"), F.max("_t").alias("t_end"), F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
    return got.select(*keys, "column_name", "bucket", "t_start", "t_end", "low", "high", "n")


def phase_spans(df: DataFrame, keys: list[str], order: list[str], phase: str) -> DataFrame:
    """(keys, span, phase, t_start, t_end, n): the runs of rows of one phase, numbered from 1; rows without a phase make runs too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.row_number().over(w).eqNullSafe(1) | ~F.col(phase).eqNullSafe(F.lag(phase).over(w))
    d = df.withColumn("_new", changed.cast("int"))
    d = d.withColumn("span", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "span").agg(F.first(phase).alias("phase"), F.min(order[0]).alias("t_start"), F.max(order[0]).alias("t_end"), F.count("*").alias("n"))
