"""Column profiles and audits: one pass over unpivoted values instead of one query per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import is_finite
from ..schema import CONTROL_RANGES, FORBIDDEN_PARTS, KEPT_ROLES, METADATA, ROLES, UNIT_PARTS

NEARLY = 1e-6


def values_of(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """(ids, column_name, position, value): the columns turned into rows, position being their order."""
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"), F.col(f"`{c}`").cast("double").alias("value")) for i, c in enumerate(columns)]))
    return df.select(*ids, long.alias("x")).select(*ids, "x.*")


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: missing and infinite values, distinct values, finite min, max, mean and sample deviation, and whether it is (nearly) constant."""
    v = F.col("value")
    good = F.when(is_finite(v), v)
    got = values_of(df, [], columns).groupBy("column_name").agg(
        F.count_if(v.isNull() | F.isnan(v)).alias("missing_count"),
        F.count_if(F.abs(v) == float("inf")).alias("inf_count"),
        F.count_distinct(F.when(~F.isnan(v), v)).alias("n_unique"),
        F.min(good).alias("min"),
        F.max(good).alias("max"),
        F.avg(good).alias("mean"),
        F.stddev_samp(good).alias("std"),
    )
    nearly = (F.col("std") < NEARLY) | (F.col("max") - F.col("min") < NEARLY)
    got = got.withColumn("is_constant", F.col("n_unique") <= 1)
    return got.withColumn("is_near_constant", ~F.col("is_constant") & F.coalesce(nearly, F.lit(False)))


def timing_audit(df: DataFrame, keys: list[str], position: list[str], time: str) -> DataFrame:
    """Per recording: order, repeated times, rate from the median step, gaps over three medians, step statistics."""
    w = Window.partitionBy(*keys).orderBy(*position)
    again = F.row_number().over(Window.partitionBy(*keys, time).orderBy(*position)) > 1
    steps = df.select(*keys, F.col(time).alias("t"), (F.col(time) - F.lag(time).over(w)).alias("dt"), again.alias("again"))
    whole = Window.partitionBy(*keys)
    steps = steps.withColumn("median", F.percentile("dt", F.lit(0.5)).over(whole))
    return steps.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        F.min("t").alias("t_start_s"),
        F.max("t").alias("t_end_s"),
        (F.max("t") - F.min("t")).alias("duration_s"),
        F.bool_and(F.coalesce(F.col("dt") >= 0, F.lit(True))).alias("is_monotonic"),
        F.count_if("again").alias("n_duplicate_timestamps"),
        (1 / F.nullif(F.first("median"), F.lit(0.0))).alias("effective_freq_hz_median"),
        F.avg("dt").alias("dt_mean_s"),
        F.stddev_samp("dt").alias("dt_std_s"),
        F.count_if(F.col("dt") > 3 * F.col("median")).alias("n_gaps_gt_3x_median_dt"),
        F.max("dt").alias("max_gap_s"),
    )


def range_audit(df: DataFrame, ranges: dict[str, tuple[float, float]] = CONTROL_RANGES) -> DataFrame:
    """Per control: values outside its range (by more than 1e-6), and the values seen."""
    cols = [c for c in ranges if c in df.columns]
    low = F.create_map(*[F.lit(x) for c in cols for x in (c, float(ranges[c][0]))])
    high = F.create_map(*[F.lit(x) for c in cols for x in (c, float(ranges[c][1]))])
    v = values_of(df, [], cols).withColumns({"expected_min": low[F.col("column_name")], "expected_max": high[F.col("column_name")]})
    return v.groupBy("column_name", "expected_min", "expected_max").agg(
        F.min("value").alias("observed_min"),
        F.max("value").alias("observed_max"),
        F.count_if(F.col("value") < F.col("expected_min") - NEARLY).alias("n_below_range"),
        F.count_if(F.col("value") > F.col("expected_max") + NEARLY).alias("n_above_range"),
    )


def duplicate_columns(df: DataFrame, position: list[str], columns: list[str]) -> DataFrame:
    """(keep_column, drop_column): columns with equal values in every row, rounded to nine digits; constant ones are left out.

    A signature that any partition can add to (sums of two hashes of place and value) groups the columns into candidates.  One more pass
    compares the candidates row by row, and only those, so columns whose signatures happen to agree are not taken for equal; the
    first in column order is kept.
    """
    candidates = same_signature(df, position, columns)
    pairs = [(r.keep_column, r.drop_column) for r in candidates.collect()]  # at most one pair for each column
    return confirmed_duplicates(df, columns, pairs)


def _plain(v: Column) -> Column:
    """A value as it is compared: missing and infinite ones by fixed numbers, rounded to nine digits."""
    plain = F.when(v.isNull() | F.isnan(v), F.lit(-999999.0)).when(F.abs(v) == float("inf"), F.signum(v) * 1e18).otherwise(v)
    plain = F.when(F.abs(plain) < 1e6, F.round(plain, 9)).otherwise(plain)
    return F.when(plain == 0, F.lit(0.0)).otherwise(plain)


def confirmed_duplicates(df: DataFrame, columns: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """(keep_column, drop_column): in each group of candidate ``pairs``, columns that equal an earlier one of the group in every row.

    One aggregation of one flag for each pair inside a group.
    """
    groups: dict[str, list[str]] = {}
    for keep, drop in pairs:
        groups.setdefault(keep, [keep]).append(drop)
    tests = [(a, b) for g in groups.values() for g in [sorted(g, key=columns.index)] for j, b in enumerate(g) for a in g[:j]]
    spark = df.sparkSession
    if not tests:
        return spark.createDataFrame([], "keep_column string, drop_column string")
    value = lambda c: _plain(F.col(f"`{c}`").cast("double"))
    flags = df.agg(F.array(*[F.struct(F.lit(a).alias("keep_column"), F.lit(b).alias("drop_column"), F.lit(columns.index(a)).alias("place"), F.coalesce(F.bool_and(value(a) == value(b)), F.lit(False)).alias("same")) for a, b in tests]).alias("x"))
    same = flags.select(F.explode("x").alias("x")).select("x.*").where("same")
    return same.groupBy("drop_column").agg(F.min_by("keep_column", "place").alias("keep_column")).select("keep_column", "drop_column")


def same_signature(df: DataFrame, position: list[str], columns: list[str]) -> DataFrame:
    """(keep_column, drop_column): columns whose signatures agree with that of an earlier one; constant columns are left out."""
    v = F.col("value")
    h = F.xxhash64(*position, _plain(v))
    part = lambda n: F.sum(F.shiftright(F.xxhash64(h, F.lit(n)), 24))  # noqa: E731  sums of 40-bit numbers cannot overflow
    sign = values_of(df, position, columns).groupBy("column_name", "position").agg(
        part(1).alias("s1"), part(2).alias("s2"), F.count_distinct(F.when(~F.isnan(v), v)).alias("n")
    )
    same = Window.partitionBy("s1", "s2")
    sign = sign.where("n > 1").withColumn("keep_column", F.min_by("column_name", "position").over(same))
    return sign.where("column_name <> keep_column").select("keep_column", F.col("column_name").alias("drop_column"))


def lag_duplicate(df: DataFrame, key: str, position: list[str], keep: str, drop: str, convert=lambda x: x, max_lag: int = 2) -> DataFrame:
    """One row telling whether ``drop`` is convert(keep) up to one shift, the same in every file.

    Per file the best of the shifts -max_lag..max_lag is taken (the smallest largest residual, ties to the
    lower shift); the most frequent one (ties to the one of the first file) is applied to all, and the
    worst file's residual is held against 1e-3 of that file's range.
    """
    w = Window.partitionBy(key).orderBy(*position)
    shifts = F.array(*[F.struct(F.lit(k).alias("lag"), (F.lead(drop, k) if k >= 0 else F.lag(drop, -k)).over(w).alias("b")) for k in range(-max_lag, max_lag + 1)])
    rows = df.select(key, F.col(keep).alias("a"), shifts.alias("s")).select(key, "a", F.explode("s").alias("s"))
    err = F.abs(F.col("s.b") - convert(F.col("a")))
    a = F.when(is_finite(F.col("a")), F.col("a"))
    per = rows.groupBy(key, F.col("s.lag").alias("lag")).agg(F.max(F.when(is_finite(err), err)).alias("err"), (F.max(a) - F.min(a)).alias("span"))
    best = per.where("err IS NOT NULL").groupBy(key).agg(F.min_by("lag", F.struct("err", "lag")).alias("lag"))
    vote = best.groupBy("lag").agg(F.count("*").alias("n"), F.min(key).alias("first")).agg(F.min_by("lag", F.struct(-F.col("n"), "first")).alias("lag_samples"))
    # the worst file, of equal ones the first
    worst = per.join(F.broadcast(vote), per["lag"] == vote["lag_samples"]).where("err IS NOT NULL").groupBy("lag_samples")
    worst = worst.agg(F.max("err").alias("max_abs_error"), F.min_by("span", F.struct(-F.col("err"), key)).alias("span"))
    tolerance = F.greatest(F.lit(1e-3), F.lit(1e-3) * F.when(F.col("span") > 0, F.col("span")).otherwise(1.0))
    return worst.select("lag_samples", "max_abs_error", tolerance.alias("tolerance_used"), (F.col("max_abs_error") < tolerance).alias("confirmed_duplicate"))


def unit_of(name: Column) -> Column:
    """Unit by parts of a property path; the first that fits."""
    out = None
    for part, unit, but in UNIT_PARTS:
        fits = F.contains(name, F.lit(part))
        fits = fits & ~F.contains(name, F.lit(but)) if but else fits
        out = F.when(fits, unit) if out is None else out.when(fits, unit)
    return out.when(name == "frame", "count").when(name == "sim_time", "s").otherwise("")


def is_forbidden(name: Column) -> Column:
    return F.exists(F.array(*map(F.lit, FORBIDDEN_PARTS)), lambda part: F.contains(name, part))


def assign_roles(profile: DataFrame) -> DataFrame:
    """Adds unit, role, selected_for_baseline and exclusion_reason to a profile (column_name, is_constant)."""
    name, role = F.col("column_name"), None
    for r, members in ROLES:
        role = F.when(name.isin(*members), r) if role is None else role.when(name.isin(*members), r)
    df = profile.withColumn("unit", unit_of(name)).withColumn("role", role.otherwise("excluded"))
    reason = (
        F.when(F.col("role") != "excluded", "")
        .when(F.col("is_constant"), "constant_or_not_applicable_to_c172p")
        .when(is_forbidden(name), "forbidden_input_family_section10")
        .otherwise("not_in_v1_feature_schema_sections14_15")
    )
    return df.withColumns({"selected_for_baseline": F.col("role").isin("neural_input", "label"), "exclusion_reason": reason})


def apply_duplicates(catalog: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Marks confirmed duplicates (drop_column, keep_column, formula, seq) in a catalogue; of several the last counts, labels stay."""
    last = confirmed.groupBy(F.col("drop_column").alias("column_name")).agg(F.max_by(F.struct("keep_column", "formula"), "seq").alias("d"))
    df = catalog.join(last, "column_name", "left")
    hit = F.col("d").isNotNull() & (F.col("role") != "label")
    return df.withColumns(
        {
            "duplicate_of": F.coalesce("d.keep_column", F.lit("")),
            "conversion_relation": F.coalesce("d.formula", F.lit("")),
            "exclusion_reason": F.when(hit, F.concat(F.lit("duplicate_of "), F.col("d.keep_column"))).otherwise(F.col("exclusion_reason")),
            "role": F.when(hit, "excluded").otherwise(F.col("role")),
        }
    ).drop("d")


def carried(catalog: DataFrame) -> DataFrame:
    """(column_name): what goes on to the regular grid, by its role; the time and the frame are made anew there."""
    return catalog.where(F.col("role").isin(*KEPT_ROLES) & ~F.col("column_name").isin(*METADATA)).select("column_name")


def carried_columns(catalog: DataFrame) -> list[str]:
    """The names of ``carried``, to select by: one short row per column."""
    return [r.column_name for r in carried(catalog).orderBy("column_name").collect()]


def pruned(df: DataFrame, catalog: DataFrame, always: list[str]) -> DataFrame:
    """``df`` with the columns ``always`` and those that the catalogue carries."""
    return df.select(*always, *[f"`{c}`" for c in carried_columns(catalog) if c in df.columns])


def scenario_signals(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, column_name, mean, std, max): what tells scenarios apart, such as wind and turbulence; sample deviation."""
    v = F.when(is_finite(F.col("value")), F.col("value"))
    return values_of(df, by, columns).groupBy(*by, "column_name").agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.max(v).alias("max"))


def most_frequent(df: DataFrame, by: list[str], n: int | None = None) -> DataFrame:
    """(by, n) by falling count, ties by value; the first ``n`` if that is given."""
    out = df.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by)
    return out.limit(n) if n else out


def required_columns(df: DataFrame, required: list[str]) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
