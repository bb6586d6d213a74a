"""Regression metrics, whole and by group, in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import clip, nan_to_null
from .carry import settled


def measures(true: str, pred: str, low: float, high: float) -> list[Column]:
    """Aggregates of one output: errors, R2 (null for a constant target), Pearson r (null for a constant side), saturation."""
    t, p = F.col(true), F.col(pred)
    e = p - t
    total = F.var_pop(t) * F.count(t)
    flat = (F.count(t) < 2) | (F.stddev_pop(t) < 1e-8) | (F.stddev_pop(p) < 1e-8)
    return [
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.when(total >= 1e-12, 1 - F.sum(e * e) / total).alias("r2"),
        # corr() itself is an error for a constant side, whatever stands around it
        F.when(~flat, F.covar_pop(t, p) / F.nullif(F.stddev_pop(t) * F.stddev_pop(p), F.lit(0.0))).alias("pearson_r"),
        F.max(F.abs(e)).alias("max_abs_error"),
        F.avg(((p < low) | (p > high)).cast("double")).alias("saturation_rate_after_clip"),
        F.avg(F.pow(clip(p, low, high) - t, F.lit(2.0))).alias("mse_after_saturation"),
        F.count("*").alias("n"),
    ]


#: Values of a group that one task sorts, and bins that a larger group is narrowed down by.
MOST_SORTED, BINS = 50_000, 1024
#: Groups whose bins are sent to every executor, so that the rows stay where they are.
MOST_SENT = 10_000
#: Bins of the first count in each doubling of a value.
BINS_A_DOUBLING = 16


def _same(a: DataFrame, b: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """a joined with b (by, ...) on ``by``, nulls being equal."""
    if not by:
        return a.join(b, F.lit(True), how)  # b is one row
    named = b.withColumnsRenamed({c: f"_b_{c}" for c in by})
    return a.join(named, [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in by], how).drop(*[f"_b_{c}" for c in by])


def exact_percentile(df: DataFrame, by: list[str], column: str, p: float, name: str) -> DataFrame:
    """(by, name): the percentile with linear interpolation, exact, whatever the size of a group and the spread of its values.

    No task gathers a group.  Values are counted in bins of a logarithmic scale, both signs apart, summed before the shuffle; where
    the bin that holds the wanted place has more than MOST_SORTED different values, it is cut into BINS even bins, as often as needed: a
    bin spans a small part of a doubling, so six times are enough for all bits of a double.  The values of the last bin are sorted;
    the smallest value past it is known from the bins.  Infinite values take their places by count.  Null and NaN values do not
    count; a group without others has a null.
    """
    return _same(df.select(*by).distinct() if by else df.sparkSession.range(1).select(), _known_percentile(df, by, column, p, name), by, "left")


def _known_percentile(df: DataFrame, by: list[str], column: str, p: float, name: str) -> DataFrame:
    """``exact_percentile`` of the groups that have a value."""
    v = df.select(*by, F.col(column).cast("double").alias("_v"))
    infinite = F.abs("_v") == float("inf")
    # log2 of the smallest double is -1074: the sum is positive
    scale = F.signum("_v") * F.floor((F.log2(F.abs("_v")) + 1080) * BINS_A_DOUBLING)
    rank = F.when(F.col("_v").isNull() | F.isnan("_v"), None).when(infinite, F.signum("_v") * 1e9).when(F.col("_v") == 0, 0.0).otherwise(scale)
    first = v.groupBy(*by, rank.alias("_bin")).agg(F.count("*").alias("_c"), F.min("_v").alias("_mn"), F.max("_v").alias("_mx"))
    valid = F.col("_bin").isNotNull()
    n = F.coalesce(F.sum(F.when(valid, F.col("_c"))).over(Window.partitionBy(*by)), F.lit(0))
    place = (n - 1) * F.lit(p)
    first = first.withColumns({"_k": F.floor(place), "_share": place - F.floor(place), "_below": F.lit(0).cast("long"), "_n": n, "_after": F.lit(None).cast("double")})
    state = _bin_of_place(first.where(valid), by).transform(settled)
    wide = (F.col("_inside") > MOST_SORTED) & (F.col("_lo") < F.col("_hi"))
    # a bounded number of rows, known as they are written: Spark takes them for as large as what they were made of
    sent = F.broadcast if state.count() <= MOST_SENT else lambda x: x
    while state.where(wide).limit(1).count():
        here = _same(v, sent(state.where(wide)), by).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        step = F.least(F.lit(BINS - 1), F.floor((F.col("_v") - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / BINS)))
        cut = here.groupBy(*by, step.alias("_bin")).agg(F.count("*").alias("_c"), F.min("_v").alias("_mn"), F.max("_v").alias("_mx"), *[F.first(x).alias(x) for x in ("_k", "_share", "_below", "_after")])
        state = _bin_of_place(cut, by).unionByName(state.where(~wide)).transform(settled)
    few = _same(v, sent(state.where("_lo < _hi")), by).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    few = few.groupBy(*by).agg(F.sort_array(F.collect_list("_v")).alias("_vs"), *[F.first(x).alias(x) for x in ("_k", "_share", "_below", "_after")])
    spot = (F.col("_k") - F.col("_below")).cast("int")
    found = few.select(*by, "_share", F.get("_vs", spot).alias("_at"), F.coalesce(F.get("_vs", spot + 1), "_after").alias("_next"))
    same = state.where("_lo = _hi").select(*by, "_share", F.col("_lo").alias("_at"), F.when(F.col("_k") + 1 < F.col("_below") + F.col("_inside"), F.col("_lo")).otherwise(F.col("_after")).alias("_next"))
    return found.where("_at IS NOT NULL").unionByName(same).select(*by, _between("_at", "_next", "_share").alias(name))


def _between(at: str, after: str, share: str) -> Column:
    """What lies at a share of the way from a value to the next one, which may be missing."""
    at, after, share = F.col(at), F.coalesce(after, at), F.col(share)
    return F.when((share == 0) | (at == after), at).when((F.abs(at) == float("inf")) | (F.abs(after) == float("inf")), at * (1 - share) + after * share).otherwise(at + (after - at) * share)


def _bin_of_place(bins: DataFrame, by: list[str]) -> DataFrame:
    """The bin that holds place _k of each group: its bounds, the number of values below and inside, and the smallest value past it."""
    w = Window.partitionBy(*by).orderBy("_bin")
    upto = F.col("_below") + F.sum("_c").over(w)
    d = bins.withColumns({"_upto": upto, "_after": F.coalesce(F.lead("_mn").over(w), "_after")}).where((F.col("_upto") - F.col("_c") <= F.col("_k")) & (F.col("_k") < F.col("_upto")))
    return d.select(*by, "_k", "_share", F.col("_mn").alias("_lo"), F.col("_mx").alias("_hi"), (F.col("_upto") - F.col("_c")).alias("_below"), F.col("_c").alias("_inside"), "_after")


def regression(df: DataFrame, by: list[str], true: str, pred: str, low: float, high: float) -> DataFrame:
    """(by, measures..., p95_abs_error) of one output per group."""
    whole = df.groupBy(*by).agg(*measures(true, pred, low, high))
    p95 = _known_percentile(df.select(*by, F.abs(F.col(pred) - F.col(true)).alias("_e")), by, "_e", 0.95, "p95_abs_error")
    return _same(whole, p95, by, "left")


def by_groupings(df: DataFrame, always: list[str], groups: list[str], true: str, pred: str, low: float, high: float) -> DataFrame:
    """One row per grouping and group: over everything, and by each of ``groups``, within ``always``; (grouping, group) name them.

    Every row counts in each grouping; sums are taken before the shuffle.
    """
    return regression(_in_groupings(df, always, groups, [true, pred]), [*always, "grouping", "group"], true, pred, low, high)


def _in_groupings(df: DataFrame, always: list[str], groups: list[str], columns: list[str]) -> DataFrame:
    """Every row once for each grouping, with (grouping, group)."""
    marks = F.array(
        F.struct(F.lit("global").alias("grouping"), F.lit("all").alias("group")),
        *[F.struct(F.lit(g).alias("grouping"), F.col(g).cast("string").alias("group")) for g in groups],
    )
    return df.select(*always, *columns, F.explode(marks).alias("_g")).select(*always, *columns, "_g.*")


def report(df: DataFrame, always: list[str], groups: list[str], episode: str, order: list[str], true: str, pred: str, low: float, high: float) -> DataFrame:
    """``by_groupings`` with command_rate_mae: steps are taken inside a group and episode, so rows that a group leaves out lie between none.

    groups may name the episode itself.  order: the time, then what tells rows of equal time apart.

    Rows are dealt once, by episode: steps lie inside one in every grouping, and what an episode has of its own comes from its rows as they
    lie.  The other groupings' measures are sums and counts taken before the shuffle.
    """
    by, others = [*always, "grouping", "group"], [g for g in groups if g != episode]
    rates = _rates(df, always, others, episode, order, true, pred)
    got = _same(by_groupings(df, always, others, true, pred, low, high), rates, by, "left")
    return got.unionByName(_by_episode(df, always, others, episode, order, true, pred, low, high)) if episode in groups else got


def _dealt(df: DataFrame, always: list[str], groups: list[str], episode: str, order: list[str], true: str, pred: str) -> DataFrame:
    """The columns that both parts of ``report`` deal by episode; Spark makes one exchange of equal ones only."""
    return df.select(*dict.fromkeys([*always, episode, *groups, *order, true, pred]))


def _rates(df: DataFrame, always: list[str], groups: list[str], episode: str, order: list[str], true: str, pred: str) -> DataFrame:
    """(always, grouping, group, command_rate_mae) over everything and by each of ``groups``."""
    d = _dealt(df, always, groups, episode, order, true, pred)
    for i, g in enumerate([[], *([g] for g in groups)]):
        # the window of the whole episode comes first: the others, with one column more, take its rows as they lie; the episode tells
        # rows apart at the first look of a sort
        d = d.withColumn(f"_e{i}", _step_error([episode, *always, *g], order, true, pred))
    marks = F.array(
        F.struct(F.lit("global").alias("grouping"), F.lit("all").alias("group"), F.col("_e0").alias("_e")),
        *[F.struct(F.lit(g).alias("grouping"), F.col(g).cast("string").alias("group"), F.col(f"_e{i}").alias("_e")) for i, g in enumerate(groups, 1)],
    )
    return d.select(*always, F.explode(marks).alias("_g")).select(*always, "_g.*").groupBy(*always, "grouping", "group").agg(F.avg("_e").alias("command_rate_mae"))


def _by_episode(df: DataFrame, always: list[str], others: list[str], episode: str, order: list[str], true: str, pred: str, low: float, high: float) -> DataFrame:
    """The rows of ``report`` that stand for one episode each: the percentile from places in the sorted errors, so no task gathers a group."""
    keys = [episode, *always]
    d = _dealt(df, always, others, episode, order, true, pred)
    d = d.withColumn("_step", _step_error(keys, order, true, pred)).withColumn("_v", nan_to_null(F.abs(F.col(pred) - F.col(true)).cast("double")))
    sizes = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_last())
    d = d.withColumns({"_place": F.row_number().over(sizes) - 1, "_n": F.count("_v").over(sizes.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    place = (F.col("_n") - 1) * F.lit(0.95)
    d = d.withColumns({"_k": F.floor(place), "_share": place - F.floor(place)})
    spot = lambda k: F.max(F.when(F.col("_place") == k, F.col("_v")))
    # _kept, never null, keeps the other groupings' columns in the exchange, so that Spark makes one for both parts
    found = [spot(F.col("_k")).alias("_at"), spot(F.col("_k") + 1).alias("_next"), F.max("_share").alias("_share"), F.max(F.hash(F.lit(0), *others)).alias("_kept")]
    got = d.groupBy(*keys).agg(*measures(true, pred, low, high), *found, F.avg("_step").alias("command_rate_mae")).where("_kept IS NOT NULL")
    names = [F.lit(episode).alias("grouping"), F.col(episode).cast("string").alias("group")]
    return got.select(*always, *names, *[c for c in got.columns if c not in (*keys, "_at", "_next", "_share", "_kept")], _between("_at", "_next", "_share").alias("p95_abs_error"))


def _step_error(keys: list[str], order: list[str], true: str, pred: str) -> Column:
    """Difference between the steps of target and prediction from the row before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return F.abs((F.col(true) - F.lag(true).over(w)) - (F.col(pred) - F.lag(pred).over(w)))


def command_rate_mae(df: DataFrame, groups: list[str], episode: list[str], time: str | list[str], true: str, pred: str) -> DataFrame:
    """Mean difference between the steps of target and prediction, per group; steps are taken inside a group and episode."""
    step = _step_error([*groups, *[e for e in episode if e not in groups]], [time] if isinstance(time, str) else time, true, pred)
    return df.select(*groups, step.alias("_e")).groupBy(*groups).agg(F.avg("_e").alias("command_rate_mae"))


def over_folds(per_fold: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, mean, std): sample deviation, nulls and NaN left out."""
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics]))
    v = F.when(~F.isnan("v"), F.col("v"))
    return per_fold.select(long.alias("x")).select("x.*").groupBy("metric").agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))


def epochs_to_train(per_fold: DataFrame, best: str = "best_epoch") -> DataFrame:
    """Median best epoch, rounded half to even, plus one."""
    return per_fold.agg((F.bround(F.percentile(best, F.lit(0.5)), 0).cast("int") + 1).alias("epochs"))


def histogram(df: DataFrame, column: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """(by, bin, low, high, n): even bins from the smallest to the largest value, the last one closed."""
    by = by or []
    span = df.groupBy(*by).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi")) if by else df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    d = df.where(F.col(column).isNotNull()).join(span, by) if by else df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(span))  # one row
    width = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    place = F.when(width == 0, F.lit(0)).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(column) - F.col("_lo")) / width))).cast("int")
    d = d.groupBy(*by, place.alias("bin"), "_lo", "_hi").agg(F.count("*").alias("n"))
    return d.select(*by, "bin", (F.col("_lo") + F.col("bin") * width).alias("low"), (F.col("_lo") + (F.col("bin") + 1) * width).alias("high"), "n")


def flatten(df: DataFrame, keys: list[str], metrics: str) -> DataFrame:
    """Nested metrics (output -> metric -> value) as (keys, output, metric, value) rows."""
    d = df.select(*keys, F.explode(F.map_entries(metrics)).alias("o"))
    d = d.select(*keys, F.col("o.key").alias("output"), F.explode(F.map_entries("o.value")).alias("m"))
    return d.select(*keys, "output", F.col("m.key").alias("metric"), F.col("m.value").alias("value"))
