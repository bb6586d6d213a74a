"""Gates: rules on a plan's rows, counted in the pass that writes them.

A rule flags rows by what stands beside them in a window over the plan's own keys and order, so counting costs no
exchange and no second scan.  The rows are written aside and take their place only if no rule was broken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.guards import is_finite, steps
from ..schema import LANDING
from .checks import CheckFailed

Rules = dict[str, Callable[[Window], Column]]


def recording_rules(time: str, step: float | None = None, finite: tuple[str, ...] = (), tolerance: float = 1e-6) -> Rules:
    """Times rise strictly; with ``step`` they are that far apart; the columns ``finite`` are finite numbers."""
    apart = lambda w: F.col(time) - F.lag(time).over(w)
    rules: Rules = {"rising": lambda w: apart(w) <= 0}
    if step is not None:
        rules["uniform"] = lambda w: F.abs(apart(w) - step) > tolerance
    if finite:
        # cast, so that a text or a missing value is told too
        rules["finite"] = lambda w: ~F.forall(F.array(*[F.coalesce(is_finite(F.col(c).cast("double")), F.lit(False)) for c in finite]), lambda ok: ok)
    return rules


def landing_rules(cfg: dict = LANDING) -> Rules:
    """On rows of ``phases.landing_rows``: boundaries in order, touchdowns backed by both main wheels, no candidate on the nose wheel alone, no bounce without a rollout."""
    idx = F.col("idx")

    def backed(w):
        ahead = w.rowsBetween(0, Window.unboundedFollowing)
        off = F.coalesce(F.min(F.when(~F.col("_both"), idx)).over(ahead), F.max(idx).over(ahead) + 1)
        return (idx == F.col("touchdown_idx")) & (off - idx < steps(cfg["touchdown_s"], F.col("_dt")))

    return {
        "order": lambda w: (F.col("rollout_idx") < F.col("touchdown_idx")) | (F.col("complete_idx") < F.col("rollout_idx")),
        "touchdown": backed,
        "nose": lambda w: (F.col("phase") == "CONTACT_CANDIDATE") & ~F.col("_main"),
        "bounce": lambda w: (F.col("phase") == "BOUNCE") & (F.col("rollout_idx").isNull() | (F.col("rollout_idx") < idx)),
    }


def flagged(df: DataFrame, keys: list[str], order: list[str], rules: Rules) -> DataFrame:
    """Adds _bad_<rule>, true on rows that break the rule."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({f"_bad_{n}": F.coalesce(rule(w), F.lit(False)) for n, rule in rules.items()})


def counts(df: DataFrame, keys: list[str], order: list[str], rules: Rules) -> DataFrame:
    """(keys, rule, n): how many rows of each key break each rule; keys and rules without any are left out."""
    per = flagged(df, keys, order, rules).groupBy(*keys).agg(F.array(*[F.struct(F.lit(n).alias("rule"), F.count_if(f"_bad_{n}").alias("n")) for n in rules]).alias("x"))
    return per.select(*keys, F.explode("x").alias("x")).select(*keys, "x.*").where("n > 0")


def write_checked(df: DataFrame, keys: list[str], order: list[str], rules: Rules, path: str, partition_by: tuple[str, ...] = ()) -> dict[str, int]:
    """Writes ``df`` to ``path`` as Parquet if its rows keep all rules; otherwise raises CheckFailed with counts and one example each.

    The counts are metrics of the writing job itself.  Rows go to a folder beside the path first; after a failure they are left there
    to be looked at, and nothing is found at the path.  A task that runs twice may count a broken row twice, never turn none into some.
    """
    seen = Observation()
    told = F.to_json(F.struct(*keys, order[0]))
    bad = flagged(df, keys, order, rules)
    bad = bad.observe(seen, *[F.count_if(f"_bad_{n}").alias(n) for n in rules], *[F.min(F.when(F.col(f"_bad_{n}"), told)).alias(f"{n}_example") for n in rules])
    aside = f"{path.rstrip('/')}.unchecked"
    writer = bad.drop(*[f"_bad_{n}" for n in rules]).write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(aside)
    found = {n: seen.get[n] for n in rules}
    if any(found.values()):
        raise CheckFailed("; ".join(f"{n}: {k} rows, such as {seen.get[f'{n}_example']}" for n, k in found.items() if k) + f"; rows are in {aside}")
    _moved(df, aside, path)
    return found


def _moved(df: DataFrame, source: str, target: str) -> None:
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    a, b = (jvm.org.apache.hadoop.fs.Path(x) for x in (source, target))
    files = a.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(b):
        files.delete(b, True)
    if not files.rename(a, b):
        raise OSError(f"{source} could not be moved to {target}")
