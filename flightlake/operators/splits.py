"""Grouped splits and scalers that see training rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import scale
from .profile import values_of

LEAST_STD = 1e-6


def holdout(sessions: DataFrame, scenario: str, session: str = "session_id", column: str = "scenario_id") -> DataFrame:
    """The session of a scenario with the smallest sha256 of its name: no random seed is needed."""
    return sessions.where(F.col(column) == scenario).agg(F.min_by(session, F.sha2(F.col(session), 256)).alias(session))


def loso_folds(sessions: DataFrame, session: str = "session_id") -> DataFrame:
    """(fold_id, val_session, session, role): every session validates one fold and trains the others.

    The pairs are the result itself: their number is the square of the sessions', however many rows those have.
    """
    s = sessions.select(session).distinct()
    folds = s.withColumn("fold_id", F.row_number().over(Window.orderBy(session)) - 1).withColumnRenamed(session, "val_session")
    return folds.crossJoin(s).withColumn("role", F.when(F.col(session) == F.col("val_session"), "val").otherwise("train"))


def split_rows(rows: DataFrame, folds: DataFrame, session: str = "session_id") -> DataFrame:
    """Rows with their fold_id and role, one copy for each fold."""
    return rows.join(folds.select(session, "fold_id", "role"), session)


def fit_scalers(rows: DataFrame, by: list[str], variables: list[str]) -> DataFrame:
    """(by, variable, mean, std, degenerate): population deviation; one that is no number or nearly 0 becomes 1 and is marked."""
    v = values_of(rows, by, variables).groupBy(*by, F.col("column_name").alias("variable")).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("_s"))
    bad = F.col("_s").isNull() | F.isnan("_s") | (F.col("_s") < LEAST_STD)
    return v.select(*by, "variable", "mean", F.when(bad, 1.0).otherwise(F.col("_s")).alias("std"), bad.alias("degenerate"))


def apply_scalers(rows: DataFrame, scalers: DataFrame, by: list[str], variables: list[str], bound: float = 5.0) -> DataFrame:
    """z-scores of ``variables``, clipped; the scaler table is folded to one row per ``by`` and joined once."""
    entry = F.map_from_entries(F.collect_list(F.struct("variable", F.struct("mean", "std"))))
    wide = scalers.where(F.col("variable").isin(*variables)).groupBy(*by).agg(entry.alias("_m")) if by else scalers.where(F.col("variable").isin(*variables)).agg(entry.alias("_m"))
    joined = rows.join(wide, by) if by else rows.crossJoin(F.broadcast(wide))  # one row of scalers
    return joined.withColumns({c: scale(F.col(c), F.col("_m")[c]["mean"], F.col("_m")[c]["std"], bound) for c in variables}).drop("_m")
