"""Episodes stored for chains of ordered operators: bucketed by episode, so that reading them costs no exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def store(df: DataFrame, name: str, buckets: int, keys: tuple[str, ...] = ("episode_id",), order: tuple[str, ...] = ("sim_time",), path: str | None = None) -> None:
    """Writes ``df`` as table ``name`` in ``buckets`` files by ``keys``, sorted by keys and order.

    Windows, joins and aggregates over the keys then take the table as it lies, one after the other; so does a carried recursion, but what
    follows one is dealt anew, as Spark does not know how Python's rows lie.  The number of buckets is that of the tasks that
    read it: episodes of a size of which a task holds many.  path: a folder for the files, in place of the warehouse's.
    """
    writer = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys, *order).mode("overwrite").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def stored(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
