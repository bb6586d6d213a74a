"""Sinks of a stream that write every micro-batch once, also when it is run again after a crash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .live import command_lines

FORMATS = ("json", "text", "parquet")


def batch_writer(path: str, form: str = "json"):
    """A function for foreachBatch: the batch's rows as a folder named by its number, which replaces what an earlier try has left.

    A batch that is run again has the same number and the same rows, so it puts its folder in the place of the old one.  Readers take
    the folders of all batches; a folder without its success mark is one that is being written.
    """
    if form not in FORMATS:
        raise ValueError(f"{form} is none of {FORMATS}")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").format(form).save(f"{path.rstrip('/')}/batch={number:012d}")

    return write


def write_once(stream: DataFrame, path: str, checkpoint: str, form: str = "json"):
    """A writer of ``stream`` by ``batch_writer``: each row stands in the output once, whatever fails in between."""
    return stream.writeStream.foreachBatch(batch_writer(path, form)).option("checkpointLocation", checkpoint)


def command_sink(cycles: DataFrame, path: str, checkpoint: str):
    """The command lines of handled cycles, as lines of text under the run that they are for."""

    def write(batch: DataFrame, number: int) -> None:
        lines = command_lines(batch)
        lines.sortWithinPartitions("run_id", "sim_time").select("run_id", "value").write.mode("overwrite").partitionBy("run_id").text(f"{path.rstrip('/')}/batch={number:012d}")

    return cycles.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def written_once(spark: SparkSession, path: str, schema: str, form: str = "json") -> DataFrame:
    """What ``write_once`` has written so far, with the number of each row's batch."""
    return spark.read.schema(f"{schema}, batch long").format(form).load(path)
