"""Helpers shared by the training-data operators: tables, scratch space, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch that a task works on at once: Spark sends up to 10,000, whose whole texts would stand in memory several times.
SLICE_ROWS = 500


def slices(batches):
    """Arrow batches in parts of at most SLICE_ROWS rows, in order."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark from any store that Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder name inside the shared folder that ``spark.checkpoint.dir`` names.

    Only in local mode, where all tasks share the machine's disk, a missing setting is replaced by a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="flightlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> str:
    """The new folder in the shared one that ``df`` was written to."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, tag))


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a materialised frame that nothing reads any more."""
    spark = df.sparkSession
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _forest(batches):
    """Per partition: replace its edges by stars to the smallest member of each local component."""
    import pandas as pd

    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def stars():
        rows = [(x, r) for x in parent if (r := find(x)) != x]
        return pd.DataFrame(rows, columns=["u", "v"], dtype="int64")

    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 300_000:  # memory stays bounded; what was joined so far is passed on
            yield stars()
            parent.clear()
    yield stars()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (u long, v long) as (node, component = smallest member).

    Alternating large-star and small-star rounds, until no node is tied twice and none that is tied has others tied to it; each
    partition first contracts its own edges to stars, so a chain of any length inside one partition takes no round.  Every
    round is written to the shared checkpoint folder.  Minima are pre-aggregated before the shuffle and hubs are met only
    in equi-joins, which Spark can split.  Nodes without an edge do not appear.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    e = materialize(e.mapInPandas(_forest, "u long, v long").distinct(), "cc")
    for _ in range(max_rounds):
        ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("s")).select("s.*")
        open_ = ends.groupBy("x").agg(F.sum("up").alias("up"), F.count("*").alias("all")).where("up > 1 OR (up = 1 AND all > 1)")
        if not open_.limit(1).count():
            break
        # large star: every larger neighbour of x is tied to the smallest of x and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour of x, and x, are tied to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = small.unionByName(low.select("u", F.col("m").alias("v")))
        new = new.where("u <> v").mapInPandas(_forest, "u long, v long").distinct()
        old, e = e, materialize(new, "cc")
        drop_written(old)
    else:
        raise RuntimeError("components did not settle")
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
