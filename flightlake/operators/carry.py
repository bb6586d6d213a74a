"""Recursions over the rows of a key: a state is carried along its rows, which arrive in slices of bounded size.

Rows are dealt by key and sorted in their partition, so a task holds one Arrow batch and one state, however many
rows a key has (what the sort and the window keep of them spills).
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Column that numbers the rows of a key; it is there to have them in order.
PLACE = "_place"


def carried(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], Callable], schema: str) -> DataFrame:
    """Rows of ``schema`` that fresh functions from ``start`` give for the rows of each key, in ``order``.

    A function takes a pandas frame, the next rows of its key, and returns a frame; null keys are a key of their own.
    """

    def run(batches):
        import numpy as np
        import pandas as pd

        last, step = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf.drop(columns=PLACE)
            rows = [tuple(None if pd.isna(x) else x for x in r) for r in pdf[keys].drop_duplicates(ignore_index=True).itertuples(index=False)]
            code = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(pdf)]
            out = []
            for key, a, b in zip(rows, cuts, cuts[1:]):
                if step is None or key != last:
                    last, step = key, start()
                out.append(step(pdf.iloc[a:b]))
            yield pd.concat(out, ignore_index=True) if len(out) > 1 else out[0]

    # a window asks for rows dealt by the keys and sorted, and takes them as they lie where they are so already
    ready = df.withColumn(PLACE, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ready.mapInPandas(run, schema)


def schema_with(df: DataFrame, more: dict[str, str]) -> str:
    """The columns of ``df`` and further ones, as a schema text."""
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in more), *(f"`{n}` {k}" for n, k in more.items())])


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the folder in spark.checkpoint.dir: rounds of a loop read it instead of one another.

    Only in local mode, where all tasks share the machine's disk, a missing setting is replaced by a temporary folder.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(base or tempfile.mkdtemp(prefix="flightlake-"))
    return df.checkpoint()
