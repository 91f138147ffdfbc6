"""Positions inside groups."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def checkpointed(rows: DataFrame) -> DataFrame:
    """``rows`` written to the checkpoint folder and read from there.

    The folder is the session's ``spark.checkpoint.dir`` or the context's; a
    temporary one is made only where neither is set and Spark runs in this process.
    """
    session = rows.sparkSession
    context = session.sparkContext
    if not context.getCheckpointDir():
        folder = session.conf.get("spark.checkpoint.dir", "") or ""
        if not folder:
            if not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="resonara-")
        context.setCheckpointDir(folder)
    return rows.checkpoint()


def group_rank(rows: DataFrame, keys: list[str], order: list[str], into: str) -> DataFrame:
    """``rows`` with their position, from 1, in the order of their group.

    A group is sorted in one task.  Groups here lie inside a chart, which has
    at most 3,844 identifiers and some thousands of lines.
    """
    return rows.withColumn(into, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
