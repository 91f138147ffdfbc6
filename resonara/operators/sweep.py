"""Thresholds: the grid, the counts over it, and which one to take."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from resonara.functions import ids
from resonara.operators import cluster

# Fixed value: what is taken when nothing was counted.
NO_THRESHOLD, NO_COUNT = 0.60, 0


def thresholds(least: float, most: float, step: float) -> list[float]:
    """From ``most`` down to ``least``, by subtracting in single precision and rounding to hundredths half to even."""
    out, value, low, by = [], np.float32(most), np.float32(least), np.float32(step)
    while value >= low:
        out.append(float(np.float32(round(float(value), 2))))
        value = np.float32(value - by)
    return out


def hundredths(spark: SparkSession) -> DataFrame:
    """The production grid: 1.00 down to 0.00 by hundredths."""
    return spark.range(101).select(((100 - F.col("id")) / 100).alias("threshold"))


def _chart(rows: DataFrame) -> list[str]:
    return ["path"] if "path" in rows.columns else []


def until_enough(points: DataFrame, limit: int = ids.LARGEST[36]) -> DataFrame:
    """Points (threshold, file_count; of each path, if there is one) from the highest threshold down to the first with at most ``limit`` files, that one too."""
    before = Window.partitionBy(*_chart(points)).orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, -1)
    hits = F.coalesce(F.sum(F.when(F.col("file_count") <= limit, 1).otherwise(0)).over(before), F.lit(0))
    return points.withColumn("_hits", hits).filter("_hits = 0").drop("_hits")


def best(limit: int) -> Column:
    """Aggregate of points: struct of threshold and file_count to take for ``limit`` identifiers.

    The highest threshold with 1 to ``limit`` files; else the fewest files, by
    the highest threshold; else a default.
    """
    point = F.struct(F.col("threshold"), F.col("file_count").cast("long").alias("file_count"))
    fits = F.col("file_count").between(1, limit)
    some = F.col("file_count") > 0
    return F.coalesce(
        F.max_by(F.when(fits, point), F.when(fits, F.col("threshold"))),
        F.min_by(F.when(some, point), F.when(some, F.struct(F.col("file_count"), -F.col("threshold")))),
        F.struct(F.lit(NO_THRESHOLD).alias("threshold"), F.lit(NO_COUNT).cast("long").alias("file_count")),
    )


def optimum(points: DataFrame) -> DataFrame:
    """The points to take for base 36 and base 62: one row, or one for each path.

    Base 62 falls back to base 36 where it has no count or a lower threshold.
    """
    both = points.groupBy(*_chart(points)).agg(best(ids.LARGEST[36]).alias("base36"), best(ids.LARGEST[62]).alias("base62"))
    worse = (F.col("base62.file_count") == 0) | (F.col("base62.threshold") < F.col("base36.threshold"))
    return both.withColumn("base62", F.when(worse, F.col("base36")).otherwise(F.col("base62")))


def simulate(blocked: DataFrame, unloaded: DataFrame, grid: list[float], early_stop: bool = True) -> DataFrame:
    """threshold and file_count over a grid, for each path if files have one; files without a sound (``unloaded``) count as unique.

    ``early_stop`` leaves out thresholds below the first that fits base 36.
    """
    spark, own = blocked.sparkSession, _chart(blocked)
    distinct = list(dict.fromkeys(grid))
    grid_rows = spark.createDataFrame([(t,) for t in distinct], "threshold double")
    counted = cluster.unique_counts(blocked, distinct)
    extra = unloaded.groupBy(*own).agg(F.count("*").alias("_extra"))
    total = (F.coalesce("file_count", F.lit(0)) + F.coalesce("_extra", F.lit(0))).alias("file_count")
    # The grid has a few hundred rows; each chart, or the one there is, gets all of them.
    if own:
        wanted = counted.select("path").union(extra.select("path")).distinct().crossJoin(F.broadcast(grid_rows))
        points = wanted.join(counted, ["path", "threshold"], "left").join(extra, "path", "left")
    else:
        points = grid_rows.join(counted, "threshold", "left").crossJoin(F.broadcast(extra))
    points = points.select(*own, "threshold", total)
    return until_enough(points) if early_stop else points
