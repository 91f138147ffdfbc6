"""Whole runs: load, find the best threshold, reduce and rewrite."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resonara.functions import ids, text, waves
from resonara.operators import blocking, cluster, facets, rewrite, stats, sweep
from resonara.operators.ranking import checkpointed
from resonara.sources import audio, charts, sinks


def load_chart(spark: SparkSession, chart: str | list[str], folder: str) -> tuple[DataFrame, DataFrame]:
    """Files of a chart, or of several, with instruments, and the names that have no file."""
    listing = spark.read.format("binaryFile").load(folder).select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), "length")
    lines = charts.read(spark, chart).withColumn("path", F.regexp_replace("path", "^file:(//)?", ""))
    files, missing = charts.file_list(charts.definitions(lines), listing)
    return facets.detect(files), missing


def with_sounds(files: DataFrame, sounds: DataFrame) -> DataFrame:
    """Files with what clustering needs; ``sounds`` has path and sound."""
    made = files.join(sounds.select(F.col("path").alias("name"), "sound"), "name", "left")  # a file that several charts define is decoded once
    return made.withColumns({"rms": waves.rms(F.col("sound.samples")), "fingerprint": F.lit("")})


def find_optimum(files: DataFrame, least: float = 0.0, most: float = 1.0, step: float = 0.01) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sweep's points, the thresholds to take, and a warning for each chart with failed loads; files have path and sound (null if it failed)."""
    loaded, failed = files.filter(F.col("sound").isNotNull()), files.filter(F.col("sound").isNull())
    points = checkpointed(sweep.simulate(blocking.blocked(loaded), failed, sweep.thresholds(least, most, step)))
    count, first = F.col("failed"), text.file_name(F.col("first"))
    said = F.when(count == 1, F.concat(F.lit("1 sound couldn't be loaded and was left out: "), first)).otherwise(F.concat(count.cast("string"), F.lit(" sounds couldn't be loaded and were left out")))
    warnings = failed.groupBy("path").agg(F.count("*").alias("failed"), F.min_by("name", "idx").alias("first")).select("path", "failed", said.alias("warning"))
    return points, sweep.optimum(points), warnings


@dataclass
class Reduction:
    """What a reduction did; ``error`` is set where it couldn't."""

    lines: DataFrame | None = None
    statistics: dict | None = None
    unused: DataFrame | None = None
    error: str | None = None


def reduce_chart(lines: DataFrame, files: DataFrame, threshold: float, start: int = 1, end: int = 0, keywords: list[str] | None = None, mode: str = "production") -> Reduction:
    """New lines of a chart, statistics and unused files.

    Files have path, idx, num, num_int, name, file_size, sound, rms and
    fingerprint.  One chart's files are at most a few thousand rows, so its
    range and counts are read on the driver.
    """
    if not 0 <= threshold <= 1:
        return Reduction(error="threshold out of range")
    bounds = blocking.processing_range(files, start, end).first()
    if bounds is None or bounds["start_point"] > bounds["end_point"]:
        return Reduction(error="nothing in range")
    first, last = bounds["start_point"], bounds["end_point"]
    blocked = blocking.blocked(files, first, last, keywords)
    replaces = cluster.assign(blocked, threshold, mode).groupBy("path", "num_int").agg(F.min("replace_to").alias("replace_to"))
    replaces = checkpointed(replaces)
    stay = rewrite.kept(files, replaces, first, last)
    numbered = checkpointed(rewrite.renumbered(stay))
    mapping = rewrite.final_map(files, replaces, numbered, first, last)
    counted = stats.reduction_statistics(files, replaces, first, last).first().asDict()
    counted["rate"] = stats.reduction_rate(counted["total"], counted["unique_files"])
    return Reduction(rewrite.rewritten(lines, mapping, numbered), counted, rewrite.unused_files(files, stay))


def reduce_charts(lines: DataFrame, files: DataFrame, threshold: float | str, mode: str = "production") -> DataFrame:
    """path, line_no and line of any number of charts, whole, in one plan; each as ``reduce_chart`` gives it.

    Files meet inside their chart only, within its processing range.  A
    threshold given as a name is a column of ``files``.
    """
    bounds = blocking.processing_range(files, 1, 0)
    inside = files.join(bounds, "path").filter("num_int between start_point and end_point").drop("start_point", "end_point")
    found = cluster.assign(blocking.blocked(inside), threshold, mode)
    replaces = checkpointed(found.groupBy("path", "num_int").agg(F.min("replace_to").alias("replace_to")))
    first, last = 1, ids.PROCESSED_TO
    numbered = checkpointed(rewrite.renumbered(rewrite.kept(files, replaces, first, last)))
    return rewrite.rewritten(lines, rewrite.final_map(files, replaces, numbered, first, last), numbered)


def run_charts(spark: SparkSession, paths: str | list[str], folder: str, out: str, threshold: float | None = None) -> list[str]:
    """Load charts and their sounds, reduce each (at its own best base-36 threshold if none is given) and write them below ``out``."""
    files, _ = load_chart(spark, paths, folder)
    sounds = audio.load(spark, folder).withColumn("path", F.regexp_replace("path", "^file:(//)?", ""))
    ready = checkpointed(with_sounds(files, sounds))
    if threshold is None:
        best = find_optimum(ready)[1].select("path", F.col("base36.threshold").alias("threshold"))
        ready = ready.join(best, "path", "left").fillna({"threshold": sweep.NO_THRESHOLD})
    lines = charts.read(spark, paths).withColumn("path", F.regexp_replace("path", "^file:(//)?", ""))
    return sinks.write_charts(reduce_charts(lines, ready, "threshold" if threshold is None else threshold), out)


def run(spark: SparkSession, chart: str, folder: str, out: str, threshold: float | None = None, delete: bool = False) -> Reduction:
    """Load a chart and its sounds, reduce it (at its best base-36 threshold if none is given) and write it."""
    files, _ = load_chart(spark, chart, folder)
    sounds = audio.load(spark, folder).withColumn("path", F.regexp_replace("path", "^file:(//)?", ""))
    ready = checkpointed(with_sounds(files, sounds))
    if threshold is None:
        threshold = find_optimum(ready)[1].first()["base36"]["threshold"]
    lines = charts.read(spark, chart).withColumn("path", F.regexp_replace("path", "^file:(//)?", ""))
    done = reduce_chart(lines, ready, threshold)
    if done.lines is not None:
        sinks.write_chart(done.lines, out)
        sinks.delete_unused(done.unused, delete)
    return done


