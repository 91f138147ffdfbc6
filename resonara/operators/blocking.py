"""Blocking: which files are compared at all.

Files (idx, num_int, name, file_size, rms, and whatever else) meet only inside a
block of equal size and RMS step, and there only inside runs of CHUNK files in
list order; files in different runs are never compared.  Files with a path are
blocked inside their chart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resonara.functions import ids, text, waves
from resonara.operators.ranking import group_rank

CHUNK = 100


def processing_range(files: DataFrame, start: int, end: int) -> DataFrame:
    """start_point and end_point: one row, or one for each path if files have one.

    The start is at least the first file's number, the end at most the largest;
    0 or less asks for all.  The last identifier of the space is never processed.
    """
    first, last = F.coalesce(F.min_by("num_int", "idx"), F.lit(1)), F.greatest(F.coalesce(F.max("num_int"), F.lit(1)), F.lit(1))
    wanted = F.lit(end) if end > 0 else last
    by = files.groupBy("path") if "path" in files.columns else files.groupBy()
    return by.agg(F.greatest(first, F.lit(max(start, 1))).alias("start_point"), F.least(last, F.least(wanted, F.lit(ids.PROCESSED_TO))).alias("end_point"))


def in_range(files: DataFrame, start: int, end: int) -> DataFrame:
    return files.filter(F.col("num_int").between(start, end))


def keyword_of(name: Column, keywords: list[str]) -> Column:
    """The first keyword that a file's stem contains, whatever the case; null if none."""
    stem = F.lower(text.stem(name))
    return F.get(F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: stem.contains(F.lower(k))), 0)


def block_key(file_size: Column, rms: Column) -> Column:
    return F.concat_ws("_", file_size, waves.rms_step(rms))


def blocked(files: DataFrame, start: int | None = None, end: int | None = None, keywords: list[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """Files that are compared, with keyword (null without keywords), block_key and chunk_no.

    Files out of range, without a sound (null rms) or, with keywords, without a
    matching one drop out.
    """
    kept = files if start is None else in_range(files, start, end)
    kept = kept.filter(F.col("rms").isNotNull()).withColumn("block_key", block_key(F.col("file_size"), F.col("rms")))
    word = keyword_of(F.col("name"), keywords) if keywords else F.lit(None).cast("string")
    kept = kept.withColumn("keyword", word)
    if keywords:
        kept = kept.filter(F.col("keyword").isNotNull())
    return numbered_runs(kept, chunk)


def numbered_runs(kept: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Files with keyword and block_key, and the run of ``chunk`` files of their block (of their chart, with a path) that they fall into."""
    keys = ["path"] if "path" in kept.columns else []
    placed = group_rank(kept, [*keys, "keyword", "block_key"], ["idx"], "_place")
    return placed.withColumn("chunk_no", F.floor((F.col("_place") - 1) / chunk)).drop("_place")


def keyword_totals(files: DataFrame, start: int, end: int, keywords: list[str]) -> DataFrame:
    """One row: files in and out of range, without a sound, matching no keyword, and matching one."""
    inside = F.col("num_int").between(start, end)
    loaded = F.col("rms").isNotNull()
    found = keyword_of(F.col("name"), keywords).isNotNull()
    return files.agg(
        F.count_if(inside).alias("in_range"),
        F.count_if(~inside).alias("out_of_range"),
        F.count_if(inside & ~loaded).alias("no_sound"),
        F.count_if(inside & loaded & ~found).alias("no_keyword"),
        F.count_if(inside & loaded & found).alias("matched"),
    )
