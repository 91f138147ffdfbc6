"""Statistics of a reduction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reduction_statistics(files: DataFrame, replaces: DataFrame, start: int, end: int, by_path: bool = False) -> DataFrame:
    """Over the files in range: total, unique, replaced, not_processed, processed and percent replaced; one row, or one for each path.

    With paths on both sides, a chart's files meet its own replacements.

    Files whose replacement is 0 or missing weren't processed; they aren't unique either.
    """
    keys = [c for c in ("path", "num_int") if c in files.columns and c in replaces.columns]
    met = files.filter(F.col("num_int").between(start, end)).join(replaces.select(*keys, "replace_to"), keys, "left")
    to = F.coalesce("replace_to", F.lit(0))
    unique, moved = F.count_if(to == F.col("num_int")), F.count_if((to > 0) & (to != F.col("num_int")))
    return met.groupBy(*["path"] * by_path).agg(
        F.count("*").alias("total"),
        unique.alias("unique_files"),
        moved.alias("replaced"),
        F.count_if((to <= 0) & (to != F.col("num_int"))).alias("not_processed"),
        (unique + moved).alias("processed"),
        F.coalesce(F.try_divide(moved * 100.0, F.count("*")), F.lit(0.0)).alias("reduction_percent"),
    )


def reduction_rate(original: int, optimized: int) -> float:
    """Share of files saved; another figure than the percentage above, whose numerator is the replaced files."""
    return (original - optimized) / original if original else 0.0
