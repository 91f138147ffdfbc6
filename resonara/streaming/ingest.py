"""Extension: incremental ingest, which batch runs have no counterpart of.

New vectors arrive as a stream; every micro-batch is matched against the
representatives stored so far and against itself, and new representatives are
appended.  The store is a Parquet folder; a batch is written under its own
number, so a repeated batch replaces itself and counts once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from resonara.functions import waves

SCHEMA = "vec_id long, label int, unit array<double>"
#: Representatives that a task holds at once.
TILE = 4096


def representatives(spark: SparkSession, store: str, before: int | None = None) -> DataFrame:
    """Stored representatives, of batches below ``before`` if given."""
    try:
        stored = spark.read.schema(f"{SCHEMA}, batch int").parquet(store)
    except Exception as missing:  # no batch has been written yet
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], SCHEMA)
    return (stored if before is None else stored.filter(F.col("batch") < before)).select("vec_id", "label", "unit")


def _matched(batch: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """vec_id of batch vectors that match a known representative of their label.

    Representatives are dealt into tiles of about TILE, as many as their label
    asks for, and a batch's vectors meet each tile as one matrix product; so a
    task holds one tile however large the store gets.
    """
    sizes = known.groupBy("label").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    tiled = known.join(sizes, "label").withColumn("tile", F.pmod(F.xxhash64("vec_id", "unit"), F.col("tiles")).cast("int")).select("label", "tile", "unit")
    sent = batch.join(sizes, "label").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("label", "tile", "vec_id", "unit")

    def meet(own: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        hit = np.zeros(len(own), bool)
        for size, rows in stored.groupby(stored["unit"].map(len)):
            fits = (own["unit"].map(len) == size).to_numpy()
            if size and fits.any():
                hit[fits] |= (np.stack(own["unit"][fits]) @ np.stack(rows["unit"]).T >= least).any(1)
        return pd.DataFrame({"vec_id": own["vec_id"][hit]})

    return sent.groupBy("label", "tile").cogroup(tiled.groupBy("label", "tile")).applyInPandas(meet, "vec_id long").distinct()


def new_representatives(batch: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """Vectors of a batch that match neither a known representative of their label nor one that the batch gave before.

    Inside the batch, vectors are taken by id: each becomes a representative
    unless it matches one, so every vector has a representative that it matches.
    The fresh vectors of a label are one group, which the batch's size bounds.
    """
    unit = batch.select("vec_id", "label", waves.normalized(F.col("embedding")).alias("unit")).filter("unit is not null")
    fresh = unit.join(_matched(unit, known, least), "vec_id", "left_anti")

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("vec_id")
        chosen: list[int] = []
        held: dict[int, list[np.ndarray]] = {}
        for k, vector in enumerate(rows["unit"]):
            same = held.setdefault(len(vector), [])
            if not same or not len(vector) or not (np.stack(same) @ vector >= least).any():
                same.append(vector)
                chosen.append(k)
        return rows.iloc[chosen][["vec_id", "label", "unit"]]

    return fresh.groupBy("label").applyInPandas(choose, SCHEMA)


def ingest(stream: DataFrame, store: str, checkpoint: str, least: float = 0.98) -> StreamingQuery:
    """Start the ingest of a stream of vec_id, label and embedding; it ends with the data at hand."""

    def run(batch: DataFrame, number: int) -> None:
        known = representatives(batch.sparkSession, store, number)
        new_representatives(batch, known, least).write.mode("overwrite").parquet(f"{store}/batch={number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
