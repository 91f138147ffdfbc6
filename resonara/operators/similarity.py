"""Pairs of files inside a block that match by name, fingerprint or correlation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resonara.functions import waves
from resonara.operators.ranking import group_rank

BLOCK = ["keyword", "block_key", "chunk_no"]


def block_of(blocked: DataFrame) -> list[str]:
    """What tells blocks apart: files with a path meet inside their chart only."""
    return ["path", *BLOCK] if "path" in blocked.columns else BLOCK


def pairs(rows: DataFrame, left: str, right: str, keys: list[str]) -> DataFrame:
    """Self-join of rows on ``keys``, null keys meeting, with every pair once: ``left`` before ``right`` in ``rank``."""
    a, b = rows.alias(left), rows.alias(right)
    met = F.lit(True)
    for k in keys:
        met = met & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return a.join(b, met & (F.col(f"{left}.rank") < F.col(f"{right}.rank")))


def candidates(blocked: DataFrame) -> DataFrame:
    """Pairs a, b of a block and run, a before b by RMS and number, whose RMS lies in a's band."""
    keys = block_of(blocked)
    ranked = group_rank(blocked, keys, ["rms", "num_int"], "rank")
    return pairs(ranked, "a", "b", keys).filter(F.col("b.rms") <= waves.rms_band(F.col("a.rms"))["high"])


def matching(blocked: DataFrame, threshold: float) -> DataFrame:
    """num_a, num_b, r and how (and path, if files have one) of candidate pairs that match; ``r`` is computed only where names and fingerprints differ.

    Sounds are normalised once, before the join, so that a pair costs a dot product.
    """
    ready = blocked.withColumn("unit", waves.normalized(F.col("sound.samples")[0])).withColumn("zero", waves.all_zero(F.col("unit")))
    same_name = F.col("a.name") == F.col("b.name")
    same_print = (F.col("a.fingerprint") != "") & (F.col("a.fingerprint") == F.col("b.fingerprint"))
    raw = waves.pearson(F.col("a.sound.samples")[0], F.col("b.sound.samples")[0])
    r = F.when(same_name | same_print, F.lit(None).cast("double")).when(~waves.same_format(F.col("a.sound"), F.col("b.sound")), 0.0).when(F.col("a.zero") & F.col("b.zero"), raw).when(F.col("a.zero") | F.col("b.zero"), 0.0).otherwise(waves.pearson_of_normalized(F.col("a.unit"), F.col("b.unit")))
    path = [F.col("a.path").alias("path")] if "path" in blocked.columns else []
    scored = candidates(ready).select(*path, F.col("a.num_int").alias("num_a"), F.col("b.num_int").alias("num_b"), r.alias("r"), F.when(same_name, "name").when(same_print, "fingerprint").alias("how"))
    return scored.withColumn("how", F.when(F.col("how").isNotNull(), F.col("how")).when(waves.matches(F.col("r"), threshold), "correlation")).filter(F.col("how").isNotNull())


def exact_pairs(rows: DataFrame, keys: list[str], name: str = "name", print_: str = "fingerprint") -> DataFrame:
    """id_a, id_b and by_name of pairs with equal keys and an equal name, or an equal fingerprint that isn't empty; rows have rank.

    Each of the two ways is an equi-join of its own, so only rows that match meet.
    """
    ids = [F.col("a.rank").alias("id_a"), F.col("b.rank").alias("id_b")]
    named = pairs(rows, "a", "b", [*keys, name]).select(*ids, F.lit(True).alias("by_name"))
    printed = pairs(rows.filter(F.col(print_) != ""), "a", "b", [*keys, print_]).filter(~F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}")))
    return named.union(printed.select(*ids, F.lit(False).alias("by_name")))


#: Vectors of a tile: a task multiplies two tiles, so it holds two times so many vectors and the square of products.
TILE = 1024


def correlated_within(vectors: DataFrame, key: str, id_column: str, vector: str, least: float, tile: int = TILE) -> DataFrame:
    """key, id_a, id_b and r of pairs with an equal key, ``id_a`` below ``id_b``, and a Pearson correlation of at least ``least``.

    Vectors are normalised once and dealt by hash into tiles of their key, as
    many as its count asks for; each pair of tiles is one matrix product.  So a
    key of any size is spread over many tasks, and a vector is sent once for
    each tile of its key.  Products are in double precision; pairs of unequal
    length or with a null vector correlate with nothing.
    """
    unit = vectors.select(F.col(key).alias("_key"), F.col(id_column).alias("_id"), waves.normalized(F.col(vector)).alias("_unit")).filter("_unit is not null and size(_unit) > 0")
    sizes = unit.groupBy("_key").agg(F.ceil(F.count("*") / tile).alias("_tiles"))
    met = unit.join(sizes, unit["_key"].eqNullSafe(sizes["_key"])).drop(sizes["_key"])
    own = F.pmod(F.xxhash64("_id", "_unit"), F.col("_tiles")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("_tiles").cast("int") - 1), lambda t: F.struct(F.least(t, F.col("_own")).alias("_low"), F.greatest(t, F.col("_own")).alias("_high")))
    dealt = met.withColumn("_own", own).withColumn("_pair", F.explode(others)).select("_key", "_id", "_unit", "_own", "_pair._low", "_pair._high")
    kinds = [vectors.schema[c].dataType.simpleString() for c in (key, id_column)]

    def multiply(group: pd.DataFrame) -> pd.DataFrame:
        low, high = group["_low"].iloc[0], group["_high"].iloc[0]
        found = []
        for _, rows in group.groupby(group["_unit"].map(len)):
            a, b = rows[rows["_own"] == low], rows[rows["_own"] == high]
            if not len(a) or not len(b):
                continue
            r = np.clip(np.stack(a["_unit"]) @ np.stack(b["_unit"]).T, -1, 1)
            i, j = np.nonzero(r >= least)
            x, y, r = a["_id"].to_numpy()[i], b["_id"].to_numpy()[j], r[i, j]
            stays = x < y if low == high else x != y
            found.append(pd.DataFrame({"a": np.minimum(x, y)[stays], "b": np.maximum(x, y)[stays], "r": r[stays]}))
        made = pd.concat(found, ignore_index=True) if found else pd.DataFrame({"a": [], "b": [], "r": []})
        own = group["_key"].iloc[0]
        own = None if pd.isna(own) else own
        return pd.DataFrame({key: pd.Series([own] * len(made), dtype=object), "id_a": made["a"], "id_b": made["b"], "r": made["r"]})

    return dealt.groupBy("_key", "_low", "_high").applyInPandas(multiply, f"`{key}` {kinds[0]}, id_a {kinds[1]}, id_b {kinds[1]}, r double")
