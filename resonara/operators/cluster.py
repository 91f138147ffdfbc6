"""Representatives of matching files.

The production rule is a greedy sweep in RMS order whose result depends on that
order and on identifiers: it isn't the transitive closure.  It runs inside a
run of at most CHUNK files of a block, so a task's memory is bounded by the
samples of one run.

``replace_to`` is what the sweep leaves (one hop); ``root`` is where following
it ends.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resonara.functions import waves
from resonara.operators.ranking import checkpointed
from resonara.operators.similarity import block_of

MODES = ("production", "simulate", "components")
SWEEP_COLUMNS = ["idx", "num_int", "rms", "name", "fingerprint", "sound"]


def find_root(slots: dict[int, int], number: int) -> int:
    """Where ``number`` ends when replacements are followed; an unset slot is its own end."""
    while slots.get(number, 0) not in (0, number):
        number = slots[number]
    return number


def join_roots(slots: dict[int, int], a: int, b: int) -> None:
    """Make the smaller of two ends the replacement of the larger."""
    low, high = sorted((find_root(slots, a), find_root(slots, b)))
    if low != high:
        slots[high] = low


def band_top(rms: float) -> float:
    return waves.QUIET_TO if rms < waves.QUIET else rms * waves.RMS_HIGH


def sweep(numbers: list[int], rms: list[float], linked, mode: str = "production", direct=None) -> dict[int, int]:
    """number -> replacement for files in (RMS, number) order.

    ``linked(i, j)`` says whether two files match, ``direct(i, j)`` whether they
    do by name or fingerprint; 'simulate' replaces those by the leader itself.
    """
    slots = dict.fromkeys(numbers, 0)
    if mode == "components":
        slots = {n: n for n in numbers}
        for i, a in enumerate(numbers):
            for j in range(i + 1, len(numbers)):
                if rms[j] <= band_top(rms[i]) and linked(i, j):
                    join_roots(slots, a, numbers[j])
        return {n: find_root(slots, n) for n in numbers}
    for i, leader in enumerate(numbers):
        if slots[leader]:
            continue
        slots[leader] = leader
        for j in range(i + 1, len(numbers)):
            if rms[j] > band_top(rms[i]):
                break
            other = numbers[j]
            if slots[other] or not linked(i, j):
                continue
            if mode == "simulate" and direct is not None and direct(i, j):
                slots[other] = leader
            else:
                join_roots(slots, leader, other)
    return slots


def _raw_pearson(x: np.ndarray, y: np.ndarray) -> float:
    n = len(x)
    if n == 0 or n != len(y):
        return 0.0
    if n < 4 and np.all(np.abs(x - y) <= 1e-6):
        return 1.0
    vx, vy = (x * x).sum() - x.sum() ** 2 / n, (y * y).sum() - y.sum() ** 2 / n
    if vx < waves.TINY and vy < waves.TINY:
        return 1.0 if abs(x.mean() - y.mean()) < 1e-6 else 0.0
    if vx < waves.TINY or vy < waves.TINY:
        return 0.0
    return float(np.clip(((x * y).sum() - x.sum() * y.sum() / n) / np.sqrt(vx * vy), -1, 1))


def correlations(sounds: list[dict]) -> np.ndarray:
    """Correlation of every pair of sounds, by one matrix product for each format; 0 across formats."""
    first = [np.asarray(s["samples"][0], np.float64) for s in sounds]
    out = np.zeros((len(sounds), len(sounds)))
    formats: dict[tuple, list[int]] = {}
    for k, s in enumerate(sounds):
        formats.setdefault((s["sample_rate"], s["channels"], s["bits_per_sample"], len(first[k])), []).append(k)
    for (*_, size), own in formats.items():
        if not size:
            continue
        unit = np.stack([first[k] for k in own])
        unit = unit - unit.mean(1, keepdims=True)
        norm = np.sqrt((unit * unit).sum(1, keepdims=True))
        unit = np.where(norm < waves.TINY, 0.0, unit / np.where(norm < waves.TINY, 1.0, norm))
        r = np.clip(unit @ unit.T, -1, 1)
        zero = ~(np.abs(unit) > waves.NEAR_ZERO).any(1)
        r[zero[:, None] ^ zero[None, :]] = 0.0
        for a in np.flatnonzero(zero):
            for b in np.flatnonzero(zero):
                r[a, b] = _raw_pearson(first[own[a]], first[own[b]])
        out[np.ix_(own, own)] = r
    return out


def _prepared(group: pd.DataFrame):
    """The files of a run in sweep order, one for each number (the first in list order), with their tests for a match."""
    rows = group.sort_values("idx").drop_duplicates("num_int").sort_values(["rms", "num_int"])
    r = correlations(list(rows["sound"]))
    names, prints = rows["name"].tolist(), rows["fingerprint"].tolist()
    direct = lambda i, j: names[i] == names[j] or bool(prints[i]) and prints[i] == prints[j]
    return rows["num_int"].tolist(), rows["rms"].tolist(), r, direct


def _of_run(blocked: DataFrame) -> tuple[list[str], str, list[str]]:
    """Keys of a run, and the columns (schema, names) that name its chart in a result."""
    keys = block_of(blocked)
    return keys, f"path {blocked.schema['path'].dataType.simpleString()}, " if "path" in keys else "", keys[: keys.index("keyword")]


def assign(blocked: DataFrame, threshold: float | str, mode: str = "production") -> DataFrame:
    """num_int, replace_to and root of every blocked file, with its path if it has one (see ``blocking.blocked``; needs sound and fingerprint).

    A threshold given as a name is a column with the threshold of each file's chart.
    """
    if mode not in MODES:
        raise ValueError(mode)
    keys, schema, chart = _of_run(blocked)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        numbers, rms, r, direct = _prepared(group)
        least = group[threshold].iloc[0] if isinstance(threshold, str) else threshold
        slots = sweep(numbers, rms, lambda i, j: direct(i, j) or r[i, j] >= least, mode, direct)
        own = {c: group[c].iloc[0] for c in chart}
        return pd.DataFrame({**own, "num_int": numbers, "replace_to": [slots[n] for n in numbers], "root": [find_root(slots, n) for n in numbers]})

    return blocked.groupBy(*keys).applyInPandas(run, f"{schema}num_int int, replace_to int, root int")


def unique_counts(blocked: DataFrame, thresholds: list[float], mode: str = "simulate") -> DataFrame:
    """threshold and file_count, the number of roots that stand for themselves; for each path if files have one.

    Correlations don't depend on the threshold: each run is correlated once and
    swept for every threshold.
    """
    keys, schema, chart = _of_run(blocked)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        numbers, rms, r, direct = _prepared(group)
        counts = []
        for t in thresholds:
            slots = sweep(numbers, rms, lambda i, j, t=t: direct(i, j) or r[i, j] >= t, mode, direct)
            counts.append(sum(find_root(slots, n) == n for n in numbers))
        own = {c: group[c].iloc[0] for c in chart}
        return pd.DataFrame({**own, "threshold": np.array(thresholds, np.float64), "n": counts})

    by_run = blocked.groupBy(*keys).applyInPandas(run, f"{schema}threshold double, n long")
    return by_run.groupBy(*chart, "threshold").agg(F.sum("n").alias("file_count"))


def roots(replaces: DataFrame) -> DataFrame:
    """num_int, replace_to and root (and path, if there is one) of a replacement table, by doubling hops until none changes.

    0 and missing replacements end at the number itself.
    """
    own = ["path"] if "path" in replaces.columns else []
    table = replaces.select(*own, "num_int", "replace_to", F.when(F.coalesce("replace_to", F.lit(0)) == 0, F.col("num_int")).otherwise(F.col("replace_to")).alias("root"))
    table = checkpointed(table)
    while True:
        onward = table.select(*own, F.col("root").alias("_next"), F.col("num_int").alias("_at"))
        met = table.withColumn("_at", F.col("root")).join(onward, [*own, "_at"], "left")
        far = F.coalesce("_next", "root")
        moved = checkpointed(met.select(*own, "num_int", "replace_to", far.alias("root"), (far != F.col("root")).alias("_moved")))
        table = moved.drop("_moved")
        if moved.filter("_moved").isEmpty():
            return table
