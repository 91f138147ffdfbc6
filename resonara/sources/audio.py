"""Sounds from RIFF/WAVE and AIFF files, and from arrays.

Decoding is the one step that Spark has no expression for: an Arrow function
reads WAVE (PCM of 8, 16, 24 or 32 bits, floats of 32 or 64 bits, A-law and
mu-law) and AIFF or AIFF-C (PCM of both byte orders, floats, A-law and mu-law).
Loading never aborts: a file that can't be decoded has a null sound and an
error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resonara.functions import waves

SOUND = "struct<sample_rate:int,channels:int,bits_per_sample:int,samples:array<array<float>>>"


#: Bytes of samples after which an Arrow batch of sounds ends: a task holds a few times so much, or one sound.
BATCH_BYTES = 64 << 20


def _law(code: np.ndarray, mu: bool) -> np.ndarray:
    """Samples of companded bytes: a sign, three bits of exponent and four of mantissa."""
    bits = (~code if mu else code ^ 0x55).astype(np.int32) & 0xFF
    exponent, mantissa = bits >> 4 & 7, bits & 15
    if mu:
        level = ((mantissa << 3) + 0x84 << exponent) - 0x84
        negative = bits & 0x80 != 0
    else:
        level = np.where(exponent == 0, (mantissa << 4) + 8, (mantissa << 4) + 0x108 << np.maximum(exponent - 1, 0))
        negative = bits & 0x80 == 0
    return (np.where(negative, -level, level) / 32768).astype(np.float32)


def samples_of(data: bytes, kind: str, bits: int, order: str = "<") -> np.ndarray:
    """Samples from -1 to 1 of ``kind`` 'pcm', 'unsigned', 'float', 'alaw' or 'ulaw'; whole samples only."""
    if kind in ("alaw", "ulaw"):
        return _law(np.frombuffer(data, np.uint8), kind == "ulaw")
    if kind == "float" and bits in (32, 64):
        return np.frombuffer(data, f"{order}f{bits // 8}").astype(np.float32)
    if kind == "unsigned" and bits == 8:
        return (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    if kind == "pcm" and bits == 24:
        parts = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)[:, :: 1 if order == "<" else -1]
        whole = parts[:, 0] | parts[:, 1] << 8 | parts[:, 2] << 16
        return ((whole ^ 0x800000) - 0x800000).astype(np.float32) / (1 << 23)
    if kind == "pcm" and bits in (8, 16, 32):
        return (np.frombuffer(data, f"{order}i{bits // 8}") / float(1 << (bits - 1))).astype(np.float32)
    raise ValueError(f"{kind} with {bits} bits isn't supported")


def _chunks(content: bytes, order: str) -> dict[bytes, bytes]:
    """Chunks of a RIFF or IFF file by name; a short last one counts as far as it goes, and of equal names the last."""
    at, found = 12, {}
    while at + 8 <= len(content):
        size = struct.unpack_from(f"{order}I", content, at + 4)[0]
        found[content[at : at + 4]] = content[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return found


def _extended(ten: bytes) -> int:
    """A rate from its 80-bit float."""
    exponent, mantissa = struct.unpack(">HQ", ten)
    return int(mantissa * 2.0 ** ((exponent & 0x7FFF) - 16383 - 63))


# Format codes of WAVE and compression types of AIFF-C.
WAVE_KINDS = {1: "pcm", 3: "float", 6: "alaw", 7: "ulaw"}
AIFF_KINDS = {b"NONE": ("pcm", ">"), b"twos": ("pcm", ">"), b"sowt": ("pcm", "<"), b"fl32": ("float", ">"), b"FL32": ("float", ">"), b"fl64": ("float", ">"), b"FL64": ("float", ">"), b"alaw": ("alaw", ">"), b"ALAW": ("alaw", ">"), b"ulaw": ("ulaw", ">"), b"ULAW": ("ulaw", ">")}


def decode_sound(content: bytes) -> dict:
    """sample_rate, channels, bits_per_sample and samples of a WAVE or AIFF file; ValueError if it is none or has no samples."""
    if content[:4] == b"RIFF" and content[8:12] == b"WAVE":
        parts = _chunks(content, "<")
        kind, data = parts.get(b"fmt ", b""), parts.get(b"data")
        if len(kind) < 16 or data is None:
            raise ValueError("no format or no data")
        code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", kind)
        if code == 0xFFFE and len(kind) >= 26:
            code = struct.unpack_from("<H", kind, 24)[0]
        name, order = WAVE_KINDS.get(code, f"format {code}"), "<"
        name = "unsigned" if name == "pcm" and bits == 8 else name
    elif content[:4] == b"FORM" and content[8:12] in (b"AIFF", b"AIFC"):
        parts = _chunks(content, ">")
        kind, data = parts.get(b"COMM", b""), parts.get(b"SSND")
        if len(kind) < 18 or data is None:
            raise ValueError("no format or no data")
        channels, _, bits = struct.unpack_from(">HIH", kind)
        rate, packed = _extended(kind[8:18]), kind[18:22] if content[8:12] == b"AIFC" else b"NONE"
        name, order = AIFF_KINDS.get(packed, (f"compression {packed!r}", ">"))
        bits = {b"fl32": 32, b"FL32": 32, b"fl64": 64, b"FL64": 64}.get(packed, 8 * -(-bits // 8))
        data = data[8 + struct.unpack_from(">I", data)[0] :] if len(data) >= 8 else b""
    else:
        raise ValueError("not a RIFF/WAVE or AIFF file")
    width = 1 if name in ("alaw", "ulaw") else bits // 8
    data = data[: len(data) // (width * channels) * width * channels] if width and channels else b""
    if not data:
        raise ValueError("no samples")
    flat = samples_of(data, name, bits, order)
    return {"sample_rate": rate, "channels": channels, "bits_per_sample": bits, "samples": list(flat.reshape(-1, channels).T)}


def _sounds(rows: list[dict | None]) -> pa.Array:
    """Decoded sounds as an Arrow column; samples go over as arrays, not as lists of numbers."""
    there = [r for r in rows if r is not None]
    channels = [c for r in there for c in r["samples"]]
    flat = pa.array(np.concatenate(channels) if channels else np.empty(0, np.float32), pa.float32())
    inner = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(c) for c in channels])], pa.int32()), flat)
    outer = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(r["samples"]) for r in there])], pa.int32()), inner)
    names = ["sample_rate", "channels", "bits_per_sample"]
    made = pa.StructArray.from_arrays([*[pa.array([r[k] for r in there], pa.int32()) for k in names], outer], [*names, "samples"])
    at = np.cumsum([r is not None for r in rows]) - 1
    return made.take(pa.array([int(k) if r is not None else None for k, r in zip(at, rows, strict=True)], pa.int64()))


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sounds, errors, first, held = [], [], 0, 0
        for k in range(batch.num_rows):
            content = batch.column(2)[k].as_py()
            try:
                sounds.append(decode_sound(content or b""))
                errors.append(None)
                held += 4 * sum(map(len, sounds[-1]["samples"]))
            except (ValueError, struct.error) as wrong:
                sounds.append(None)
                errors.append(str(wrong))
            if held > BATCH_BYTES or k == batch.num_rows - 1:
                own = batch.slice(first, k + 1 - first)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), _sounds(sounds), pa.array(errors, pa.string())], ["path", "file_size", "sound", "error"])
                sounds, errors, first, held = [], [], k + 1, 0


def decoded(files: DataFrame) -> DataFrame:
    """path, file_size, sound and error of sound files given as rows of path, length and content.

    Spark ends the batches that it sends by bytes (``spark.sql.execution.arrow.maxBytesPerBatch``, 64 MB at first).
    """
    return files.select("path", "length", "content").mapInArrow(_decoded, f"path string, file_size long, sound {SOUND}, error string")


def load(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, file_size, sound and error of sound files."""
    return decoded(spark.read.format("binaryFile").load(paths))


def load_missing_too(wanted: DataFrame, loaded: DataFrame) -> DataFrame:
    """One row of ``wanted`` (path) each, with a null sound and an error where ``loaded`` hasn't its file."""
    met = wanted.join(loaded, "path", "left")
    return met.withColumn("error", F.when(F.col("file_size").isNull(), "missing").otherwise(F.col("error")))


def of_arrays(rows: DataFrame, samples: str, rate: int = 44100, bits: int = 16) -> DataFrame:
    """``rows`` with a sound made of a column of channels; an empty one is an error."""
    channels = F.when(F.size(samples) > 0, F.col(samples)).otherwise(F.raise_error(F.lit("no samples")))
    return rows.withColumn("sound", F.struct(F.lit(rate).alias("sample_rate"), F.size(channels).alias("channels"), F.lit(bits).alias("bits_per_sample"), channels.alias("samples")))


def with_features(sounds: DataFrame, mode: str = "none") -> DataFrame:
    """Sounds with rms, normalized (first channel), start_silence and memory_mb; null where the sound is."""
    kept = F.when(F.col("sound").isNotNull(), waves.by_mode(F.col("sound.samples"), mode))
    made = sounds.withColumn("sound", F.when(F.col("sound").isNotNull(), F.struct("sound.sample_rate", "sound.channels", "sound.bits_per_sample", kept.alias("samples"))))
    samples = F.col("sound.samples")
    return made.withColumns({"rms": waves.rms(samples), "normalized": waves.normalized(samples[0]), "start_silence": waves.leading_silence(samples), "memory_mb": waves.megabytes(samples, samples)})


def load_statistics(loaded: DataFrame) -> DataFrame:
    """One row: processed, ok, failed, total megabytes, success in percent and whether it is worth a warning."""
    ok = F.count_if(F.col("sound").isNotNull())
    rate = F.coalesce(F.try_divide(ok * 100.0, F.count("*")), F.lit(0.0))
    return loaded.agg(F.count("*").alias("processed"), ok.alias("ok"), F.count_if(F.col("sound").isNull()).alias("failed"), F.coalesce(F.sum("memory_mb"), F.lit(0.0)).alias("megabytes"), rate.alias("success_percent"), (rate < 90).alias("warn"))


def numbered(listing: DataFrame, start: int, end: int) -> DataFrame:
    """Existing files (idx, path, exists) with new identifiers from ``start`` on, as far as ``end``; 0 ends with the last file.

    Files are numbered over their order, so this is one sorted sequence; with an
    ``end``, only the rows up to it are gathered.
    """
    from pyspark.sql import Window

    there = listing.filter("exists")
    there = there.orderBy("idx").limit(max(end - start + 1, 0)) if end else there
    return there.withColumn("num_int", F.row_number().over(Window.orderBy("idx")) + start - 1)
