"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text; a chunk ends where its top bits are
zero, at least MIN_BYTES after the last end.  Where MAX_BYTES go by without such
a place, the chunk ends at the least hash among them, the first of equal ones,
so that runs whose period has no end of its own get ends by content too.  The
hash sees the last WINDOW bytes alone, so chunk ends come back into step soon
after an insertion.  Chunks are deduplicated by a digest of 96 bits, at which
1e13 chunks have a false equality with a probability of about 1e-3: the
original stands in the document of lowest id, and the same chunk in any other
document is a duplicate.  Neighbouring duplicate chunks make a span; a span of
at least LEAST_CHARS characters is reported and can be cut out.

Digests meet with map-side least and greatest ids, so a passage that a third of
all documents share costs a task one row; digests of one document go no
further.  Chunks join the digests left, and adaptive execution splits hot keys
of that join.  Spans are gathered by text, whose chunks all lie in one row.

Defined results: a null or empty text has no chunk; rows of one id are versions
of one document, which aren't duplicates of each other but are compared with
others, and cut, each by itself; a passage repeated inside one text stays, as
it stands in no other document; rows without an id can't be ordered and are
left out; equal rows are reported once; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resonara.llm.common import mixed, small_batches, split_join, utf8

WINDOW = 16
MIN_BYTES, MAX_BYTES = 12, 128
#: A chunk ends where a hash is below this share of its range: 1 in 16 bytes.
ONE_IN = 16
LEAST_CHARS = 80

_GEAR = (mixed(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at every byte: sum of gear values of the last WINDOW bytes, each doubled for every byte since."""
    h = _GEAR[data]
    span = 1
    while span < WINDOW:
        older = h[:-span] << np.uint32(span)
        h = h.copy()
        h[span:] += older
        span *= 2
    return h


def chunk_ends(text: bytes) -> list[int]:
    """End of each chunk, the last being the length of the text; ends lie between characters."""
    size = len(text)
    if not size:
        return []
    data = np.frombuffer(text, np.uint8)
    hashes = gear(data)[:-1]
    starts = (data & 0xC0) != 0x80
    places = (np.flatnonzero((hashes < np.uint32((1 << 32) // ONE_IN)) & starts[1:]) + 1).tolist()
    ends, last = [], 0
    for place in [*places, size]:
        while place - last > MAX_BYTES:
            first = last + MIN_BYTES
            own = np.where(starts[first : last + MAX_BYTES + 1], hashes[first - 1 : last + MAX_BYTES], np.uint32(0xFFFFFFFF))
            last = first + int(own.argmin())
            ends.append(last)
        if place - last >= MIN_BYTES or place == size:
            ends.append(place)
            last = place
    if len(ends) > 1 and ends[-1] == ends[-2]:
        ends.pop()
    return ends


def chunks(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, text_hash and the chunks of each text in order: digest (d1, d2) and ``place``, the first code point times 2**20 plus the number of them."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            digests, places, sizes = [], [], []
            for t in utf8(batch.column(1)):
                cuts = chunk_ends(t)
                sizes.append(len(cuts))
                if cuts:
                    digests += [digest(t[a:z]) for a, z in zip([0, *cuts], cuts, strict=False)]
                    before = np.cumsum((np.frombuffer(t, np.uint8) & 0xC0) != 0x80)[np.array(cuts) - 1]
                    first = np.r_[0, before[:-1]]
                    places.append(first << 20 | before - first)
            offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32), pa.int32())
            whole = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            fields = {"d1": pa.array(whole[:, 0]), "d2": pa.array(whole[:, 1].astype(np.int32)), "place": pa.array(np.concatenate(places) if places else [], pa.int64())}
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(list(fields.values()), list(fields)))], ["id", "text_hash", "chunks"])

    return docs.mapInArrow(run, f"id {kind}, text_hash long, chunks array<struct<d1:long,d2:int,place:long>>")


def repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """id, text_hash, first_id, start and n_chars (code points) of every span whose chunks stand in documents of lower id.

    ``first_id`` is the lowest id of a document that has the span's first chunk.
    """
    one = chunks(docs, id_column, text).filter("id is not null").select("id", "text_hash", F.explode("chunks").alias("c")).select("id", "text_hash", "c.*")
    known = one.groupBy("d1", "d2").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    known = known.filter(F.col("first_id") < F.col("last_id")).drop("last_id")
    again = split_join(one, known, ["d1", "d2"]).filter(F.col("id") > F.col("first_id"))
    found = again.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("place", "first_id"))).alias("chunks"))
    kind = docs.schema[id_column].dataType.simpleString()

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, object, int, int]] = []
            for k, own in enumerate(batch.column(2).to_pylist()):
                begin = end = 0
                source = None
                for c in [*own, None]:
                    first, size = divmod(c["place"], 1 << 20) if c else (-1, 0)
                    if first != end or end == 0:
                        if end - begin >= least_chars:
                            rows.append((k, source, begin, end - begin))
                        if c:
                            begin, source = first, c["first_id"]
                    end = first + size
            at = pa.array([r[0] for r in rows], pa.int64())
            ids = batch.column(0).take(at)
            yield pa.RecordBatch.from_arrays([ids, batch.column(1).take(at), pa.array([r[1] for r in rows], ids.type), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())], [id_column, "text_hash", "first_id", "start", "n_chars"])

    return found.mapInArrow(spans, f"`{id_column}` {kind}, text_hash long, first_id {kind}, start long, n_chars long")


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """id and text without repeated spans; a text that is nothing else becomes empty."""
    found = repeats(docs, id_column, text, least_chars)
    spans = found.groupBy(F.col(id_column).alias("_id"), F.col("text_hash").alias("_hash")).agg(F.sort_array(F.collect_list(F.struct("start", "n_chars"))).alias("_spans"))

    def step(state, span):
        piece = F.substr(F.col(text), state["at"] + 1, span["start"] - state["at"])
        return F.struct((span["start"] + span["n_chars"]).alias("at"), F.concat(state["out"], F.array(piece)).alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    cut = F.aggregate("_spans", zero, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substr(F.col(text), s["at"] + 1, F.lit(2**31 - 1).cast("long"))))
    own = docs.select(id_column, text)
    met = own.join(spans, (F.col(id_column) == F.col("_id")) & (F.xxhash64(text) == F.col("_hash")), "left")
    return met.select(id_column, F.when(F.col("_spans").isNull(), F.col(text)).otherwise(cut).alias(text))
