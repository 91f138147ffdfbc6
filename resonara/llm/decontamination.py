"""Benchmark decontamination over a stored positional inverted index.

The index is partitioned by document, as search engines partition theirs: a
shard holds whole documents of about SHARD_WORDS words, and for every term the
sorted positions at which it stands.  A shard is one row with a name of its
own, so an index is written once and searched by many benchmarks; ``scan`` and
``clean_rows`` write theirs to the shared checkpoint folder.

Search takes each window of benchmark words from its rarest term in the shard:
that term's positions, less its offset in the window, are where the window may
start.  The list is cut down by the other terms' positions, rarest first, by
binary search in their postings.  What is left are exact phrase matches.  A
proximity match is a document and a start at which every term of the window
stands within ``slack`` words of its place; it depends on the document alone.

Terms are 64-bit hashes of words.  Benchmark words reach the tasks in blocks
of at most BLOCK_WORDS (an item is never split), one block a pass over the
index; tasks make the windows.  With more than one block, what each found is
written, and hits meet by shard and document afterwards.  Nothing else is
shuffled, and a hot document, term or passage stays inside the shards that hold
it.

Defined results: a null or empty text has no words and isn't contaminated; an
empty item has no window; equal items count apart, under their own ids; a null
item id is left out of the list of ids but its windows hit; repeated documents
are judged one by one; an empty benchmark or corpus is no error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resonara.llm.common import WordHashes, checkpointed, small_batches, utf8

WINDOW = 10
SHARD_WORDS = 500_000
BLOCK_WORDS = 2_000_000
#: Words that a term may stand off in a proximity match.
SLACK = 2

# Word characters are 0-9, a-z (A-Z in lower case) and all beyond ASCII; everything else separates.
_TO_WORDS = bytes(x + 32 if 0x41 <= x <= 0x5A else x if 0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A or x >= 0x80 else 0x20 for x in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


@dataclass
class Shard:
    """Terms in order, their postings (positions of term k are ``positions[starts[k]:starts[k+1]]``), and where documents start."""

    terms: np.ndarray
    starts: np.ndarray
    positions: np.ndarray
    documents: np.ndarray

    @staticmethod
    def of(documents: list[np.ndarray]) -> Shard:
        sizes = np.array([len(x) for x in documents], np.int64)
        tokens = np.concatenate(documents) if documents else np.empty(0, np.uint64)
        order = np.argsort(tokens, kind="stable")
        ranked = tokens[order]
        first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.empty(0, np.int64)
        return Shard(ranked[first], np.r_[first, len(ranked)].astype(np.int64), order.astype(np.int32), np.r_[0, np.cumsum(sizes)])

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Number of each term, -1 where the shard hasn't it."""
        if not len(self.terms):
            return np.full(terms.shape, -1, np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)


@dataclass
class Windows:
    """Windows of one length: the items they come from and their terms, a row each."""

    items: np.ndarray
    terms: np.ndarray


def windows_of(items: list[np.ndarray], width: int = WINDOW) -> list[Windows]:
    """Windows of all items by their length; an item shorter than ``width`` is one."""
    by_length: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for k, h in enumerate(items):
        if not len(h):
            continue
        n = min(width, len(h))
        rows = np.lib.stride_tricks.sliding_window_view(h, n)
        by_length.setdefault(n, []).append((np.full(len(rows), k), rows))
    return [Windows(np.concatenate([a for a, _ in x]), np.concatenate([b for _, b in x])) for _, x in sorted(by_length.items())]


def matches(shard: Shard, windows: Windows, slack: int = 0, block: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Row of ``windows`` and first position of every match in the shard.

    Without slack these are exact phrases.  With it every term of the window
    stands, in one document, at most ``slack`` words from its place; a start
    that lies off the document is moved to its nearest word.
    """
    width = windows.terms.shape[1]
    found = shard.find(windows.terms)
    rows = np.flatnonzero((found >= 0).all(1))
    if not len(rows):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    numbers = found[rows]
    counts = shard.starts[numbers + 1] - shard.starts[numbers]
    order = np.argsort(counts, axis=1, kind="stable")
    lengths = np.take_along_axis(counts, order[:, :1], 1)[:, 0] * (2 * slack + 1)
    total = len(shard.positions)
    # One sorted key for all postings: number of the term, then position.
    keys = np.repeat(np.arange(len(shard.terms), dtype=np.int64), np.diff(shard.starts)) * total + shard.positions
    out_rows, out_at = [], []
    part_ends = np.searchsorted(np.cumsum(lengths), np.arange(block, lengths.sum() + block, block), side="right")
    begin = 0
    for end in np.unique(np.maximum(np.r_[part_ends, len(rows)], 1)):
        if end <= begin:
            continue
        r = np.arange(begin, end)
        begin = end
        size = lengths[r]
        who = np.repeat(r, size)
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        rare = order[who, 0]
        place = shard.positions[shard.starts[numbers[who, rare]] + inside // (2 * slack + 1)].astype(np.int64)
        at = place - rare + inside % (2 * slack + 1) - slack
        document = np.searchsorted(shard.documents, place, side="right") - 1
        first, last = shard.documents[document], shard.documents[document + 1] - 1
        if not slack:
            stays = (at >= first) & (at + width - 1 <= last)
            who, at, first, last = who[stays], at[stays], first[stays], last[stays]
        for k in range(1, width):
            if not len(who):
                break
            offset = order[who, k]
            term = numbers[who, offset]
            low, high = np.maximum(at + offset - slack, first), np.minimum(at + offset + slack, last)
            where = np.minimum(np.searchsorted(keys, term * total + low), len(keys) - 1)
            hit = (low <= high) & (keys[where] >= term * total + low) & (keys[where] <= term * total + high)
            who, at, first, last = who[hit], at[hit], first[hit], last[hit]
        out_rows.append(rows[who])
        out_at.append(np.clip(at, first, last) if slack else at)
    return np.concatenate(out_rows), np.concatenate(out_at)


@dataclass
class Block:
    """A bounded part of the benchmark: ids of its items, and their hashed words one after the other."""

    ids: list
    words: np.ndarray
    ends: np.ndarray

    @staticmethod
    def of(ids: list, items: list[np.ndarray]) -> Block:
        return Block(ids, np.concatenate(items) if items else np.empty(0, np.uint64), np.cumsum([len(x) for x in items]).astype(np.int64))

    def windows(self, width: int) -> list[Windows]:
        return windows_of(np.split(self.words, self.ends[:-1]) if len(self.ends) else [], width)


def blocks_of(benchmark: DataFrame, id_column: str = "item_id", text: str = "text", block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark by blocks of up to ``block_words`` words (an item is never split), a partition at a time."""
    hashes = WordHashes()
    ids, items, held = [], [], 0
    for row in benchmark.select(id_column, text).toLocalIterator():
        h = hashes.of(words_of((row[1] or "").encode()))
        if held and held + len(h) > block_words:
            yield Block.of(ids, items)
            ids, items, held = [], [], 0
        ids.append(row[0])
        items.append(h)
        held += len(h)
    yield Block.of(ids, items)


def search(shard: Shard, block: Block, by_length: list[Windows], slack: int | None = None) -> tuple[list[tuple[list[int], list[int]]], list[list], list[list]]:
    """Of each document of the shard: hit runs (starts and ends), ids of items found exactly, ids found within ``slack``."""
    n = len(shard.documents) - 1
    total = len(shard.positions)
    change = np.zeros(total + 1, np.int64)
    exact, near = [set() for _ in range(n)], [set() for _ in range(n)]
    for windows in by_length:
        for words_off, into in ((0, exact), (slack, near)):
            if words_off is None:
                continue
            row, at = matches(shard, windows, words_off)
            document = np.searchsorted(shard.documents, at, side="right") - 1
            if into is exact:
                np.add.at(change, at, 1)
                np.add.at(change, at + windows.terms.shape[1], -1)
            for d, i in np.unique(np.stack([document, windows.items[row]]), axis=1).T.tolist() if len(row) else ():
                if block.ids[i] is not None:
                    into[d].add(block.ids[i])
    covered = np.cumsum(change[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.r_[False, covered, False]))
    runs: list[tuple[list[int], list[int]]] = [([], []) for _ in range(n)]
    for a, b in edges.reshape(-1, 2).tolist():
        d = int(np.searchsorted(shard.documents, a, side="right")) - 1
        while a < b:  # runs of neighbouring documents may touch
            begin, end = int(shard.documents[d]), int(shard.documents[d + 1])
            if end > a:
                runs[d][0].append(a - begin)
                runs[d][1].append(min(b, end) - begin)
                a = min(b, end)
            d += 1
    return runs, [sorted(x, key=str) for x in exact], [sorted(x, key=str) for x in near]


def _shards(batches: Iterator[pa.RecordBatch], id_at: int, text_at: int, shard_words: int) -> Iterator[tuple[Shard, list[tuple[pa.RecordBatch, int, int]]]]:
    """Shards with the rows of the batches they were made of."""
    hashes = WordHashes()
    held: list[np.ndarray] = []
    of: list[tuple[pa.RecordBatch, int, int]] = []
    words = 0
    for batch in batches:
        first = 0
        for k, text in enumerate(utf8(batch.column(text_at))):
            h = hashes.of(words_of(text))
            if held and words + len(h) > shard_words:
                if k > first:
                    of.append((batch, first, k))
                yield Shard.of(held), of
                held, of, words, first = [], [], 0, k
            held.append(h)
            words += len(h)
        if batch.num_rows > first:
            of.append((batch, first, batch.num_rows))
    if held:
        yield Shard.of(held), of


CELLS = {"terms": "<u8", "starts": "<i8", "positions": "<i4", "documents": "<i8"}


def build_index(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """The positional index, a row for each shard: its name, the ids of its documents and little-endian arrays.  Write it to keep it.

    The name is that of the build, the task and the shard, so no two rows of an
    index share one, equal documents or not.  An id may be a struct.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    build = uuid.uuid4().hex
    schema = T.StructType([T.StructField("shard", T.StringType()), T.StructField("ids", T.ArrayType(docs.schema["id"].dataType)), *[T.StructField(c, T.BinaryType()) for c in CELLS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for n, (shard, of) in enumerate(_shards(batches, 0, 1, shard_words)):
            ids = pa.concat_arrays([b.column(0).slice(a, z - a) for b, a, z in of])
            cells = [pa.array([getattr(shard, c).astype(kind).tobytes()], pa.binary()) for c, kind in CELLS.items()]
            yield pa.RecordBatch.from_arrays([pa.array([f"{build}-{task}-{n}"]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *cells], ["shard", "ids", *CELLS])

    return docs.mapInArrow(run, schema)


def _merged(parts: list[DataFrame]) -> DataFrame:
    """What several blocks found, met by shard and document; the first part has every document."""
    union = parts[0]
    for x in parts[1:]:
        union = union.unionByName(x)
    runs = F.flatten(F.collect_list(F.arrays_zip("run_starts", "run_ends")))
    met = union.groupBy("shard", "nth").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.sort_array(runs).alias("runs"), *[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("items", "near_items")])

    def join(state, run):
        last = F.element_at(state, -1)
        apart = (F.size(state) == 0) | (run["run_starts"] > F.get(state, F.size(state) - 1)["run_ends"])
        longer = F.struct(last["run_starts"].alias("run_starts"), F.greatest(last["run_ends"], run["run_ends"]).alias("run_ends"))
        return F.when(apart, F.concat(state, F.array(run))).otherwise(F.concat(F.slice(state, 1, F.size(state) - 1), F.array(longer)))

    one = F.aggregate("runs", F.array().cast("array<struct<run_starts:bigint,run_ends:bigint>>"), join)
    return met.withColumn("runs", one).select("shard", "nth", "id", "n_words", F.col("runs.run_starts").alias("run_starts"), F.col("runs.run_ends").alias("run_ends"), "items", "near_items")


def _searched(index: DataFrame, block: Block, item_type: T.DataType, width: int, slack: int | None, all_documents: bool) -> DataFrame:
    """What one block finds: a row for every document, or for those with a match."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_type, arrow_item = index.schema["ids"].dataType.elementType, to_arrow_type(item_type)
    longs = T.ArrayType(T.LongType())
    kinds = {"shard": T.StringType(), "nth": T.IntegerType(), "id": id_type, "n_words": T.LongType(), "run_starts": longs, "run_ends": longs, "items": T.ArrayType(item_type), "near_items": T.ArrayType(item_type)}
    sent = index.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, by_length = sent.value, None
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                by_length = own.windows(width) if by_length is None else by_length
                shard = Shard(**{c: np.frombuffer(row.column(c)[0].as_buffer(), kind) for c, kind in CELLS.items()})
                runs, exact, near = search(shard, own, by_length, slack)
                sizes = np.diff(shard.documents)
                cells = [row.column("shard").take(pa.array(np.zeros(len(sizes), np.int64))), pa.array(range(len(sizes)), pa.int32()), row.column("ids").flatten(), pa.array(sizes, pa.int64()), pa.array([a for a, _ in runs], pa.list_(pa.int64())), pa.array([b for _, b in runs], pa.list_(pa.int64())), pa.array(exact, pa.list_(arrow_item)), pa.array(near, pa.list_(arrow_item))]
                made = pa.RecordBatch.from_arrays(cells, list(kinds))
                yield made if all_documents else made.filter(pa.array([bool(r[0]) or bool(n) for r, n in zip(runs, near, strict=True)], pa.bool_()))

    return index.mapInArrow(run, T.StructType([T.StructField(c, kind) for c, kind in kinds.items()]))


def search_index(index: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", item_column: str = "item_id", item_text: str = "text", width: int = WINDOW, slack: int | None = SLACK, block_words: int = BLOCK_WORDS) -> DataFrame:
    """id, n_words, hit runs in words, ids of exact and of proximity matches, for every document of an index.

    Several blocks need a stored index (read from files or a checkpoint).
    """
    small_batches(index.sparkSession)
    kind = benchmark.schema[item_column].dataType
    blocks = blocks_of(benchmark, item_column, item_text, block_words)
    found, rest = _searched(index, next(blocks), kind, width, slack, True), next(blocks, None)
    if rest is not None:
        parts = [checkpointed(found)]
        while rest is not None:
            parts.append(checkpointed(_searched(index, rest, kind, width, slack, False)))
            rest = next(blocks, None)
        found = _merged(parts)
    return found.select(F.col("id").alias(id_column), "n_words", "run_starts", "run_ends", "items", "near_items")


def scan(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", item_column: str = "item_id", item_text: str = "text", width: int = WINDOW, slack: int | None = SLACK, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """What ``search_index`` gives, from documents; the index is stored in the shared folder."""
    index = checkpointed(build_index(docs, id_column, text, shard_words))
    return search_index(index, benchmark, id_column, item_column, item_text, width, slack, block_words)


def digests(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts and a digest of the items of every document."""
    n_hit = F.aggregate(F.zip_with("run_starts", "run_ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda a, x: a + x)
    items = F.sort_array(F.transform("items", lambda x: x.cast("string")))
    return found.select(id_column, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size("run_starts") > 0).alias("contaminated"), F.size(F.array_except("near_items", "items")).cast("long").alias("n_near_items"))


def clean_rows(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_column: str = "item_id", item_text: str = "text", width: int = WINDOW, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` without any hit, all columns as they are; their index has whole rows for ids."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    found = scan(rows, benchmark, "row", "text", item_column, item_text, width, None, shard_words, block_words)
    return found.filter(F.size("run_starts") == 0).select("row.*")
