"""Byte-level BPE encoding and decoding with the ``tokenizers`` library.

A rank file names byte strings in merge order.  Its bytes are mapped to
printable characters, the merges are read back from the ranks, and the library
encodes batches of texts; a token that is itself a whole piece is taken without
merging, as rank-file encoders do.

With a pre-tokenising pattern of SEGMENTED, texts are cut into segments, each a
run of blanks, tabs or newlines and the run that follows it.  These patterns
never match across such a cut (a match holds white space at its start or is all
white space), so segments can be encoded apart.  Their ids are remembered, up
to CACHE_ROWS segments a worker.  Work on a text goes forward by pieces of
PIECE_BYTES, so memory doesn't follow the length of the longest text but for
its ids.  With any other pattern a text is one segment.

Defined results: a null text is an empty one and gives no ids; a null or empty
list of ids decodes to empty text; repeated rows and clashing column names are
kept as they are; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from resonara.llm.common import small_batches, utf8

CACHE_ROWS = 500_000
#: Segments longer than this aren't remembered.
CACHE_BYTES = 64
PIECE_BYTES = 1 << 20

# Fixed value: the pattern whose matches never cross a segment's end.
SEGMENTED = frozenset([r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"])

_SEGMENT = re.compile(rb"[ \n\t]*[^ \n\t]+|[ \n\t]+")
_AFTER_PRINT = re.compile(rb"(?<=[!-~])(?=[ \n\t])")
#: White space besides blank, tab and newline, in UTF-8.  After it a cut isn't safe.
_OTHER_SPACE = re.compile(rb"[\x0b\x0c\r\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is visible, else the next one from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> id, from lines of base64 and number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """Every pair that forms a token from earlier ones, in the order of what it forms."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        halves = ((token[:i], token[i:]) for i in range(1, len(token)))
        pairs = [(ranks[a], ranks[b], a, b) for a, b in halves if ranks.get(a, rank) < rank and ranks.get(b, rank) < rank]
        out += [(a, b) for _, _, a, b in sorted(pairs)]
    return out


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks, characters = read_ranks(path), byte_characters()

        def shown(token: bytes) -> str:
            return "".join(map(characters.__getitem__, token))

        vocabulary = {shown(t): i for t, i in ranks.items()}
        merges = [(shown(a), shown(b)) for a, b in merges_of(ranks)]
        self.tokenizer = Tokenizer(models.BPE(vocab=vocabulary, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), behavior="isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        byte_of = {c: b for b, c in enumerate(characters)}
        self.tokens = {i: bytes(map(byte_of.__getitem__, t)) for t, i in vocabulary.items()}
        self.lengths = np.zeros(max(self.tokens) + 1, np.int64)
        for i, t in self.tokens.items():
            self.lengths[i] = len(t)
        #: Ids of remembered segments, and of the last call's that are too long to stay.
        self._known: dict[bytes, bytes] = {}
        self._passing: list[bytes] = []
        self._segmented = pattern in SEGMENTED

    def _pieces(self, text: bytes) -> Iterator[list[bytes]]:
        """Lists of segments, each list of about PIECE_BYTES."""
        if not self._segmented:
            yield [text] if text else []
            return
        strict = bool(_OTHER_SPACE.search(text))
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > PIECE_BYTES and (cut := _AFTER_PRINT.search(text, at + PIECE_BYTES)):
                end = cut.start()
            piece = text[at:end]
            yield _AFTER_PRINT.split(piece) if strict else _SEGMENT.findall(piece)
            at = end

    def _learn(self, missing: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Segments with their ids as little-endian 32-bit numbers."""
        for k in range(0, len(missing), 2048):
            part = missing[k : k + 2048]
            coded = [e.ids for e in self.tokenizer.encode_batch_fast(list(map(bytes.decode, part)), add_special_tokens=False)]
            ends = [4 * n for n in accumulate(map(len, coded))]
            packed = np.fromiter(chain.from_iterable(coded), "<u4", ends[-1] // 4).tobytes()
            yield from zip(part, [packed[a:z] for a, z in pairwise([0, *ends])], strict=True)

    def encode_all(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        k = 0
        while k < len(texts):
            size, n = 0, k
            while n < len(texts) and (n == k or size + len(texts[n]) <= PIECE_BYTES):
                size += len(texts[n])
                n += 1
            if n == k + 1:
                yield b"".join(b"".join(self._ids(piece)) for piece in self._pieces(texts[k]))
            else:
                cut = [[s for piece in self._pieces(t) for s in piece] for t in texts[k:n]]
                ids = self._ids_of({s for segments in cut for s in segments})
                yield from [b"".join(map(ids, segments)) for segments in cut]
            k = n

    def _ids_of(self, distinct: set[bytes]):
        """A function from these segments to their ids, good until the next call."""
        if len(self._known) + len(distinct) > CACHE_ROWS:  # keep what is in use
            self._known = {s: self._known[s] for s in distinct & self._known.keys()}
        known = self._known
        for s in self._passing:
            known.pop(s, None)
        missing = list(distinct.difference(known))
        known.update(self._learn(missing))
        self._passing = [s for s in missing if len(s) > CACHE_BYTES]
        return known.__getitem__

    def _ids(self, segments: list[bytes]) -> Iterator[bytes]:
        return map(self._ids_of(set(segments)), segments)

    def offsets(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each id, its first character and the one after its last; tokens inside one character share it."""
        if not len(ids):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        ends = np.cumsum(self.lengths[ids])
        character = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
        return character[ends - self.lengths[ids]] - 1, character[ends - 1]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode_stream(self, chunks: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text of each chunk of ids; a character split between chunks comes out with the chunk that ends it."""
        open_text = codecs.getincrementaldecoder("utf-8")("replace")
        for chunk in chunks:
            yield open_text.decode(self.decode(chunk))
        if rest := open_text.decode(b"", True):
            yield rest


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec of each vocabulary in a worker."""
    return Codec(path, pattern)


def _kind(docs: DataFrame, column: str) -> str:
    return docs.schema[column].dataType.simpleString()


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_column: str = "doc_id", text: str = "text", offsets: bool = True) -> DataFrame:
    """id, ids and, with ``offsets``, the character span of every token."""
    small_batches(docs.sparkSession)
    names = ["ids", "starts", "ends"] if offsets else ["ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        for batch in batches:
            texts = utf8(batch.column(1))
            rows: list[list[np.ndarray]] = []
            for t, packed in zip(texts, own.encode_all(texts), strict=True):
                ids = np.frombuffer(packed, "<u4").astype(np.int32)
                rows.append([ids, *own.offsets(t, ids)] if offsets else [ids])
            cells = [pa.array([r[k].astype(np.int32) for r in rows], pa.list_(pa.int32())) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cells], [id_column, *names])

    return docs.select(id_column, text).mapInArrow(run, f"`{id_column}` {_kind(docs, id_column)}, " + ", ".join(f"{n} array<int>" for n in names))


def decode(encoded: DataFrame, vocabulary: str, pattern: str, id_column: str = "doc_id", ids: str = "ids") -> DataFrame:
    """id and the text of its ids; bytes that form no character become U+FFFD."""
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        for batch in batches:
            texts = [own.decode(x or ()).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_column, "decoded"])

    return encoded.select(id_column, ids).mapInArrow(run, f"`{id_column}` {_kind(encoded, id_column)}, decoded string")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_column: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """id, n_tokens and digests of the ids and of what they decode to; ``with_ids`` adds the ids."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        for batch in batches:
            sizes, of_ids, of_text, lists = [], [], [], []
            for packed in own.encode_all(utf8(batch.column(1))):
                ids = np.frombuffer(packed, "<u4")
                sizes.append(len(ids))
                of_ids.append(hashlib.sha256(packed).hexdigest())
                of_text.append(hashlib.sha256(own.decode(ids.tolist())).hexdigest())
                if with_ids:
                    lists.append(ids.astype(np.int32))
            cells = [pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())] + [pa.array(lists, pa.list_(pa.int32()))] * with_ids
            yield pa.RecordBatch.from_arrays([batch.column(0), *cells], [id_column, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    return docs.select(id_column, text).mapInArrow(run, f"`{id_column}` {_kind(docs, id_column)}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
