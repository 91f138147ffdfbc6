"""Quality classifier: ordinal regression on graded ratings.

A document's features are its distinct words, their distinct beginnings (which
inflected and compounded forms share) and a few described measures, each hashed
into two of BUCKETS weights that are added, so that words collide in
full only if they do twice.  One weight vector serves all grades; ordered
thresholds turn its score into cumulative probabilities:
``P(grade > k) = sigmoid(score - threshold[k])``.  From these come the expected
grade and the tail probability by which documents are selected.

Training runs on the driver over about SAMPLE_ROWS labelled documents, those of
the lowest hash of their id and never more than twice as many, which arrive as lists of buckets.  Buckets of
fewer than LEAST_DOCUMENTS sampled documents, and those whose shares above
every grade stay within LEAST_Z standard errors of the overall ones, keep
weight 0.  The fitted weights have
a fixed size and go to the tasks with a broadcast.  Scoring is one pass over
whole texts without a shuffle.

Defined results: a null text is an empty one and gets the score of no words; a
null grade isn't used; rows of one id are labelled alike and one of them is
trained on; without labelled rows every grade is equally likely; repeated rows
score equally; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resonara.llm.common import WordHashes, checkpointed, hash_sample, small_batches, utf8
from resonara.llm.decontamination import words_of
from resonara.llm.quality_rules import measure

BUCKETS = 1 << 20
SAMPLE_ROWS = 6000
STEM_BYTES = 4
LEAST_DOCUMENTS = 3
#: Standard errors by which a bucket's share of documents above some grade must depart from the overall one.
LEAST_Z = 3.5
ROUNDS = 250
RIDGE = 5e-4

_LEVELS = (1, 5, 10, 20, 35, 50, 80)


def _described(text: bytes) -> list[bytes]:
    """Measures of a text as words that no text has."""
    n, chars, symbols, dup, repeat, lines, upper, latin, function, lettered, ended, distinct = measure(text)
    if not n:
        return [b"\x00empty"]
    shares = {b"symbols": symbols / n, b"dup": dup / max(1, lines), b"repeat": repeat / n, b"upper": upper / max(1, latin), b"lettered": lettered / n, b"ended": ended / max(1, lines), b"distinct": distinct / n, b"function": min(function, 9) / 9}
    return [b"\x00%s:%d" % (k, sum(100 * v > x for x in _LEVELS)) for k, v in shares.items()] + [b"\x00length:%d" % min(12, chars // n)]


def buckets(text: bytes, hashes: WordHashes) -> np.ndarray:
    """The weights that a text adds up; one that two features share stands twice."""
    words = set(words_of(text))
    stems = {w[:STEM_BYTES] for w in words}
    h = hashes.of([*words, *(b"\x01" + x for x in stems), *_described(text)])
    mask = np.uint64(BUCKETS - 1)
    return np.sort(np.concatenate([h & mask, (h >> np.uint64(32)) & mask]).astype(np.int32))


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        if not rows:
            return np.empty(0)
        ends = np.cumsum([len(x) for x in rows])
        return np.add.reduceat(self.weights[np.concatenate(rows)].astype(np.float64), np.r_[0, ends[:-1]])

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) of each score, a column for each threshold."""
        return 1 / (1 + np.exp(self.thresholds[None, :] - scores[:, None]))


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, rounds: int = ROUNDS, ridge: float = RIDGE) -> OrdinalModel:
    """Maximum likelihood of the cumulative logit model with a ridge, by Adam on all rows."""
    even = np.log(np.arange(1, n_grades) / np.arange(n_grades - 1, 0, -1))
    if not len(rows):
        return OrdinalModel(np.zeros(BUCKETS, np.float32), even)
    y = np.asarray(grades)
    held = [np.unique(x) for x in rows]
    of_row, bucket = np.repeat(np.arange(len(rows)), [len(x) for x in held]), np.concatenate(held)
    seen = np.bincount(bucket, minlength=BUCKETS)
    apart = np.zeros(BUCKETS)
    for k in range(n_grades - 1):
        above = (y > k).astype(float)
        spread = max(float(above.std()), 1e-6)
        total = np.bincount(bucket, above[of_row], minlength=BUCKETS)
        apart = np.maximum(apart, np.abs(total - seen * above.mean()) / (spread * np.sqrt(np.maximum(seen, 1))))
    used = np.flatnonzero((seen >= LEAST_DOCUMENTS) & (apart >= LEAST_Z))
    if not len(used):
        used = np.array([0])
    number = np.full(BUCKETS, -1, np.int32)
    number[used] = np.arange(len(used))
    size = [len(x) for x in rows]
    column = number[np.concatenate(rows)]
    row = np.repeat(np.arange(len(rows)), size)[column >= 0]
    column = column[column >= 0]
    w, first = np.zeros(len(used)), even[0]
    gaps = np.log(np.maximum(np.diff(even), 0.1)) if n_grades > 2 else np.zeros(0)
    state = [np.zeros_like(x) for x in (w, w, np.zeros(n_grades - 1), np.zeros(n_grades - 1))]
    for t in range(1, rounds + 1):
        thresholds = first + np.r_[0.0, np.cumsum(np.exp(gaps))]
        score = np.bincount(row, w[column], minlength=len(rows))
        below = 1 / (1 + np.exp(np.clip(score[:, None] - thresholds[None, :], -40, 40)))  # P(grade <= k)
        full = np.c_[np.zeros(len(y)), below, np.ones(len(y))]
        upper, lower = full[np.arange(len(y)), y + 1], full[np.arange(len(y)), y]
        p = np.maximum(upper - lower, 1e-12)
        slope_up, slope_low = upper * (1 - upper) / p, lower * (1 - lower) / p
        by_score = (slope_up - slope_low) / len(y)  # gradient of -log p by the score
        by_threshold = np.array([(-(slope_up * (y == k)).sum() + (slope_low * (y == k + 1)).sum()) / len(y) for k in range(n_grades - 1)])
        later = np.cumsum(by_threshold[::-1])[::-1]
        g_w = np.bincount(column, by_score[row], minlength=len(used)) + ridge * w
        g_t = np.r_[later[0], later[1:] * np.exp(gaps)]
        for k, g in ((0, g_w), (2, g_t)):
            state[k] = 0.9 * state[k] + 0.1 * g
            state[k + 1] = 0.99 * state[k + 1] + 0.01 * g * g
        step_w = state[0] / (1 - 0.9**t) / (np.sqrt(state[1] / (1 - 0.99**t)) + 1e-8)
        step_t = state[2] / (1 - 0.9**t) / (np.sqrt(state[3] / (1 - 0.99**t)) + 1e-8)
        rate = 0.1 * (1 - t / (rounds + 1))
        w = w - rate * step_w
        first, gaps = first - rate * step_t[0], gaps - rate * step_t[1:]
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = w
    return OrdinalModel(weights, first + np.r_[0.0, np.cumsum(np.exp(gaps))])


def train(docs: DataFrame, grades: DataFrame, n_grades: int, id_column: str = "doc_id", text: str = "text", grade: str = "grade", sample_rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """The model of labelled documents; ``grades`` has the id and a grade from 0 to ``n_grades - 1``."""
    small_batches(docs.sparkSession)
    legal = grades.select(F.col(id_column).alias("id"), F.col(grade).cast("int").alias("grade")).filter(F.col("id").isNotNull() & F.col("grade").between(0, n_grades - 1))
    # At most 2 * sample_rows rows, whatever the labels' size: the bound of this broadcast.
    one = checkpointed(legal.groupBy("id").agg(F.min("grade").alias("grade")))
    sample = one.filter(hash_sample(one.count(), sample_rows, "id")).limit(2 * sample_rows)
    chosen = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).join(F.broadcast(sample), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            cells = pa.array([buckets(t, hashes).tobytes() for t in utf8(batch.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), cells], ["id", "grade", "buckets"])

    kind = legal.schema["id"].dataType.simpleString()
    rows = chosen.mapInArrow(run, f"id {kind}, grade int, buckets binary").groupBy("id").agg(F.min("grade").alias("grade"), F.min("buckets").alias("buckets")).orderBy("id").collect()
    return fit([np.frombuffer(r["buckets"], np.int32) for r in rows], np.array([r["grade"] for r in rows], np.int64), n_grades)


def score(docs: DataFrame, model: OrdinalModel, id_column: str = "doc_id", text: str = "text", select_grade: int | None = None, least: float = 0.5) -> DataFrame:
    """id, expected_grade, tail_probability of ``select_grade`` (the top one if none is given) and kept of every row."""
    small_batches(docs.sparkSession)
    docs = docs.select(id_column, text)
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    top = len(model.thresholds) if select_grade is None else select_grade

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        own = OrdinalModel(*sent.value)
        for batch in batches:
            tails = own.tails(own.scores([buckets(t, hashes) for t in utf8(batch.column(1))]))
            tail = tails[:, top - 1] if top else np.ones(len(tails))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(1)), pa.array(tail), pa.array(tail >= least)], [id_column, "expected_grade", "tail_probability", "kept"])

    return docs.mapInArrow(run, f"`{id_column}` {docs.schema[0].dataType.simpleString()}, expected_grade double, tail_probability double, kept boolean")
