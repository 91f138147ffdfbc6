"""Weak supervision of text quality.

Ten rules vote GOOD or BAD on a document or abstain.  Expectation-maximisation
over the counts of vote patterns estimates how often each rule votes BAD on
good and on bad documents, and a document's posterior probability of being
good replaces the requirement that all rules pass.

Vote patterns are at most ``3 ** len(RULES)`` (59,049), so their counts are the
only thing that reaches the driver, whatever the size of the corpus.  Texts are
read twice, once to count patterns and once to judge; nothing is shuffled but
the counts.

Defined results: a null text is an empty one; an empty text has no words, every
rule abstains on it and it fails the base test; repeated rows are counted and
judged one by one; an empty table gives no rows and the prior model; other
columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resonara.llm.common import small_batches, utf8

ABSTAIN, GOOD, BAD = 0, 1, 2
RULES = ("symbols", "symbol_flood", "word_length", "duplicate_lines", "repeated_windows", "capitals", "function_words", "lettered_words", "line_ends", "diversity")

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = (
    "the of and to in is that for it with as was on are be this have from or by at not but they which "
    "der die das und ist von mit den nicht ein eine zu im auf für als dem des auch sich "
    "de la le les et un une du que qui en dans pour par sur est au avec pas ce "
    "el los las del una con por para como su se es lo más no al"
)

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(0x41, 0x5B))
_LATIN = _UPPER + bytes(range(0x61, 0x7B))
_NOT_LETTER = bytes(x for x in range(0x80) if x not in _LATIN and x not in _SPACE)
_WORDS = tuple(x.encode() for x in FUNCTION_WORDS.split())
_ENDS = (b".", b"!", b"?", b'"', b"'", b":", b")", "…".encode(), "”".encode(), "»".encode(), "。".encode(), "！".encode(), "？".encode())

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_latin", "n_function", "n_lettered", "n_ended", "n_distinct")


def repeated_words(words: list[bytes], distinct: dict[bytes, int]) -> int:
    """Words inside 3-word windows that occur at least twice in the text."""
    n = len(words) - 2
    if n < 2:
        return 0
    ids = np.fromiter(map(distinct.__getitem__, words), np.int64, len(words))
    size = len(distinct)
    if size < 1 << 21:
        keys = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    else:  # three numbers no longer fit 63 bits: number the pairs first
        pairs = np.unique(ids[:-2] * size + ids[1:-1], return_inverse=True)[1]
        keys = pairs * size + ids[2:]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    inside = np.zeros(n + 2, bool)
    for k in range(3):
        inside[k : k + n] |= again
    return int(inside.sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The MEASURES of one text."""
    words = text.split()
    if not words:
        return (0,) * len(MEASURES)
    distinct = dict.fromkeys(words)
    for i, word in enumerate(distinct):
        distinct[word] = i
    dense = text.translate(None, _SPACE)
    lines = [x for x in map(bytes.strip, text.split(b"\n")) if x]
    whole = [x for x in text.split(b"\n") if x and not x.isspace()]
    return (
        len(words),
        len(dense.translate(None, _CONTINUATION)),
        len(dense) - len(dense.translate(None, _SYMBOLS)),
        len(whole) - len(set(whole)),
        repeated_words(words, distinct),
        len(lines),
        len(dense) - len(dense.translate(None, _UPPER)),
        len(dense) - len(dense.translate(None, _LATIN)),
        sum(x in distinct for x in _WORDS),
        len(text.translate(None, _NOT_LETTER).split()),
        sum(x.endswith(_ENDS) for x in lines),
        len(distinct),
    )


def _vote(bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else ABSTAIN


def votes(m: tuple[int, ...]) -> tuple[int, ...]:
    """One vote for each of RULES, from the MEASURES of a text."""
    n, chars, symbols, dup, repeat, lines, upper, latin, function, lettered, ended, distinct = m
    if not n:
        return (ABSTAIN,) * len(RULES)
    western = 10 * latin >= 6 * chars
    return (
        _vote(100 * symbols > 10 * n, 100 * symbols <= n),
        _vote(symbols >= n, 10 * symbols <= n),
        _vote(chars < 3 * n or chars > 10 * n, 35 * n <= 10 * chars <= 65 * n),
        _vote(dup >= 2 and 100 * dup > 30 * lines, dup == 0 and lines >= 3),
        _vote(100 * repeat > 30 * n, 100 * repeat < 5 * n),
        _vote(100 * upper > 30 * latin and latin >= 20, 100 * upper < 10 * latin),
        _vote(western and n >= 20 and function == 0, function >= 3),
        _vote(100 * lettered < 80 * n, 100 * lettered >= 95 * n),
        _vote(lines >= 3 and 100 * ended < 10 * lines, 100 * ended >= 70 * lines),
        _vote(n >= MIN_WORDS and 100 * distinct < 10 * n, n >= MIN_WORDS and 100 * distinct >= 25 * n),
    )


def pattern(v: tuple[int, ...]) -> int:
    """The votes as one number in base 3."""
    out = 0
    for x in v:
        out = out * 3 + x
    return out


def unpacked(patterns: np.ndarray) -> np.ndarray:
    """The votes of each pattern, a row each."""
    return patterns[:, None] // 3 ** np.arange(len(RULES) - 1, -1, -1) % 3


def base_failed(m: tuple[int, ...]) -> bool:
    return m[0] < MIN_WORDS or 100 * m[4] > MAX_REPEAT_PERCENT * m[0]


@dataclass(frozen=True)
class LabelModel:
    """Share of bad documents, and each rule's rate of BAD votes among its votes on good and on bad documents."""

    bad_share: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that a document with these votes is good."""
        v = unpacked(np.asarray(patterns, np.int64))
        good, bad = np.array(self.on_good), np.array(self.on_bad)
        odds = np.log1p(-self.bad_share) - np.log(self.bad_share) + np.where(v == BAD, np.log(good / bad), np.where(v == GOOD, np.log((1 - good) / (1 - bad)), 0.0)).sum(1)
        return 1 / (1 + np.exp(-odds))

    def accuracies(self) -> dict[str, tuple[float, float]]:
        """Each rule's estimated accuracy on good and on bad documents."""
        return {r: (1 - g, b) for r, g, b in zip(RULES, self.on_good, self.on_bad, strict=True)}


#: What is assumed before any document is seen, worth PRIOR_VOTES votes of every rule.
PRIOR = LabelModel(0.2, (0.05,) * len(RULES), (0.4,) * len(RULES))
PRIOR_VOTES = 20.0
#: Share of bad documents up to which the estimate may go.
MOST_BAD = 0.95
ROUNDS = 60


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """Expectation-maximisation over distinct vote patterns.

    A rule stays better than chance: it votes BAD at least twice as often on
    bad documents as on good ones.  That fixes which class is which.
    """
    model = PRIOR
    if not len(patterns):
        return model
    order = np.argsort(patterns)
    patterns, counts = np.asarray(patterns, np.int64)[order], np.asarray(counts, float)[order]
    v = unpacked(patterns)
    for _ in range(rounds):
        good = model.posterior(patterns) * counts
        bad = counts - good

        def rate(weight: np.ndarray, prior: tuple[float, ...]) -> np.ndarray:
            said, spoke = weight @ (v == BAD), weight @ (v != ABSTAIN)
            return (said + PRIOR_VOTES * np.array(prior)) / (spoke + PRIOR_VOTES)

        on_good = np.clip(rate(good, PRIOR.on_good), 1e-4, 0.45)
        on_bad = np.clip(np.maximum(rate(bad, PRIOR.on_bad), 2 * on_good), 1e-3, 0.99)
        share = (bad.sum() + PRIOR_VOTES * PRIOR.bad_share) / (counts.sum() + PRIOR_VOTES)
        model = LabelModel(float(np.clip(share, 1e-3, MOST_BAD)), tuple(on_good.tolist()), tuple(on_bad.tolist()))
    return model


def fit(docs: DataFrame, text: str = "text") -> LabelModel:
    """The label model of all rows of ``docs``."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("pattern", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            for b in utf8(batch.column(0)):
                p = pattern(votes(measure(b)))
                seen[p] = seen.get(p, 0) + 1
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()))], schema=schema)

    counted = docs.select(text).mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    return estimate(np.array([r[0] for r in counted], np.int64), np.array([r[1] for r in counted], float))


def judged(docs: DataFrame, model: LabelModel, id_column: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """id, MEASURES, posterior and verdicts of every row."""
    small_batches(docs.sparkSession)
    docs = docs.select(id_column, text)
    columns = ", ".join(f"{x} long" for x in MEASURES)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = [measure(b) for b in utf8(batch.column(1))]
            p = model.posterior(np.array([pattern(votes(x)) for x in m], np.int64))
            failed = np.array([base_failed(x) for x in m], bool)
            cells = [pa.array([x[i] for x in m], pa.int64()) for i in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cells, pa.array(p), pa.array(failed), pa.array(~failed & (p >= threshold))], [id_column, *MEASURES, "quality", "base_failed", "kept"])

    return docs.mapInArrow(judge, f"`{id_column}` {docs.schema[0].dataType.simpleString()}, {columns}, quality double, base_failed boolean, kept boolean")


def kept_rows(docs: DataFrame, model: LabelModel, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the model keeps, all columns as they are."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = [measure(b) for b in utf8(batch.column(at))]
            p = model.posterior(np.array([pattern(votes(x)) for x in m], np.int64))
            yield batch.filter(pa.array([not base_failed(x) and bool(q >= threshold) for x, q in zip(m, p, strict=True)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
