"""Awkward rows, empty tables and brute-force comparisons for the corpus operators."""

import base64
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from corpus import LICENSE_LINE, awkward_rows, base_measures, bench_words, contamination, frame, near_components, secret_spans, sha, words

from resonara.llm import byte_bpe, common, decontamination, license_scan, near_dedup, quality_classifier, quality_rules, secret_scan, substring_dedup

CLASH = ("kept", "ids", "node", "key", "n", "id", "chunks", "secret_spans", "n_words", "component", "nth_row")
key = lambda r: (r[0] is not None, r[0] or 0, str(r))


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, awkward_rows(), CLASH)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, awkward_rows(), CLASH).filter("false")


# quality rules


def test_base_measures_equal_brute_force(docs):
    model = quality_rules.fit(docs)
    got = quality_rules.judged(docs, model).collect()
    found = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got), key=key)
    expected = []
    for i, t in awkward_rows():
        m = base_measures(t)
        expected.append((i, *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    assert found == sorted(expected, key=key)
    assert not any(r["kept"] for r in got if r["base_failed"])
    assert quality_rules.kept_rows(docs, model).count() == sum(r["kept"] for r in got)
    assert quality_rules.kept_rows(docs, model).schema == docs.schema


def test_label_model_equals_row_by_row_em():
    r = random.Random(5)
    rows = []
    for _ in range(3000):
        bad = r.random() < 0.3
        rows.append(tuple(0 if r.random() < 0.2 else 2 if r.random() < (0.6 if bad else 0.02) else 1 for _ in quality_rules.RULES))
    patterns = np.array([quality_rules.pattern(v) for v in rows])
    counted = quality_rules.estimate(*np.unique(patterns, return_counts=True))
    single = quality_rules.estimate(patterns, np.ones(len(patterns)))
    assert np.allclose(counted.on_bad, single.on_bad) and np.allclose(counted.bad_share, single.bad_share)
    assert abs(counted.bad_share - 0.3) < 0.05
    assert all(abs(x - 0.6) < 0.08 for x in counted.on_bad)
    assert [tuple(x) for x in quality_rules.unpacked(patterns[:50])] == rows[:50]


def plain_votes(text):
    """The rules' votes, from their descriptions, on characters and words of a string."""
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(found)
    if not n:
        return (0,) * 10
    chars = sum(map(len, found))
    n_words, _, symbols, dup, repeat = base_measures(text)
    lines = [x for x in (y.strip(" \t\n\x0b\x0c\r") for y in text.split("\n")) if x]
    upper, latin = len(re.findall("[A-Z]", text)), len(re.findall("[A-Za-z]", text))
    function = sum(x.decode() in found for x in quality_rules._WORDS)
    lettered = len([x for x in found if re.search(r"[A-Za-z\x80-\U0010ffff]", x)])
    ended = sum(x.endswith(tuple(e.decode() for e in quality_rules._ENDS)) for x in lines)
    distinct = len(set(found))
    vote = lambda bad, good: 2 if bad else 1 if good else 0
    return (
        vote(symbols / n > 0.1, symbols / n <= 0.01),
        vote(symbols >= n, symbols / n <= 0.1),
        vote(chars / n < 3 or chars / n > 10, 3.5 <= chars / n <= 6.5),
        vote(dup >= 2 and dup / len(lines) > 0.3, dup == 0 and len(lines) >= 3),
        vote(repeat / n > 0.3, repeat / n < 0.05),
        vote(latin >= 20 and upper / latin > 0.3, 10 * upper < latin),
        vote(latin / chars >= 0.6 and n >= 20 and not function, function >= 3),
        vote(100 * lettered < 80 * n, 100 * lettered >= 95 * n),
        vote(len(lines) >= 3 and 10 * ended < len(lines), 10 * ended >= 7 * len(lines)),
        vote(n >= 50 and 10 * distinct < n, n >= 50 and 4 * distinct >= n),
    )


def plain_em(votes, rounds=60):
    """Share of bad rows and rates of bad votes, row by row."""
    share, good, bad = 0.2, [0.05] * 10, [0.4] * 10
    for _ in range(rounds):
        weights = []
        for v in votes:
            a, b = 1 - share, share
            for x, g, h in zip(v, good, bad, strict=True):
                a *= 1 if x == 0 else g if x == 2 else 1 - g
                b *= 1 if x == 0 else h if x == 2 else 1 - h
            weights.append(b / (a + b))
        rates = []
        for own, prior in (([1 - w for w in weights], 0.05), (weights, 0.4)):
            rates.append([(sum(w for w, v in zip(own, votes, strict=True) if v[k] == 2) + 20 * prior) / (sum(w for w, v in zip(own, votes, strict=True) if v[k]) + 20) for k in range(10)])
        good = [min(max(x, 1e-4), 0.45) for x in rates[0]]
        bad = [min(max(x, 2 * g, 1e-3), 0.99) for x, g in zip(rates[1], good, strict=True)]
        share = min(max((sum(weights) + 4) / (len(votes) + 20), 1e-3), 0.95)
    return share, good, bad


def test_votes_and_label_model_equal_brute_force():
    texts = [t for _, t in awkward_rows()]
    got = [quality_rules.votes(quality_rules.measure((t or "").encode())) for t in texts]
    names = {quality_rules.ABSTAIN: 0, quality_rules.GOOD: 1, quality_rules.BAD: 2}
    assert [tuple(names[x] for x in v) for v in got] == [plain_votes(t) for t in texts]
    model = quality_rules.estimate(np.array([quality_rules.pattern(v) for v in got]), np.ones(len(got)))
    share, good, bad = plain_em([tuple(names[x] for x in v) for v in got])
    assert np.allclose([model.bad_share, *model.on_good, *model.on_bad], [share, *good, *bad])


def test_a_mostly_bad_corpus_is_judged_so():
    r = random.Random(6)
    rows = [tuple(0 if r.random() < 0.2 else 2 if r.random() < (0.7 if bad else 0.03) else 1 for _ in quality_rules.RULES) for bad in (r.random() < 0.8 for _ in range(4000))]
    model = quality_rules.estimate(np.array([quality_rules.pattern(v) for v in rows]), np.ones(len(rows)))
    assert abs(model.bad_share - 0.8) < 0.03


def test_quality_of_nothing(none):
    model = quality_rules.fit(none)
    assert model == quality_rules.PRIOR
    assert quality_rules.judged(none, model).count() == 0


# quality classifier


def test_ordinal_model_learns_ordered_grades():
    r = random.Random(1)
    hashes = common.WordHashes()
    texts, grades = [], []
    for k in range(900):
        g = k % 3
        texts.append(" ".join([*words(60, k), *["awful"] * (g == 0), *["mediocre"] * (g == 1)]).encode())
        grades.append(g)
    rows = [quality_classifier.buckets(t, hashes) for t in texts]
    train = [k for k in range(900) if r.random() < 0.7]
    test = [k for k in range(900) if k not in set(train)]
    model = quality_classifier.fit([rows[k] for k in train], np.array([grades[k] for k in train]), 3)
    assert np.all(np.diff(model.thresholds) > 0)
    tails = model.tails(model.scores([rows[k] for k in test]))
    assert np.all(np.diff(tails, axis=1) <= 0)
    assert np.mean(np.round(tails.sum(1)) == [grades[k] for k in test]) > 0.9


def test_classifier_on_awkward_rows(spark, docs, none):
    grades = spark.createDataFrame([(1, 2), (2, 2), (14, 0), (17, 1), (None, 1), (15, None), (16, 9)], "doc_id long, grade int")
    model = quality_classifier.train(docs, grades, 3)
    got = quality_classifier.score(docs, model).collect()
    assert len(got) == len(awkward_rows())
    assert all(0 <= r["tail_probability"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in got)
    empty = quality_classifier.train(none, grades, 3)
    assert np.allclose(empty.tails(np.zeros(1))[0], [2 / 3, 1 / 3])
    assert quality_classifier.score(none, empty).count() == 0


# near-dedup


def test_components_equal_all_pairs(docs):
    got = near_dedup.cluster(docs).collect()
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got), key=key)
    expected = sorted(((i, n, c, i == c) for i, n, c in near_components(awkward_rows())), key=key)
    assert found == expected


def test_components_without_sketches(docs):
    plain = sorted(map(str, near_dedup.cluster(docs, sketch_bits=None).collect()))
    assert plain == sorted(map(str, near_dedup.cluster(docs).collect()))


def test_kept_rows_hold_one_of_each_group(docs):
    kept = near_dedup.kept_rows(docs)
    assert kept.schema == docs.schema
    ids = sorted([r["doc_id"] for r in kept.select("doc_id").collect()], key=lambda x: (x is not None, x))
    expected = {(i if i is not None else -1) for i, _, c in near_components(awkward_rows()) if i == c}
    assert [x if x is not None else -1 for x in ids] == sorted(expected)


def test_groups_of_near_copies_equal_all_pairs(spark):
    """A hub with many edited copies, a shared passage, chains and unlinked relatives."""
    r = random.Random(9)
    rows, base = [], words(150, 11, 4000)
    rows.append((1000, " ".join(base)))
    for k in range(120):
        own = list(base)
        for _ in range(r.choice((1, 1, 2, 3, 4, 5))):
            own[r.randrange(len(own))] = f"edit{k}x{r.randrange(99)}"
        rows.append((k, " ".join(own)))
    passage = words(60, 12, 4000)
    rows += [(2000 + k, " ".join(passage + words(r.choice((4, 8, 30)), 500 + k, 4000))) for k in range(60)]
    chain = words(200, 13, 4000)
    for k in range(12):
        chain = chain[3:] + words(3, 900 + k, 4000)
        rows.append((3000 + k, " ".join(chain)))
    few = near_dedup.FEW
    expected = sorted((i, n, c) for i, n, c in near_components(rows))
    for near_dedup.FEW in (few, 0):  # 0 sends every open bucket through the prefix filter
        got = near_dedup.cluster(frame(spark, rows)).collect()
        assert sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == expected
    near_dedup.FEW = few


def test_near_dedup_of_nothing(none):
    assert near_dedup.cluster(none).count() == 0
    assert near_dedup.kept_rows(none).count() == 0


def test_components_of_long_paths(spark):
    path = [(k, k + 1) for k in range(60)] + [(100, 130), (130, 101)]
    got = dict(near_dedup.components(spark.createDataFrame(path, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 130: 100}


def plain_loss(rows, grades, weights, thresholds, ridge):
    """Mean of -log P(grade) in the cumulative logit model, and the ridge."""
    total = 0.0
    for row, y in zip(rows, grades, strict=True):
        score = sum(weights.get(int(b), 0.0) for b in row)
        above = [1.0, *(1 / (1 + math.exp(t - score)) for t in thresholds), 0.0]
        total -= math.log(max(above[y] - above[y + 1], 1e-12))
    return total / len(rows) + ridge / 2 * sum(w * w for w in weights.values())


def test_ordinal_fit_is_at_the_least_loss():
    r = random.Random(11)
    rows, grades = [], []
    for _ in range(400):
        y = r.choice([0, 1, 1, 2, 3])  # grades tie
        row = [10 * y + r.randrange(4) if r.random() < 0.7 else 10 * r.randrange(4) + r.randrange(4) for _ in range(3)] + [99]
        rows.append(np.sort(np.array([*row, *row[:1]], np.int32)))
        grades.append(y)
    ridge = 5e-3
    model = quality_classifier.fit(rows, np.array(grades), 4, rounds=2000, ridge=ridge)
    assert (np.diff(model.thresholds) > 0).all()
    weights = {int(k): float(model.weights[k]) for k in np.flatnonzero(model.weights)}
    assert len(weights) > 8
    best = plain_loss(rows, grades, weights, model.thresholds, ridge)
    for k in weights:
        for d in (-0.05, 0.05):
            assert best <= plain_loss(rows, grades, weights | {k: weights[k] + d}, model.thresholds, ridge) + 1e-5
    for k in range(3):
        for d in (-0.05, 0.05):
            moved = model.thresholds.copy()
            moved[k] += d
            assert best <= plain_loss(rows, grades, weights, moved, ridge) + 1e-5
    tails = model.tails(model.scores(rows[:20]))
    for row, own in zip(rows, tails, strict=False):
        score = sum(float(model.weights[b]) for b in row)
        assert np.allclose(own, [1 / (1 + math.exp(t - score)) for t in model.thresholds])


# license scan


def test_license_scan_equals_checking_everything(docs, none):
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    rows = [*awkward_rows()]
    expected = set()
    for i, t in rows:
        s = scanner.shingles((t or "").encode())
        for k, name in enumerate(scanner.names):
            if len(s) and scanner.check(s, k)[0] >= 0.8:
                expected.add((i, name))
    got = license_scan.scan(docs).collect()
    assert {(r["doc_id"], r["license"]) for r in got} == expected == {(18, "Apache-2.0")}
    assert license_scan.scan(none).count() == 0
    assert license_scan.scan(docs, {}).count() == 0


def test_license_found_after_edits(spark):
    rows = []
    for k, (name, t) in enumerate(license_scan.TEMPLATES.items()):
        own = t.split()
        if len(own) > 30:
            own[len(own) // 2] = "EDITED"
        rows.append((k, " ".join(words(200, k) + own + words(100, 90 + k))))
    got = {(r["doc_id"], r["license"]) for r in license_scan.scan(frame(spark, rows)).collect()}
    assert {(k, name) for k, name in enumerate(license_scan.TEMPLATES)} <= got


def plain_licenses(text):
    """Names by comparing every template with every run of a text, on sets of words."""
    w = bench_words(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    held = []
    for name, t in license_scan.TEMPLATES.items():
        own = bench_words(t)
        own = {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
        best = (0, 0, 0)
        for a in range(len(grams)):
            inside = [i for i in range(a, min(a + len(own), len(grams))) if grams[i] in own]
            if inside and inside[0] == a:
                seen = set()
                for i in inside:  # the run ends where it has all that it will have
                    if grams[i] not in seen:
                        seen.add(grams[i])
                        end = i
                if len(seen) > best[0]:
                    best = (len(seen), a, end)
        n, first, last = best
        run = f" {' '.join(w[first : last + 5])} "
        phrases = [license_scan.TELLING.get(name, ()), (license_scan.VERSION[name],) if name in license_scan.VERSION else ()]
        if 10 * n >= 8 * len(own) and all(any(f" {' '.join(bench_words(p))} " in run for p in some) for some in phrases if some):
            held.append((-n, -n / len(own), name, first, last))
    out = []
    for _, _, name, first, last in sorted(held):
        if all(len(set(range(first, last + 1)) & set(range(a, z + 1))) * 2 <= min(last - first, z - a) + 1 for _, a, z in out):
            out.append((name, first, last))
    return {x[0] for x in out}


def test_the_right_license_is_named(spark):
    t = license_scan.TEMPLATES
    around = lambda x, k: " ".join(words(60, k)) + " " + x + " " + " ".join(words(40, k + 500))
    cases = [(around(text, k), {name}) for k, (name, text) in enumerate(t.items())]
    cases += [
        (around(t["GPL-3.0-notice"].replace("This program", "Foo"), 70), {"GPL-3.0-notice"}),
        (around(t["LGPL-2.1-notice"].replace("This library", "This file"), 71), {"LGPL-2.1-notice"}),
        (around(t["GPL-3.0-notice"].replace("version 3", "version 4"), 72), set()),
        (around(t["BSD-2-Clause-text"].replace("1. ", "").replace("2. ", ""), 73), {"BSD-2-Clause-text"}),
        (around(t["MIT-text"], 74) + " " + around(t["Apache-2.0-notice"], 75), {"MIT-text", "Apache-2.0-notice"}),
        (around(t["Apache-2.0"].replace("2.0", "1.1"), 76), set()),
        (" ".join(words(500, 77)), set()),
    ]
    found = {k: set() for k in range(len(cases))}
    for r in license_scan.scan(frame(spark, [(k, x) for k, (x, _) in enumerate(cases)])).collect():
        found[r["doc_id"]].add(r["license"])
    for k, (text, expected) in enumerate(cases):
        assert found[k] == expected == plain_licenses(text), (k, found[k], expected, plain_licenses(text))


def test_short_templates_are_refused(docs):
    with pytest.raises(ValueError, match="short"):
        license_scan.scan(docs, {"short": "only four words here"})


# byte-level BPE


@pytest.fixture(scope="module")
def ranks():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def test_bpe_equals_tiktoken(docs, none, ranks):
    tiktoken = pytest.importorskip("tiktoken")
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks[0], "rb"))}
    other = tiktoken.Encoding("own", pat_str=ranks[1], mergeable_ranks=table, special_tokens={})
    got = sorted(map(tuple, byte_bpe.round_trip(docs, *ranks).collect()), key=key)
    expected = []
    for i, t in awkward_rows():
        ids = np.array(other.encode_ordinary(t or ""), "<u4")
        expected.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), sha(t or "")))
    assert got == sorted(expected, key=key)
    assert byte_bpe.round_trip(none, *ranks).count() == 0
    codec = byte_bpe.codec(*ranks)
    r = random.Random(4)
    parts = ["a", "'s", " ", "  ", "\n", "\t", "é", "日本", "0", "!", "😀", "\xa0", "\x85", "\x1c", "the", "-", "\r\n", " "]
    texts = ["".join(r.choices(parts, k=r.randrange(40))) for _ in range(3000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode_all([t.encode() for t in texts])] == [other.encode_ordinary(t) for t in texts]


def test_bpe_with_a_pattern_that_crosses_white_space(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    pattern = r"[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks[0], "rb"))}
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    r = random.Random(9)
    parts = ["a", "the", " ", "  ", "\n", "\r\n", "!", "...", "12345", "é", "日本", "\t"]
    texts = ["", *("".join(r.choices(parts, k=r.randrange(40))) for _ in range(1500))]
    got = byte_bpe.Codec(ranks[0], pattern).encode_all([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [other.encode_ordinary(t) for t in texts]


def test_bpe_offsets_and_split_characters(docs, ranks):
    rows = byte_bpe.encode(docs, *ranks)
    texts = byte_bpe.decode(rows, *ranks).collect()
    assert sorted(((r["doc_id"], r["decoded"]) for r in texts), key=key) == sorted(((i, t or "") for i, t in awkward_rows()), key=key)
    codec = byte_bpe.codec(*ranks)
    for r in rows.filter("doc_id = 9").collect():
        text = dict(awkward_rows())[9]
        for i, a, z in zip(r["ids"], r["starts"], r["ends"], strict=True):
            assert codec.tokens[i].decode("utf-8", "ignore") in text[a:z]
        assert r["starts"][0] == 0 and r["ends"][-1] == len(text)
        assert "".join(codec.decode_stream([x] for x in r["ids"])) == text
    assert list(codec.decode_stream([codec.tokenizer.encode("😀").ids[:1]])) == ["", "�"]


def test_bpe_pieces_of_long_texts(ranks, monkeypatch):
    codec = byte_bpe.Codec(*ranks)
    text = " ".join(words(3000, 21)).encode() + "  x \n y\n".encode() + b"z" * 300
    whole = list(codec.encode_all([text]))
    monkeypatch.setattr(byte_bpe, "PIECE_BYTES", 50)
    monkeypatch.setattr(byte_bpe, "CACHE_ROWS", 40)
    assert list(byte_bpe.Codec(*ranks).encode_all([text, b"", text])) == [whole[0], b"", whole[0]]


# substring dedup


def test_repeated_passages_are_found(spark, none):
    clean = [(k, " ".join(words(300, 700 + k, 4000))) for k in range(20)]
    passage = words(80, 3, 4000)
    rows = [*clean, (50, " ".join(words(120, 41, 4000) + passage + words(90, 42, 4000))), (60, " ".join(words(33, 43, 4000) + passage + words(7, 44, 4000)))]
    found = substring_dedup.repeats(frame(spark, rows, CLASH)).collect()
    assert [(r["doc_id"], r["first_id"]) for r in found] == [(60, 50)]
    text = dict(rows)[60]
    span = text[found[0]["start"] : found[0]["start"] + found[0]["n_chars"]]
    assert span in " ".join(passage) + " " + rows[-1][1] and span in dict(rows)[50] and len(span) >= 200
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.without_repeats(frame(spark, rows)).collect()}
    assert cut[60] == text.replace(span, "") and cut[50] == dict(rows)[50]
    assert substring_dedup.repeats(none).count() == 0


def plain_chunk_ends(b):
    """Ends by the definition, byte by byte."""
    table = substring_dedup._GEAR.tolist()
    value = lambda e: sum(table[b[e - 1 - k]] << k for k in range(min(16, e))) & 0xFFFFFFFF
    legal = lambda e: e == len(b) or (b[e] & 0xC0) != 0x80
    ends, last, e = [], 0, 0
    while last < len(b):
        e = next((x for x in range(last + 12, min(last + 128, len(b) - 1) + 1) if legal(x) and value(x) < 2**32 // 16), None)
        if e is None:
            e = len(b) if len(b) - last <= 128 else min((x for x in range(last + 12, last + 129) if legal(x)), key=lambda x: (value(x), x))
        ends.append(e)
        last = e
    return ends


def plain_repeats(rows, least=80):
    """(id, text, first id, start, length) of spans, by a dictionary of chunks."""
    held = {(i, t) for i, t in rows if i is not None and t}
    pieces = {x: [(a, z) for ends in [plain_chunk_ends(x[1].encode())] for a, z in zip([0, *ends], ends, strict=False)] for x in held}
    first = {}
    for (i, t), own in pieces.items():
        for a, z in own:
            c = t.encode()[a:z]
            first[c] = min(i, first.get(c, i))
    out = set()
    for (i, t), own in pieces.items():
        b, at = t.encode(), None
        for a, z in [*own, (None, None)]:
            source = None if a is None or first[b[a:z]] >= i else first[b[a:z]]
            if source is not None and at is None:
                at, begin = source, a
            if source is None and at is not None:
                end = len(b) if a is None else a
                if len(b[begin:end].decode()) >= least:
                    out.add((i, t, at, len(b[:begin].decode()), len(b[begin:end].decode())))
                at = None
    return out


def test_repeats_equal_brute_force(spark):
    p, x, q = (" ".join(words(60, k, 4000)) for k in (900, 901, 902))
    rows = [r for r in awkward_rows() if r[0] != 12]
    rows += [(40, f"{x} {p}"), (41, f"{x} {p}"), (41, f"{q} {x}"), (41, f"{q} {x}"), (42, "é" * 300 + p), (43, f"{p} {p}"), (44, "ab " * 200), (45, "other text before " + "ab " * 200), (None, f"{x} {p}")]
    texts = {}
    for r in frame(spark, rows).select("doc_id", "text", F.xxhash64("text").alias("h")).collect():
        texts[r["h"]] = r["text"]
    got = [(r["doc_id"], texts[r["text_hash"]], r["first_id"], r["start"], r["n_chars"]) for r in substring_dedup.repeats(frame(spark, rows, CLASH)).collect()]
    expected = plain_repeats(rows)
    assert len(got) == len(set(got)) and set(got) == expected
    assert any(i == 45 for i, *_ in got)
    cut = sorted(((r["doc_id"], r["text"]) for r in substring_dedup.without_repeats(frame(spark, rows, CLASH)).collect()), key=key)
    left = []
    for i, t in rows:
        for _, _, _, a, n in sorted((e for e in expected if e[:2] == (i, t)), key=lambda e: -e[3]):
            t = t[:a] + t[a + n :]
        left.append((i, t))
    assert cut == sorted(left, key=key)


def test_periodic_passages_are_found(spark):
    for word in ("same ", "a", "abcdefghijk ", "日本 "):
        rows = [(1, " ".join(words(40, 1)) + " " + word * 60 + " ".join(words(30, 2))), (2, " ".join(words(33, 3)) + "x" + word * 60 + " ".join(words(10, 4)))]
        found = substring_dedup.repeats(frame(spark, rows), least_chars=40).collect()
        assert [r["doc_id"] for r in found] == ([2] if len(word) > 1 else []), word


def test_chunks_cover_texts_and_resist_shifts(docs):
    for _, t in awkward_rows():
        b = (t or "").encode()
        ends = substring_dedup.chunk_ends(b)
        assert ends == sorted(set(ends)) and (ends[-1] == len(b) if b else not ends)
        for a, z in zip([0, *ends], ends, strict=False):
            b[a:z].decode()
            assert z - a <= substring_dedup.MAX_BYTES + 11
    long = " ".join(words(4000, 77, 4000)).encode()
    a = {x for x in np.split(np.frombuffer(long, np.uint8), substring_dedup.chunk_ends(long)) for x in [x.tobytes()]}
    shifted = b"inserted " + long
    b = {x.tobytes() for x in np.split(np.frombuffer(shifted, np.uint8), substring_dedup.chunk_ends(shifted))}
    assert len(a & b) > 0.97 * len(a)
    found = {r["doc_id"] for r in substring_dedup.repeats(docs).collect()}
    assert {2, 3, 11, 19} <= found and not found & {1, 10, 12, 7, None}


# decontamination

ITEMS = [(1, " ".join(words(70, 2)[10:40])), (2, "one two"), (3, None), (4, ""), (5, "ONE, two!"), (None, " ".join(words(70, 2)[45:60])), (6, " ".join(words(25, 99))), (7, "same same same same same same same same same same same same")]


@pytest.mark.parametrize("sizes", [(1_000_000, 1_000_000), (200, 1_000_000), (1_000, 20)])
def test_decontamination_equals_brute_force(spark, docs, sizes):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontamination.scan(docs, bench, shard_words=sizes[0], block_words=sizes[1])
    got = sorted(((r["doc_id"], r["n_words"], sum(z - a for a, z in zip(r["run_starts"], r["run_ends"], strict=True)), sorted(r["items"])) for r in found.collect()), key=key)
    expected = []
    for i, t in awkward_rows():
        n, hit, ids = contamination(t if i != 12 else " ".join(bench_words(t)), ITEMS) if i != 12 else brute_long(t)
        expected.append((i, n, hit, sorted(ids)))
    assert got == sorted(expected, key=key)
    clean = decontamination.clean_rows(docs, bench, shard_words=sizes[0], block_words=sizes[1])
    assert clean.schema == docs.schema
    assert sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=key) == sorted(((i, t) for (i, t), e in zip(awkward_rows(), expected, strict=True) if not e[2]), key=key)


def brute_long(text):
    found = bench_words(text)
    by_start = {}
    for k, w in enumerate(found):
        by_start.setdefault(w, []).append(k)
    hit, ids = set(), set()
    for item, t in ITEMS:
        own = bench_words(t)
        n = min(10, len(own))
        for a in range(len(own) - n + 1 if n else 0):
            for b in by_start.get(own[a], ()):
                if found[b : b + n] == own[a : a + n]:
                    hit.update(range(b, b + n))
                    ids.add(item)
    return len(found), len(hit), {x for x in ids if x is not None}


def test_index_can_be_stored_and_searched(spark, docs, tmp_path):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    decontamination.build_index(docs, shard_words=500).write.parquet(str(tmp_path / "index"))
    stored = decontamination.search_index(spark.read.parquet(str(tmp_path / "index")), bench)
    assert sorted(map(str, decontamination.digests(stored).collect())) == sorted(map(str, decontamination.digests(decontamination.scan(docs, bench)).collect()))


def test_equal_rows_stay_apart_with_several_blocks(spark, tmp_path):
    text = " ".join(words(70, 2)[10:40])
    rows = frame(spark, [(1, text)] * 4).repartition(4)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    decontamination.build_index(rows, shard_words=1).write.parquet(str(tmp_path / "index"))
    for found in (decontamination.scan(rows, bench, block_words=10), decontamination.search_index(spark.read.parquet(str(tmp_path / "index")), bench, block_words=10)):
        assert [(r["doc_id"], r["n_hit"]) for r in decontamination.digests(found).collect()] == [(1, 30)] * 4
    assert decontamination.clean_rows(rows.unionByName(frame(spark, [(2, "no such words")] * 3)), bench, block_words=10).count() == 3


def near(text, items, width=10, slack=2):
    """Items of which some window has a start from which all its words stand within ``slack`` of their places."""
    found, out = bench_words(text), set()
    for key_, item in items:
        own = bench_words(item)
        n = min(width, len(own))
        for a in range(len(own) - n + 1 if n else 0):
            if any(all(w in found[max(0, s + k - slack) : max(0, s + k + slack + 1)] for k, w in enumerate(own[a : a + n])) for s in range(-slack, len(found) + slack)):
                out.add(key_)
    return out - {None}


def test_proximity_equals_brute_force(spark):
    r = random.Random(3)
    items = [(k, " ".join(words(3 + k % 14, 50 + k, 30))) for k in range(12)]
    rows = []
    for k in range(60):
        base = words(25, 200 + k, 30) + items[k % 12][1].split() + words(10, 300 + k, 30)
        for _ in range(k % 5):
            base.insert(r.randrange(len(base)), "q")
        rows.append((k, " ".join(base)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: set(r["near_items"]) for r in decontamination.scan(frame(spark, rows), bench, shard_words=150).collect()}
    assert got == {i: near(t, items) for i, t in rows}


def test_proximity_matches_allow_words_between(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta"), (2, "alpha beta x gamma delta epsilon zeta"), (3, "zeta q q q q q q alpha beta gamma")]
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_items"], r["n_near_items"]) for r in decontamination.digests(decontamination.scan(frame(spark, rows), bench)).collect()}
    assert got == {1: (1, 0), 2: (0, 1), 3: (0, 0)}


def test_decontamination_of_nothing(spark, docs, none):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontamination.scan(none, bench).count() == 0
    free = decontamination.digests(decontamination.scan(docs, bench.filter("false")))
    assert free.filter("contaminated or n_hit > 0").count() == 0 and free.count() == len(awkward_rows())
    assert decontamination.clean_rows(docs, bench.filter("false")).count() == len(awkward_rows())


# secrets


def plain_ratios(rows):
    """Log-likelihood ratio by pair of characters, counted one by one; rows are (label, token, n)."""
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
    share = {}
    for label in ("random", "ordinary", "corpus"):
        seen = {}
        for own, token, n in rows:
            for a, b in zip(token, token[1:], strict=False) if own == label else ():
                seen[a + b] = seen.get(a + b, 0) + n
        share[label] = {k: v / sum(seen.values()) for k, v in seen.items()}
    part = 0.3 if share["corpus"] else 0
    out = {}
    for a in alphabet:
        x = [1e6 * share["random"].get(a + b, 0) + 0.5 for b in alphabet]
        y = [1e6 * ((1 - part) * share["ordinary"].get(a + b, 0) + part * share["corpus"].get(a + b, 0)) + 0.5 for b in alphabet]
        out |= {a + b: math.log(p / sum(x)) - math.log(q / sum(y)) for b, p, q in zip(alphabet, x, y, strict=True)}
    return out


def test_markov_spans_equal_brute_force(spark, docs):
    labelled = secret_scan.samples(spark, docs, rows=500)
    ratios = plain_ratios([tuple(r) for r in labelled.collect()])
    got = {(r[0], r[1]): {x for x in r[2].split(",") if x.startswith("markov")} for r in secret_scan.digests(secret_scan.scan(docs, secret_scan.train(labelled)).withColumn("doc_id", F.struct("doc_id", F.coalesce("text", F.lit(""))))).select("doc_id.*", "spans").collect()}
    for i, t in awkward_rows():
        expected = set()
        for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", t or ""):
            if sum(ratios[a + b] for a, b in zip(m[0], m[0][1:], strict=False)) > 0.35 * (len(m[0]) - 1):
                expected.add(f"markov:{m.start()}:{m.end()}")
        assert got[i, t or ""] == expected


def test_held_out_strings_are_told_apart(spark):
    model = secret_scan.train(secret_scan.samples(spark))
    rows = [r for r in secret_scan.labelled_strings(spark, 2000, first=1_000_000).collect() if len(r["token"]) >= secret_scan.LEAST_TOKEN]
    flagged = [(r["label"], model.score(r["token"]) > secret_scan.THRESHOLD) for r in rows]
    right = flagged.count(("random", True))
    assert right / max(1, sum(f for _, f in flagged)) > 0.995 and right / sum(x == "random" for x, _ in flagged) > 0.995
    for token in ("123e4567-e89b-12d3-a456-426614174000", "2024-01-01-2024-12-31-0001", "0" * 24, "GATTACAGATTACAGATTACACC", "release-v1-2-3-build-20240131", "ff8800-00ff88-0088ff-ff0088"):
        assert model.score(token) < secret_scan.THRESHOLD
    assert model.score("3fJk9QpLx7Zt2Vb8Nm4Rw6Yc1") > secret_scan.THRESHOLD


def test_many_secrets_are_redacted(spark):
    pieces = [f"word{k} token=abcdefgh{k:05d} " for k in range(2000)]
    text = "é" + "".join(pieces) + "end"
    model = secret_scan.train(secret_scan.samples(spark, rows=200))
    got = secret_scan.redacted(frame(spark, [(1, text)]), model).first()["text"]
    assert got == "é" + "".join(f"word{k} [SECRET] " for k in range(2000)) + "end"


def test_secret_spans_equal_python(spark, docs, none):
    model = secret_scan.train(secret_scan.samples(spark, docs))
    got = sorted(map(tuple, secret_scan.digests(secret_scan.scan(docs, model)).collect()), key=key)
    expected = []
    for i, t in awkward_rows():
        found = secret_spans(t)
        expected.append((i, *(sum(x[3] == k for x in found) for k in ("assign", "access", "hex")), sha(",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in found))))
    assert [r[:5] for r in got] == sorted(expected, key=key)
    spans = {r[0]: r[5] for r in got}
    text = dict(awkward_rows())[20]
    first = text.index("3fJk")
    assert f"markov:{first}:{first + 25}" in spans[20]
    assert spans[12] == "" and spans[16] == "" and spans[1] == ""
    assert secret_scan.scan(none, model).count() == 0
    clean = secret_scan.redacted(docs, model)
    assert clean.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert texts[20] == "ab  cd\n\n\nef  [SECRET] [SECRET]" and texts[1] == dict(awkward_rows())[1]
    assert texts[15].count("[SECRET]") == 3 and "hunter2" not in texts[15] and "AKIA" not in texts[15]


def test_many_secrets_in_one_text(spark):
    text = " é ".join(f"token={k:012d}" for k in range(1500))
    model = secret_scan.train(secret_scan.samples(spark))
    (row,) = secret_scan.digests(secret_scan.scan(frame(spark, [(1, text)]), model)).collect()
    assert row["spans"] == ",".join(f"assign:{a}:{z}" for a, _, z, _ in secret_spans(text))


def test_markov_models_tell_random_from_ordinary(spark):
    model = secret_scan.train(secret_scan.samples(spark))
    r = random.Random(8)
    odd = ["".join(r.choices(secret_scan.ALPHABET[:62], k=30)) for _ in range(300)]
    plain = ["_".join(r.choices(secret_scan.WORDS.split(), k=4)) for _ in range(300)]
    assert np.mean([model.score(x) > secret_scan.THRESHOLD for x in odd]) > 0.99
    assert np.mean([model.score(x) > secret_scan.THRESHOLD for x in plain]) < 0.01


def test_awkward_license_line_is_there():
    assert any(t and LICENSE_LINE in t for _, t in awkward_rows())
