"""Secret scan with DataFrame operations only.

Fixed patterns find assignments, access keys and hex strings.  Beside them, two
character Markov models, one of random strings and one of ordinary
identifiers, are trained from labelled samples, with the short tokens of all
documents among the ordinary ones; a token whose log-likelihood ratio says it
is random is reported too.

The scan is a projection: nothing is shuffled, and a row's result depends on
its own text and the model.  Regular expressions other than the token search
run only on texts that hold what their matches must hold.

Positions come from lengths: matches and the text between them, in turn, are
the text.  Their running sum goes by runs of CHUNK, so that its cost stays near
the number of matches where arrays can only be copied.

Defined results: a null text is an empty one and has no spans; kinds are
searched apart, so spans of different kinds may overlap; an empty table gives
no rows; repeated rows give equal results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resonara.llm.common import free_name

# Kind, pattern, the group whose length counts, its least length, what a match must hold (in lower case).
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, ("passw", "secret", "token", "api")),
    ("access", r"AKIA[A-Z0-9]+", 0, 16, ("akia",)),
    ("hex", r"[0-9a-f]{32,}", 0, 32, ()),
)
MODEL_KIND = "markov"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
LEAST_TOKEN = 20
CORPUS_TOKEN = r"[A-Za-z0-9+/_=-]{4,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Natural-log likelihood ratio, a character, from which a token counts as random.
THRESHOLD = 0.35
CHUNK = 256

#: Labelled strings that are made: random ones, and three times as many ordinary ones.
RANDOM_STRINGS = 6000
#: What pair counts of a label are scaled to, so that smoothing weighs alike at every size, and the corpus's part of the ordinary ones.
PAIR_MASS, CORPUS_PART = 1_000_000, 0.3

# Ordinary words of identifiers.
WORDS = (
    "access account action active address admin alert array async auth balance base batch binary block body bool branch "
    "buffer build button byte cache call cancel channel check class clear client close cluster code collect color column "
    "command commit common compare config connect console content context control convert copy count create current cursor "
    "data database date debug decode default delete depth detail device direct display document domain double download "
    "element email empty enable encode engine entry error event except execute exit export factory field file filter final "
    "find first float folder format frame function global graph group handle handler hash header height hidden host image "
    "import index info init input insert instance integer interface item join json kernel label language last layer layout "
    "length level library limit line link list load local lock logger login logout main manager map matrix member memory "
    "merge message method metric mode model module name network next node note notify null number object offset open option "
    "order output owner package page panel parameter parent parse password path pattern permission pipeline pixel plugin "
    "point policy pool port position prefix print process profile project property protocol provider proxy public query "
    "queue random range rate read record region register remote remove render replace report request reset resource response "
    "result return role root route rule sample scale schedule schema scope score screen script search secret section select "
    "send serial server service session settings shape shared signal simple single size socket sort source split stack stage "
    "start state static status step storage store stream string style submit suffix summary support switch symbol sync system "
    "table target task template test text thread time title token total trace track train transfer tree trigger type unique "
    "unit update upload user util valid value vector version view visible wait warning weight widget width window worker wrap write zone"
)


def labelled_strings(spark: SparkSession, rows: int, first: int = 0) -> DataFrame:
    """Made samples (label, kind, token): ``rows`` random strings and three times as many ordinary ones, by numbers from ``first`` on.

    Random strings are digests in base 64, in its URL form, in letters and
    digits, and in capitals and digits.  Ordinary ones are identifiers of WORDS
    in four styles, UUIDs, dates, numbers, runs of one character, nucleotides,
    paths with versions and lists of hex colours.  Other numbers give other strings: a held-out set.
    """
    n, digest = F.col("id"), F.sha2(F.col("id").cast("string"), 256)
    plain = F.base64(F.unhex(digest))
    bare = F.regexp_replace(plain, "[+/=]", "")
    made = F.element_at(F.array(plain, F.rtrim(F.translate(plain, "+/", "-_"), F.lit("=")), bare, F.upper(bare)), (n % 4 + 1).cast("int"))
    length = F.element_at(F.array(*[F.lit(x) for x in (44, 40, 32, 24)]), (F.floor(n / 4) % 4 + 1).cast("int"))
    random = spark.range(first, first + rows).select(F.lit("random").alias("label"), (n % 4).cast("int").alias("kind"), F.substring(made, F.lit(1), length).alias("token"))

    words, size = F.split(F.lit(WORDS), " "), len(WORDS.split())
    some = lambda salt, below: (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt} "), n.cast("string")), 256), 1, 8), 16, 10).cast("long") % below).cast("int")
    hexes = F.sha2(F.concat(F.lit("ordinary "), n.cast("string")), 256)
    several = F.slice(F.array(*[F.get(words, some(k, size)) for k in range(5)]), 1, some(5, 5) + 1)
    cut = lambda at, length: F.substring(hexes, at, length)
    number = F.when(some(6, 3) == 0, some(7, 1000).cast("string")).otherwise("")
    date = lambda salt: F.concat_ws("-", 2000 + some(salt, 30), F.lpad((some(salt + 1, 12) + 1).cast("string"), 2, "0"), F.lpad((some(salt + 2, 28) + 1).cast("string"), 2, "0"))
    kinds = [
        F.concat(F.array_join(several, "_"), number),
        F.concat(F.array_join(F.transform(several, F.initcap), ""), number),
        F.concat(F.array_join(several, "-"), number),
        F.concat(F.upper(F.array_join(several, "_")), F.lit("_"), number),
        F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12)),
        F.concat_ws("-", date(10), date(20), F.lpad(some(30, 10_000).cast("string"), 4, "0")),
        F.when(some(8, 4) == 0, F.repeat(F.substring(F.lit(ALPHABET), some(34, len(ALPHABET)) + 1, F.lit(1)), some(9, 20) + 20)).otherwise(F.substring(F.translate(hexes, "abcdef", "012345"), F.lit(1), some(9, 20) + 20)),
        F.substring(F.translate(hexes, "0123456789abcdef", "ACGTACGTACGTACGT"), F.lit(1), some(9, 40) + 20),
        F.concat(F.array_join(several, "/"), F.lit("/v"), some(31, 20).cast("string"), F.lit("-"), some(32, 20).cast("string"), F.lit("-"), some(33, 100).cast("string")),
        F.concat_ws("-", cut(1, 6), cut(7, 6), cut(13, 6), cut(19, 6)),
    ]
    kind = (n % len(kinds)).cast("int")
    ordinary = spark.range(3 * first, 3 * (first + rows)).select(F.lit("ordinary").alias("label"), kind.alias("kind"), F.element_at(F.array(*kinds), kind + 1).alias("token"))
    return random.union(ordinary)


def samples(spark: SparkSession, docs: DataFrame | None = None, text: str = "text", rows: int = RANDOM_STRINGS) -> DataFrame:
    """Samples with their numbers (label, token, n): made strings and, as label ``corpus``, the short tokens of all documents.

    Tokens of LEAST_TOKEN characters or more, which the model is to judge, are
    left out of the corpus's; the others, ordinary but for a few, are summed on
    the map side.
    """
    labelled = labelled_strings(spark, rows).select("label", "token", F.lit(1).cast("long").alias("n"))
    if docs is None:
        return labelled
    tokens = docs.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(CORPUS_TOKEN), 0)).alias("token"))
    short = tokens.filter(F.length("token") < LEAST_TOKEN).groupBy("token").agg(F.count("*").alias("n"))
    return labelled.union(short.select(F.lit("corpus"), "token", "n"))


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratio of every pair of neighbours, by ``128 * first + second``."""

    ratios: tuple[float, ...]

    def score(self, token: str) -> float:
        """What the Spark expression computes, a character; for tests and notebooks."""
        return sum(self.ratios[128 * ord(a) + ord(b)] for a, b in zip(token, token[1:], strict=False)) / max(1, len(token) - 1)

    def column(self) -> Column:
        return F.split(F.lit(",".join(f"{x:.6f}" for x in self.ratios)), ",").cast("array<double>")


def train(labelled: DataFrame, smoothing: float = 0.5, corpus_part: float = CORPUS_PART) -> Model:
    """Both Markov models from labelled tokens (label, token and, if there is one, their number n).

    The driver gets pair counts, at most 3 * 67 * 67 rows.  The counts of a
    label are scaled to PAIR_MASS; with a corpus, ordinary pairs are made and
    corpus ones in the parts 1 - ``corpus_part`` and ``corpus_part``.
    """
    codes = F.transform(F.split(F.col("token"), ""), F.ascii)
    pairs = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: 128 * a + b)
    legal = labelled.filter(F.col("token").rlike(r"^[A-Za-z0-9+/_=-]{2,}$"))
    times = F.col("n") if "n" in labelled.columns else F.lit(1).cast("long")
    counted = legal.select("label", times.alias("n"), F.explode(pairs).alias("pair")).groupBy("label", "pair").agg(F.sum("n").alias("n")).collect()
    letters = [ord(x) for x in ALPHABET]
    raw: dict[str, dict[int, int]] = {"random": {}, "ordinary": {}, "corpus": {}}
    for label, pair, n in counted:
        if label in raw:
            raw[label][pair] = n
    shares = {label: {pair: n / sum(own.values()) for pair, n in own.items()} for label, own in raw.items()}
    part = corpus_part if shares["corpus"] and shares["ordinary"] else 1.0 if shares["corpus"] else 0.0
    both = {pair: (1 - part) * shares["ordinary"].get(pair, 0) + part * shares["corpus"].get(pair, 0) for pair in shares["ordinary"].keys() | shares["corpus"].keys()}
    ratios = [0.0] * (128 * 128)
    for a in letters:
        log = {}
        for label, own in (("random", shares["random"]), ("ordinary", both)):
            row = [PAIR_MASS * own.get(128 * a + b, 0) + smoothing for b in letters]
            total = sum(row)
            log[label] = [math.log(x / total) for x in row]
        for b, x, y in zip(letters, log["random"], log["ordinary"], strict=True):
            ratios[128 * a + b] = round(x - y, 6)
    return Model(tuple(ratios))


def _running(items: Column, first: Column) -> Column:
    """items (structs of gap, own, keep) -> structs of start, end, keep, ``first`` code points on."""
    none = F.array().cast("array<struct<start:int,end:int,keep:boolean>>")

    def step(state: Column, item: Column) -> Column:
        start = state["at"] + item["gap"]
        end = start + item["own"]
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end"), item["keep"].alias("keep")))).alias("out"))

    return F.aggregate(items, F.struct(first.alias("at"), none.alias("out")), step, lambda s: s["out"])


def _spans(text: Column, found: str, keep) -> Column:
    """Structs of start, end and keep of every match, in code points; ``keep`` gets the whole matches and says which stay."""
    own = F.regexp_extract_all(text, F.lit(found), 0)
    gaps = F.split(text, found, -1)
    items = F.zip_with(F.zip_with(F.slice(gaps, 1, F.size(own)), own, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("own"))), keep(own), lambda x, k: F.struct(x["gap"].alias("gap"), x["own"].alias("own"), k.alias("keep")))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / CHUNK).cast("int")), lambda c: F.slice(items, c * CHUNK + 1, F.lit(CHUNK)))
    sums = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda a, x: a + x["gap"] + x["own"]))
    begins = F.aggregate(sums, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    return F.filter(F.flatten(F.zip_with(runs, F.slice(begins, 1, F.size(runs)), _running)), lambda s: s["keep"])


def _fixed(text: Column, found: str, group: int, least: int) -> Column:
    return _spans(text, found, lambda own: F.transform(F.regexp_extract_all(text, F.lit(found), group) if group else own, lambda x: F.length(x) >= least))


def _random(token: Column, ratios: Column, threshold: float) -> Column:
    codes = F.transform(F.split(token, ""), F.ascii)
    ratio = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: F.get(ratios, 128 * a + b))
    return F.aggregate(ratio, F.lit(0.0), lambda a, x: a + x) > threshold * (F.length(token) - 1)


def scan(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD, into: str = "secret_spans") -> DataFrame:
    """``docs`` with a column ``into``: structs of start, rank, end and kind, in order of start, then rank.

    A column of ``docs`` that has that name gives way to it.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(own)
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    parts = []

    def labelled(spans: Column, rank: int, kind: str) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    for rank, (kind, found, group, least, holds) in enumerate(KINDS):
        has = own.rlike(found)
        for k, x in enumerate(holds):
            any_of = low.contains(x) if not k else any_of | low.contains(x)
        has = any_of & has if holds else has
        parts.append(F.when(has, labelled(_fixed(own, found, group, least), rank, kind)).otherwise(none))
    ratios = model.column()
    odd = F.exists(F.regexp_extract_all(own, F.lit(TOKEN), 0), lambda t: _random(t, ratios, threshold))
    found_random = _spans(own, TOKEN, lambda m: F.transform(m, lambda t: _random(t, ratios, threshold)))
    parts.append(F.when(odd, labelled(found_random, len(KINDS), MODEL_KIND)).otherwise(none))
    return docs.withColumn(into, F.sort_array(F.concat(*parts)))


def digests(scanned: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts by kind, a digest of the fixed kinds' spans, and all spans."""
    base = F.filter("secret_spans", lambda s: s["rank"] < len(KINDS))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(rank: int) -> Column:
        return F.size(F.filter("secret_spans", lambda s: s["rank"] == rank)).cast("long")

    counts = [count(r).alias(f"n_{k[0]}") for r, k in enumerate(KINDS)]
    return scanned.select(id_column, *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secret_spans")).alias("spans"))


def redacted(docs: DataFrame, model: Model, text: str = "text", mark: str = "[SECRET]", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with each run of overlapping spans replaced by ``mark``; other columns and texts without spans stay as they are."""
    columns = docs.columns
    into = free_name("secret_spans", columns)
    spans = scan(docs, model, text, threshold, into)
    found = F.col(into)
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / CHUNK).cast("int")), lambda c: F.slice(found, c * CHUNK + 1, F.lit(CHUNK)))
    # Where each run's text begins and the last ends: the greatest end so far.
    tops = F.aggregate(runs, F.array(F.lit(0)), lambda a, r: F.concat(a, F.array(F.greatest(F.element_at(a, -1), F.array_max(F.transform(r, lambda s: s["end"]))))))

    def cleaned(run: Column, begin: Column, end: Column) -> Column:
        none = F.array().cast("array<string>")

        def within(own: Column) -> Column:
            def step(state: Column, span: Column) -> Column:
                piece = F.concat(F.substr(own, state["at"] - begin + 1, span["start"] - state["at"]), F.lit(mark))
                return F.struct(F.greatest(state["at"], span["end"]).alias("at"), F.when(span["start"] >= state["at"], F.concat(state["out"], F.array(piece))).otherwise(state["out"]).alias("out"))

            return F.aggregate(run, F.struct(begin.alias("at"), none.alias("out")), step, lambda s: F.array_join(s["out"], ""))

        # A single-element array binds the run's own text, so that spans are cut out of that.
        return F.transform(F.array(F.substr(F.col(text), begin + 1, end - begin)), within)[0]

    bounds = F.zip_with(F.slice(tops, 1, F.size(tops) - 1), F.slice(tops, 2, F.size(tops) - 1), lambda a, b: F.struct(a.alias("begin"), b.alias("end")))
    bodies = F.zip_with(runs, bounds, lambda r, x: cleaned(r, x["begin"], x["end"]))
    clean = F.concat(F.array_join(bodies, ""), F.substr(F.col(text), F.element_at(tops, -1) + 1, F.lit(2**31 - 1)))
    return spans.withColumn(text, F.when(F.size(into) > 0, clean).otherwise(F.col(text))).select(*columns)
