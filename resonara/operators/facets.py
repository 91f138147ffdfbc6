"""Words of file names: counts, facets, instruments and filters.

Files have idx and name; with a path, each chart's files are a list of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resonara.functions import text

LEAST_INSTRUMENT, LEAST_FACET, MOST_FACETS = 3, 2, 8


def _chart(rows: DataFrame) -> list[str]:
    return ["path"] if "path" in rows.columns else []


def word_counts(files: DataFrame, least: int = LEAST_INSTRUMENT) -> DataFrame:
    """word (lower case), shown (as first met), cnt and first (where) of words that may name instruments, at least ``least`` times."""
    own = _chart(files)
    found = files.select(*own, "idx", F.posexplode(text.words(text.stem(F.col("name")))).alias("pos", "shown")).filter(text.names_instrument(F.col("shown")))
    place = F.struct("idx", "pos")
    counted = found.groupBy(*own, F.lower("shown").alias("word")).agg(F.min_by("shown", place).alias("shown"), F.count("*").alias("cnt"), F.min(place).alias("first"))
    return counted.filter(F.col("cnt") >= least)


def instruments(files: DataFrame, candidates: DataFrame) -> DataFrame:
    """Files with ``instrument``: of the candidates that are a word of the stem or part of it, the most frequent, the first met on ties; else empty.

    Candidates are words that a list has several times, so a chart's are few:
    they meet its files as one array, in order of preference, and the first
    that a stem contains is taken.
    """
    own = _chart(files)
    listed = candidates.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct((-F.col("cnt")).alias("less"), "first", "word", "shown"))).alias("_listed"))
    # Without a path all files are one list, which has one array.
    met = files.join(listed, own, "left") if own else files.crossJoin(F.broadcast(listed))
    stem = F.lower(text.stem(F.col("name")))
    best = F.get(F.filter("_listed", lambda c: stem.contains(c["word"])), 0)["shown"]
    return met.withColumn("instrument", F.coalesce(best, F.lit(""))).drop("_listed").select(*files.columns, "instrument")


def assigned(files: DataFrame, found: DataFrame) -> DataFrame:
    """Files with the instrument that ``found`` (name, instrument, and path if both have one) gives their name, whatever the case; else empty."""
    own = [c for c in _chart(files) if c in found.columns]
    by_name = found.groupBy(*own, F.lower("name").alias("_low")).agg(F.max("instrument").alias("instrument"))
    return files.withColumn("_low", F.lower("name")).join(by_name, [*own, "_low"], "left").drop("_low").withColumn("instrument", F.coalesce("instrument", F.lit("")))


def detect(files: DataFrame, least: int = LEAST_INSTRUMENT) -> DataFrame:
    """Files with the instruments that their names suggest."""
    return instruments(files, word_counts(files, least))


def _top(counted: DataFrame, least: int, most: int) -> DataFrame:
    """The ``most`` frequent keywords, of each chart if there are charts."""
    own = _chart(counted)
    kept = counted.filter(F.col("cnt") >= least)
    if own:
        rank = F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("cnt"), "first"))
        return kept.withColumn("_rank", rank).filter(F.col("_rank") <= most).select(*own, "keyword", "cnt")
    return kept.orderBy(F.desc("cnt"), "first").limit(most).select("keyword", "cnt")


def prefix_facets(files: DataFrame, least: int = LEAST_FACET, most: int = MOST_FACETS, shortest: int = 3) -> DataFrame:
    """keyword, cnt and is_selected of the most frequent first parts of stems, whatever the case; all start selected."""
    own = _chart(files)
    part = F.get(F.filter(F.split(text.stem(F.col("name")), "[_\\- ]"), lambda p: p != ""), 0)
    parts = files.select(*own, "idx", part.alias("part")).filter(F.length("part") >= shortest)
    counted = parts.groupBy(*own, F.lower("part").alias("low")).agg(F.min_by("part", "idx").alias("keyword"), F.count("*").alias("cnt"), F.min("idx").alias("first"))
    return _top(counted, least, most).withColumn("is_selected", F.lit(True))


def instrument_facets(files: DataFrame, least: int = LEAST_FACET, most: int = MOST_FACETS, shortest: int = 3) -> DataFrame:
    """keyword and cnt of the most frequent instruments, case kept.

    Where fewer than half of ``most`` instruments are known, words of files
    without one enter with a count of 1 each, so they show only if ``least`` is 1.
    """
    own = _chart(files)
    known = files.filter(F.length("instrument") >= shortest).groupBy(*own, F.col("instrument").alias("keyword")).agg(F.count("*").alias("cnt"), F.struct(F.lit(0).alias("late"), F.min("idx").alias("idx"), F.lit(0).alias("pos")).alias("first"))
    if least > 1:
        return _top(known, least, most)
    words = files.filter(F.coalesce("instrument", F.lit("")) == "").select(*own, "idx", F.posexplode(text.words(text.stem(F.col("name")))).alias("pos", "keyword"))
    words = words.filter(text.names_instrument(F.col("keyword"))).join(known, [*own, "keyword"], "left_anti")
    late = words.groupBy(*own, "keyword").agg(F.lit(1).cast("long").alias("cnt"), F.min(F.struct(F.lit(1).alias("late"), "idx", "pos")).alias("first"))
    if own:
        enough = known.groupBy(*own).agg(F.count("*").alias("_n")).filter(F.col("_n") >= most // 2)
        late = late.join(enough.select(*own), own, "left_anti")
    else:
        few = known.agg((F.count("*") < most // 2).alias("few"))
        late = late.crossJoin(F.broadcast(few)).filter("few").drop("few")  # one row
    return _top(known.unionByName(late), least, most)


def shown(name: Column, instrument: Column, typed: str = "", instruments_chosen: list[str] | None = None) -> Column:
    """Filter: the whole name contains the typed text and the instrument is a chosen one, whatever the case; empty choices don't filter."""
    keep = F.lit(True)
    if typed.strip():
        keep = keep & F.lower(name).contains(typed.lower())
    if instruments_chosen:
        keep = keep & F.lower(F.coalesce(instrument, F.lit(""))).isin([x.lower() for x in instruments_chosen])
    return keep


def chosen(name: Column, instrument: Column, keywords: list[str]) -> Column:
    """Filter by chips: a file with an instrument has it among the keywords, another has one in its stem; no keywords keep all."""
    if not keywords:
        return F.lit(True)
    low = [k.lower() for k in keywords]
    stem = F.lower(text.stem(name))
    inside = F.exists(F.array(*[F.lit(k) for k in low]), lambda k: stem.contains(k))
    return F.when(F.coalesce(instrument, F.lit("")) != "", F.lower(instrument).isin(low)).otherwise(inside)


def keyword_by_table(files: DataFrame, keywords: DataFrame) -> DataFrame:
    """idx (and path) and the first keyword (word, ord) in each file's stem; the keyword list is small by contract (a form's choices)."""
    own = _chart(files)
    listed = keywords.agg(F.sort_array(F.collect_list(F.struct("ord", "word"))).alias("listed"))
    met = files.select(*own, "idx", F.lower(text.stem(F.col("name"))).alias("stem")).crossJoin(F.broadcast(listed))
    hit = F.get(F.filter("listed", lambda k: F.col("stem").contains(F.lower(k["word"]))), 0)["word"]
    return met.select(*own, "idx", hit.alias("keyword")).filter(F.col("keyword").isNotNull())


def without(files: DataFrame, removed: DataFrame, key: str = "idx") -> DataFrame:
    """Files but those whose ``key`` is among the removed ones."""
    return files.join(removed.select(key).distinct(), key, "left_anti")


def licences(rows: DataFrame) -> DataFrame:
    """Rows (name, is_app, ...) with their place: the application's own first, then by name.  A list of a few hundred rows, shown whole."""
    placed = rows.withColumn("_late", ~F.coalesce("is_app", F.lit(False)))
    return placed.withColumn("place", F.row_number().over(Window.orderBy("_late", "name"))).drop("_late")


def failures(loaded: DataFrame, most: int = 5) -> DataFrame:
    """The first failed loads, for a warning."""
    return loaded.filter(F.col("sound").isNull()).orderBy("path").limit(most).select("path", "error")
