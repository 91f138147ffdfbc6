"""Rewriting charts after a reduction: which files stay, their new identifiers, and every line.

All operators keep charts apart by ``path``; a chart has at most 3,844
identifiers, which bounds its map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resonara.functions import ids, text
from resonara.operators.ranking import group_rank
from resonara.sources import charts


def reduced(files: DataFrame, replaces: DataFrame, start: int, end: int) -> DataFrame:
    """Files with ``reduced``, the number that their chart's table (path, num_int, replace_to) replaces them by, or their own; outside the range nothing is replaced."""
    own = ["path", "num_int"]
    met = files.join(replaces.select(*own, "replace_to"), own, "left")
    stands = F.col("num_int").between(start, end) & (F.col("replace_to") > 0)
    return met.withColumn("reduced", F.when(stands, F.col("replace_to")).otherwise(F.col("num_int"))).drop("replace_to")


def kept(files: DataFrame, replaces: DataFrame, start: int, end: int) -> DataFrame:
    """path, place (order of first use) and the representative's idx, num_int and name for each reduced number.

    The representative is the first file of that number; a number without a file has none.
    """
    first_use = reduced(files, replaces, start, end).groupBy("path", "reduced").agg(F.min("idx").alias("place"))
    own = files.groupBy("path", "num_int").agg(F.min_by(F.struct("idx", "name"), "idx").alias("file"))
    met = first_use.join(own, (first_use["path"] == own["path"]) & (F.col("reduced") == F.col("num_int")))
    return met.select(first_use["path"], "place", "num_int", F.col("file.idx").alias("idx"), F.col("file.name").alias("name"))


def renumbered(kept_files: DataFrame, sort: bool = True) -> DataFrame:
    """Kept files with ``new_num``: 1, 2, ... by name whatever the case, in base 36 if it has room, else 62; an error beyond that."""
    order = ["_upper", "place"] if sort else ["place"]
    ranked = group_rank(kept_files.withColumn("_upper", F.upper("name")), ["path"], order, "_new")
    sized = ranked.withColumn("_count", F.count("*").over(Window.partitionBy("path")))
    wide = F.col("_count") > ids.LARGEST[36]
    new = F.when(wide, ids.encode(F.col("_new"), 62)).otherwise(ids.encode(F.col("_new"), 36))
    return sized.withColumn("new_num", ids.or_fail(new, F.col("_new"), "no identifier left for")).withColumn("new_int", F.col("_new").cast("int")).drop("_new", "_count", "_upper")


def final_map(files: DataFrame, replaces: DataFrame, numbered: DataFrame, start: int, end: int) -> DataFrame:
    """path, num and new_num of every file whose representative was kept; of files with one identifier the last counts."""
    new = numbered.select("path", F.col("num_int").alias("reduced"), "new_num")
    met = reduced(files, replaces, start, end).join(new, ["path", "reduced"])
    return met.groupBy("path", "num").agg(F.max_by("new_num", "idx").alias("new_num"))


def replaced_tokens(data: Column, table: Column) -> Column:
    """Two-character tokens of ``data`` by a table (see ``tables_of``); 00, unknown tokens and a last single character stay."""
    return F.array_join(F.transform(F.regexp_extract_all(data, F.lit("..?"), 0), lambda x: F.when(x == "00", x).otherwise(F.coalesce(F.get(table, ids.decode(x, 62)), x))), "")


def changed_line(line: Column, table: Column) -> Column:
    """A data line of a sound channel, in hexadecimal of either case, with its tokens replaced; any other line, or any without a table, as it is."""
    part = lambda k: F.regexp_extract(line, charts.DATA, k)
    changes = line.rlike(charts.DATA) & charts.is_sound_channel(part(3)) & table.isNotNull()
    return F.when(changes, F.concat(part(1), part(2), part(3), part(4), replaced_tokens(part(5), table))).otherwise(line)


def tables_of(mapping: DataFrame) -> DataFrame:
    """path and table: at the base-62 number of an identifier what replaces it, or null.

    An array finds a token at once, where Spark's maps are searched entry by entry.
    """
    entries = mapping.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("num", "new_num"))).alias("_map"))
    numbers = F.sequence(F.lit(0), F.lit(ids.LARGEST[62]))
    return entries.select("path", F.transform(numbers, lambda k: F.try_element_at("_map", ids.encode(k, 62))).alias("table"))


def rewritten(lines: DataFrame, mapping: DataFrame, numbered: DataFrame, folder: str | None = None) -> DataFrame:
    """path, line_no and line of the new charts.

    New definitions stand at the first definition or, if a data line comes
    earlier or there is none, before the first data line, else at the end; old
    definitions go.  Other lines pass, data lines with their tokens replaced.
    Old and new lines of a chart meet in one exchange, in which all of this is
    decided; definitions of a chart without lines are left out.
    """
    kind = charts.line_class(F.col("line"))
    old = (kind == "HEADER") & charts.is_definition(F.col("line"))
    marked = lines.select("path", F.col("line_no").alias("_line"), F.lit(2**31 - 1).alias("_sub"), "line", old.alias("_old"), (old | (kind == "MAIN")).alias("_anchor"))
    name = F.col("name") if folder is None else text.relative(F.col("name"), F.lit(folder))
    new = numbered.select("path", F.lit(None).cast("long").alias("_line"), F.col("new_int").alias("_sub"), F.concat(F.lit("#WAV"), "new_num", F.lit(" "), name).alias("line"), F.lit(False).alias("_old"), F.lit(False).alias("_anchor"))
    chart = Window.partitionBy("path")
    at = F.coalesce(F.min(F.when(F.col("_anchor"), F.col("_line"))).over(chart), F.max("_line").over(chart) + 1)
    together = marked.unionByName(new).withColumn("_at", at).filter(~F.col("_old") & F.col("_at").isNotNull()).withColumn("_place", F.coalesce("_line", "_at"))
    placed = group_rank(together, ["path"], ["_place", "_sub"], "_no").join(tables_of(mapping), "path", "left")
    # New definitions aren't data lines; lines whose channel has a letter are of class OTHER and pass as they are.
    body = F.when(charts.line_class(F.col("line")) == "MAIN", changed_line(F.col("line"), F.col("table"))).otherwise(F.col("line"))
    return placed.select("path", (F.col("_no") - 1).alias("line_no"), body.alias("line"))


def undefined_references(lines: DataFrame, mapping: DataFrame) -> DataFrame:
    """path and id of identifiers that data lines use and no map has; channels in lower case aren't checked."""
    main = lines.filter(charts.line_class(F.col("line")) == "MAIN")
    used = charts.tokens(main, charts.CHECKED_DATA).filter("id <> '00'").select("path", "id").distinct()
    return used.join(mapping.select("path", F.col("num").alias("id")), ["path", "id"], "left_anti")


def unused_files(files: DataFrame, kept_files: DataFrame) -> DataFrame:
    """path and name of files that no kept one has, whatever the case; repeated ones repeat."""
    own = kept_files.select("path", F.lower("name").alias("_low")).distinct()
    return files.select("path", "name").withColumn("_low", F.lower("name")).join(own, ["path", "_low"], "left_anti").select("path", "name")
