"""Charts: line-oriented definition files.

Lines are rows of path, line_no and line.  ``#WAVxx name`` defines an
identifier; ``#mmmcc:data`` uses identifiers, two characters each.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resonara.functions import ids, text

# The line forms of the format.
HEADER = r"^#(WAV|BMP|BPM|STOP)[0-9A-Za-z]{2}"
MAIN = r"^#\d{5}:"
DEFINITION = r"^#WAV([0-9A-Za-z]{2})\s+(.+)$"
#: Data lines that are rewritten, and those whose identifiers are checked: only the former take channels in lower case.
DATA = r"^(#)(\d{3})([0-9A-Fa-f]{2})(:)(.+)$"
CHECKED_DATA = r"^(#)(\d{3})([0-9A-Z]{2})(:)(.+)$"
SOUND_CHANNEL = "^(01|[1-6DE][1-9])$"


def _shift_jis(content: pd.Series) -> pd.Series:
    return content.map(lambda b: bytes(b).decode("cp932", "replace"))


def lines_of(content: DataFrame) -> DataFrame:
    """path, line_no and line of texts (path, text); a line end at the end of a text begins no line."""
    lines = F.split("text", "\r\n|\r|\n")
    whole = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    return content.select("path", F.posexplode(whole).alias("line_no", "line"))


def read(spark: SparkSession, paths: str | list[str], encoding: str = "shift_jis") -> DataFrame:
    """Lines of chart files; Spark reads them and a pandas UDF decodes Shift_JIS."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.{bms,bme,bml,pms,BMS,BME,BML,PMS}").load(paths)
    decoded = F.pandas_udf(_shift_jis, "string")("content") if encoding == "shift_jis" else F.decode("content", encoding)
    return lines_of(raw.select("path", decoded.alias("text")))


def line_class(line: Column) -> Column:
    """HEADER, MAIN or OTHER; letters count in upper case only."""
    clean = F.trim(line)
    return F.when(clean.rlike(HEADER), "HEADER").when(clean.rlike(MAIN), "MAIN").otherwise("OTHER")


def is_definition(line: Column) -> Column:
    """Whether a header line defines a sound; unlike its class, it isn't trimmed."""
    return line.rlike("(?i)^#WAV[0-9A-Za-z]{2}")


def is_sound_channel(channel: Column) -> Column:
    return F.upper(channel).rlike(SOUND_CHANNEL)


def definitions(lines: DataFrame) -> DataFrame:
    """path, idx (order in the chart), num and name of every definition."""
    found = lines.filter(F.col("line").rlike(DEFINITION))
    return found.select("path", F.col("line_no").alias("idx"), F.regexp_extract("line", DEFINITION, 1).alias("num"), F.trim(F.regexp_extract("line", DEFINITION, 2)).alias("name"))


def file_list(defined: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Definitions with a file (num_int, name, file_size) and the names without one.

    ``listing`` has path and length.  Any lower-case digit in a chart makes its
    identifiers base 62.
    """
    base = defined.groupBy("path").agg(ids.base_of(F.col("num")).alias("radix"))
    full = text.combined(text.directory(F.col("path")), F.col("name"))
    named = defined.withColumn("full", full)
    files = listing.select(F.col("path").alias("full"), F.col("length").alias("file_size"))
    there = named.join(files, "full").join(base, "path")
    number = F.when(F.col("radix") == 62, ids.decode(F.col("num"), 62)).otherwise(ids.decode(F.col("num"), 36))
    found = there.select("path", "idx", "num", number.alias("num_int"), F.col("full").alias("name"), "file_size")
    return found, named.join(files, "full", "left_anti").select("path", "idx", "name")


def tokens(lines: DataFrame, form: str = DATA) -> DataFrame:
    """path, line_no, pos and id of every identifier in the data of sound channels; a trailing single character is none."""
    data = lines.filter(F.col("line").rlike(form) & is_sound_channel(F.regexp_extract("line", form, 3)))
    pairs = F.regexp_extract_all(F.regexp_extract("line", form, 5), F.lit(".."), 0)
    return data.select("path", "line_no", F.posexplode(pairs).alias("pos", "id"))
