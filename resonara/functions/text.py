"""Paths, words and display texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chart extensions with their display names, and the name of anything else.
CHART_TYPES = {".bms": "BMSファイル", ".bme": "BMEファイル", ".bml": "BMLファイル", ".pms": "PMSファイル"}
OTHER_TYPE = "ファイル"
OUTPUT_SUFFIX = "_optimized"

# Words that never name an instrument.
NOT_INSTRUMENTS = (
    "wav mp3 ogg flac aiff aif au raw pcm "
    "bit khz mono stereo left right mid side "
    "loop oneshot shot sample smp sfx fx "
    "edit mix master final ver version v01 v02 v03 "
    "test temp tmp backup bak copy new old "
    "untitled noname default misc other unknown "
    "file audio sound track song music bms bme bml bmg"
).split()
SHORTEST, LONGEST = 3, 20


def file_name(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"[/\\]?[^/\\]*$", "")


def extension(path: Column) -> Column:
    """The last dot of a file name and what follows; empty if nothing does."""
    return F.regexp_extract(path, r"(\.[^./\\]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def rooted(path: Column) -> Column:
    return path.rlike(r"^([/\\]|[A-Za-z]:)")


def combined(folder: Column, path: Column) -> Column:
    return F.when(rooted(path) | (folder == ""), path).otherwise(F.concat(F.regexp_replace(folder, r"[/\\]+$", ""), F.lit("/"), path))


def relative(path: Column, folder: Column) -> Column:
    """``path`` without ``folder`` where it lies inside."""
    base = F.concat(F.regexp_replace(folder, r"[/\\]+$", ""), F.lit("/"))
    return F.when((folder != "") & path.startswith(base), F.substr(path, F.length(base) + 1, F.length(path))).otherwise(path)


def is_chart(path: Column) -> Column:
    return F.lower(extension(path)).isin(*CHART_TYPES)


def type_name(ext: Column) -> Column:
    named = F.create_map(*[F.lit(x) for pair in CHART_TYPES.items() for x in pair])
    return F.coalesce(F.get(F.array(F.element_at(named, F.lower(ext))), 0), F.lit(OTHER_TYPE))


def output_name(path: Column) -> Column:
    ext = extension(path)
    return F.concat(F.substr(path, F.lit(1), F.length(path) - F.length(ext)), F.lit(OUTPUT_SUFFIX), ext)


def unquoted(path: Column) -> Column:
    return F.btrim(path, F.lit('"'))


def with_unit(text: Column, unit: str = "%") -> Column:
    """A text that ends in its unit; empty stays empty."""
    bare = F.trim(text)
    return F.when((bare == "") | bare.endswith(unit), bare).otherwise(F.concat(bare, F.lit(unit)))


def without_unit(text: Column, unit: str = "%") -> Column:
    bare = F.trim(text)
    return F.when(bare.endswith(unit), F.rtrim(F.substr(bare, F.lit(1), F.length(bare) - len(unit)))).otherwise(bare)


def is_numeric_input(text: Column, decimal: bool = True, negative: bool = False) -> Column:
    """Whether a text may be typed into a number field."""
    return text.rlike("^[0-9" + r"\." * decimal + r"\-" * negative + "]*$")


def words(name: Column) -> Column:
    """Word candidates of a file stem, in order.

    Each part that isn't all digits gives its alphabetic beginning, if long
    enough, and itself, if it is a word of fitting length; so a purely
    alphabetic part counts twice.
    """
    parts = F.filter(F.split(name, r"[_\- .()\[\]{}]"), lambda p: (p != "") & ~p.rlike(r"^\d+$"))

    def of(part: Column) -> Column:
        head = F.regexp_extract(part, "^[a-zA-Z]+", 0)
        begin = F.when(F.length(head) >= SHORTEST, head)
        whole = F.when(F.length(part).between(SHORTEST, LONGEST) & part.rlike("^[a-zA-Z][a-zA-Z0-9]*$"), part)
        return F.filter(F.array(begin, whole), lambda x: x.isNotNull())

    return F.flatten(F.transform(parts, of))


def names_instrument(word: Column) -> Column:
    return F.length(word).between(SHORTEST, LONGEST) & ~F.lower(word).isin(NOT_INSTRUMENTS)


def shown_percent(r: Column) -> Column:
    """A correlation of 0 to 1 as whole percent, half to even in single precision."""
    return F.bround(r.cast("float") * F.lit(100).cast("float")).cast("int")


def entered_percent(text: Column) -> Column:
    """A typed percentage as the fraction shown for it; 0.40 where it is no number."""
    whole = F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("int"))
    part = F.when(whole.isNull(), F.trim(text).try_cast("double"))
    value = F.when(whole.isNotNull(), F.least(F.greatest(whole, F.lit(0)), F.lit(100)) / 100).when(part.between(0, 1), part).when((part > 1) & (part <= 100), part / 100)
    return F.format_number(F.coalesce(value, F.lit(0.40)), 2)


def bar_width(value: Column, total: Column) -> Column:
    return total * F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def input_path_error(path: Column, exists: Column) -> Column:
    """What is wrong with a typed chart path ('not found', 'not supported'), quotes aside; empty if nothing, or if nothing is typed."""
    bare = unquoted(F.coalesce(path, F.lit("")))
    return F.when(F.trim(bare) == "", "").when(~exists, "not found").when(~is_chart(bare), "not supported").otherwise("")


def output_path_error(path: Column, folder_exists: Column) -> Column:
    """'no folder' for a typed path whose folder is missing; empty if nothing is wrong or typed, or if it names no folder."""
    bare = unquoted(F.coalesce(path, F.lit("")))
    return F.when((F.trim(bare) == "") | (directory(bare) == ""), "").when(~folder_exists, "no folder").otherwise("")


def paths_specified(*paths: Column) -> Column:
    """Whether every path has something typed, quotes aside."""
    return F.forall(F.array(*[F.trim(unquoted(F.coalesce(p, F.lit("")))) for p in paths]), lambda p: p != "")


def opacity(flag: Column) -> Column:
    """Half for true; full for false and null."""
    return F.when(F.coalesce(flag, F.lit(False)), 0.5).otherwise(1.0)


def is_half(value: Column) -> Column:
    """The flag that ``opacity`` shows."""
    return F.abs(value - 0.5) < 0.01


def inverse(flag: Column) -> Column:
    """The other flag; false for null."""
    return F.coalesce(~flag, F.lit(False))


def is_blank(value: Column) -> Column:
    """Whether a text is null or empty."""
    return F.coalesce(value, F.lit("")) == ""
