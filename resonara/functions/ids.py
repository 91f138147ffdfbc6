"""Two-character identifiers in base 36 or 62, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The digits of both bases, case-sensitive, and the bounds of the identifier space.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LARGEST = {36: 1295, 62: 3843}
PROCESSED_TO = 3842


def decode(value: Column, radix: int = 36) -> Column:
    """The number of an identifier; null if it has not exactly two digits of the base (lower case isn't base 36)."""
    digits = F.lit(DIGITS[:radix])
    high, low = (F.instr(digits, F.substring(value, k, 1)) for k in (1, 2))
    return F.when((F.length(value) == 2) & (high > 0) & (low > 0), (high - 1) * radix + low - 1)


def encode(number: Column, radix: int = 36) -> Column:
    """The identifier of a number; null outside the base's range.  A base other than 36 counts as 62."""
    base = 36 if radix == 36 else 62
    digits = F.lit(DIGITS)
    high, low = F.floor(number / base).cast("int"), (number % base).cast("int")
    return F.when(number.between(0, LARGEST[base]), F.concat(F.substr(digits, high + 1, F.lit(1)), F.substr(digits, low + 1, F.lit(1))))


def or_fail(made: Column, of: Column, what: str) -> Column:
    """``made``, or an error where it is null though ``of`` isn't."""
    return F.when(made.isNull() & of.isNotNull(), F.raise_error(F.concat(F.lit(f"{what}: "), of.cast("string")))).otherwise(made)


def base_of(identifiers: Column) -> Column:
    """Aggregate: 62 if any identifier has a lower-case letter, else 36."""
    return F.when(F.bool_or(identifiers.rlike("[a-z]")), 62).otherwise(36)


def legal_input(text: Column) -> Column:
    """What may be typed into an identifier field: up to two digits."""
    return text.rlike("^[0-9A-Za-z]{0,2}$")


def padded(text: Column) -> Column:
    """An identifier filled to, or cut at, two characters; empty stays empty."""
    return F.when(text == "", text).otherwise(F.lpad(text, 2, "0"))


def range_error(start: Column, end: Column) -> Column:
    """The first thing wrong with an identifier range, or null."""
    first, last = decode(start, 62), decode(end, 62)
    return (
        F.when(start.isNull() | end.isNull(), "missing")
        .when(F.length(start) != 2, "start length")
        .when(F.length(end) != 2, "end length")
        .when(first.isNull() | last.isNull(), "format")
        .when(first < 1, "start too low")
        .when(last <= first, "end not after start")
    )


def field_error(field: str, threshold: Column, start: Column, end: Column) -> Column:
    """The error shown for one field of a form ('threshold', 'start' or 'end'), empty if it is right.

    Fields are stricter than ``range_error``: ASCII, base 36, whole percentages.
    """
    ascii_only = lambda x: x.rlike(r"^[\x00-\x7F]*$")
    blank = lambda x: x.isNull() | (F.trim(x) == "")
    first, last = decode(start), decode(end)
    if field == "threshold":
        number = F.regexp_replace(threshold, "%+$", "").try_cast("int")
        found = F.when(blank(threshold), "missing").when(~ascii_only(threshold), "not ascii").when(number.isNull(), "not a number").when(~number.between(0, 100), "out of range")
    elif field == "start":
        found = F.when(blank(start) | (F.length(start) != 2), "length").when(~ascii_only(start), "not ascii").when(first.isNull(), "format").when(first < 1, "too low").when(~blank(end) & last.isNull(), "format").when(~blank(end) & (first >= last), "not below end")
    else:
        found = F.when(blank(end) | (F.length(end) != 2), "length").when(~ascii_only(end), "not ascii").when(end == "00", "").when(blank(start), "").when(first.isNull() | last.isNull(), "format").when((last != 0) & (last <= first), "not above start")
    return F.coalesce(found, F.lit(""))


def threshold(text: Column) -> Column:
    """A typed threshold as a struct of value (float) and error.

    Whole numbers are percentages but for 1, which is 100 %; fractions up to 1
    are taken as they are and others as percentages.
    """
    clean = F.trim(F.regexp_replace(text, "%+$", ""))
    whole = F.when(clean.rlike(r"^[+-]?\d+$"), clean.try_cast("int"))
    part = F.when(clean.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), clean.try_cast("float"))
    value = F.when(whole == 1, F.lit(1.0)).when(whole.between(0, 100), whole / 100).when(whole.isNull() & part.between(0, 1), part).when(whole.isNull() & (part > 1) & (part <= 100), part / 100).cast("float")
    wrong = F.when(text.isNull() | (F.trim(text) == ""), "missing").when(whole.isNull() & part.isNull(), "format").when(value.isNull(), "out of range")
    return F.struct(F.when(wrong.isNull(), value).alias("value"), wrong.alias("error"))


def all_errors(*errors: Column, separator: str = "\n") -> Column:
    """Every error found (null or empty is none), in order, joined."""
    return F.array_join(F.filter(F.array(*errors), lambda e: e.isNotNull() & (e != "")), separator)
