"""Text helpers: stripping, lenient parsing, display values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters Python's str.strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITESPACE))


def or_default(value: Column, default: str) -> Column:
    """Missing and empty text both become the default."""
    return F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit(default))


# decimal numbers with single underscores between digits, as in Python; no suffixes
NUMBER = r"^\s*[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$"
INFINITE = r"^\s*[+-]?[iI][nN][fF]([iI][nN][iI][tT][yY])?\s*$"


def number(value: Column) -> Column:
    """The number that a text or numeric column holds; NULL for NaN and for anything else."""
    text = value.cast("string")
    plain = F.regexp_replace(strip(text), "_", "")
    return F.when(text.rlike(NUMBER) | text.rlike(INFINITE), plain.try_cast("double"))


def lenient_double(value: Column) -> Column:
    """Missing, NaN or unparsable becomes 0.0."""
    return F.coalesce(number(value), F.lit(0.0))


def lenient_int(value: Column) -> Column:
    """As lenient_double, then cut towards zero; out of range becomes 0."""
    return F.coalesce(number(value).try_cast("int"), F.lit(0))


def yes_no(flag: Column) -> Column:
    return F.when(flag != 0, "Yes").otherwise("No")
