"""String expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every code point Python's str.isspace() accepts (none lies above U+3000).
# A trim character set is scanned in one linear pass, unlike a \s+$ pattern.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(c: Column) -> Column:
    """Trim Unicode whitespace (tabs, newlines, no-break spaces) on both sides."""
    return F.trim(c, F.lit(WHITESPACE))


def null_if_empty(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def quoted(name: str) -> str:
    """Column name for use in SQL text."""
    return "`" + name.replace("`", "``") + "`"


def plain_sql(name: str) -> str:
    """A number as double with NaN read as missing, as SQL text.

    Wide tables build one expression per column: a text costs one call to the JVM
    where chained Column calls cost many, and the short form keeps the generated
    method small enough to be compiled.
    """
    return f"nanvl(CAST({quoted(name)} AS DOUBLE), CAST(NULL AS DOUBLE))"


def as_plain(c: Column) -> Column:
    """A double with NaN read as missing and -0.0 folded into 0.0."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d + F.lit(0.0))
