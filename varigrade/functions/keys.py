"""Join-key clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that text trimming removes (Unicode white space).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)


def strip(column: Column) -> Column:
    """Trim all Unicode white space (SQL ``trim`` removes blanks only)."""
    return F.btrim(column.cast("string"), F.lit(WHITESPACE))


def normalize_key(column: Column) -> Column:
    """Trim, drop every inner blank and lower-case; null stays null."""
    return F.lower(F.replace(strip(column), F.lit(" "), F.lit("")))


def stringify_strip(column: Column, missing: str | None = None) -> Column:
    """Text form of any column, trimmed; ``missing`` replaces nulls when given (for instance ``'nan'``)."""
    text = strip(column)
    return text if missing is None else F.coalesce(text, F.lit(missing))
