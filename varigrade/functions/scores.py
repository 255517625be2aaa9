"""Scores, labels and weights of catalogue rows."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordinal code of each confidence grade; the uncertain grade has none.
UNCERTAIN_GRADE = "3) Uncertain significance"
GRADE_CODES = {
    "5) Not assoc w R": 0,
    "4) Not assoc w R - Interim": 1,
    "2) Assoc w R - Interim": 2,
    "1) Assoc w R": 3,
}

# Lower edge of each predictive-value bin, highest first.
PPV_EDGES = ((0.8, 3), (0.6, 2), (0.2, 1))


def grade_code(grade: Column) -> Column:
    """Ordinal 0-3 of a grade; null for the uncertain and for unknown grades."""
    return reduce(
        lambda chain, item: chain.when(grade == item[0], F.lit(item[1])),
        GRADE_CODES.items(),
        F.when(grade == UNCERTAIN_GRADE, F.lit(None).cast("int")),
    )


def ppv_bin(ppv: Column) -> Column:
    """Bin 0-3 of a predictive value; a missing value falls into bin 0."""
    chain = F
    for edge, label in PPV_EDGES:
        chain = chain.when(F.nanvl(ppv, F.lit(None).cast("double")) >= edge, F.lit(label))
    return chain.otherwise(F.lit(0))


def evidence_weight(has_exact: Column, has_variant: Column) -> Column:
    """Row weight: 1, plus 3 for an exact measurement, plus 2 for a variant-level one."""
    return has_exact * 3 + 1 + has_variant * 2


def cast_float32(column: Column) -> Column:
    return column.cast("float")


def sanitize_sentinel(column: Column, sentinel: float = -1) -> Column:
    """Infinite, NaN and null values become ``sentinel``."""
    broken = column.isNull() | F.isnan(column) | (F.abs(column) == math.inf)
    return F.when(broken, F.lit(sentinel)).otherwise(column)


def allele_length(allele: Column) -> Column:
    """Length of the allele text; a missing allele counts as the text ``nan`` (3)."""
    return F.coalesce(F.length(allele), F.lit(3))


def allele_base(allele: Column) -> Column:
    """The allele itself when it is one base, else ``LONG``."""
    return F.when(F.length(allele) == 1, allele).otherwise(F.lit("LONG"))
