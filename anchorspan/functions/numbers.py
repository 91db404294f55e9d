"""Numbers in text fields, read and written as strictly as the formats ask."""

from __future__ import annotations

import math
from decimal import Decimal

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from anchorspan.session import ship


def unsigned(col: Column) -> Column:
    """A whole number without sign (one leading + is allowed) as BIGINT; null for anything else, blanks around it included."""
    return F.when(col.rlike(r"\A\+?[0-9]+\z"), col.try_cast("bigint"))


def real(col: Column) -> Column:
    """A decimal number as DOUBLE; null for anything else."""
    return F.when(col.rlike(r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"), col.try_cast("double")).when(
        col.rlike(r"\A[+-]?(?i:nan|inf|infinity)\z"), F.regexp_replace(F.initcap(F.regexp_replace(F.lower(col), "infinity", "inf")), "Inf", "Infinity").try_cast("double")
    )


def shortest(value: float | None) -> str | None:
    """The shortest text of a double that reads back equal, without exponent and without a closing .0."""
    if value is None:
        return None
    if math.isnan(value):
        return "NaN"
    if math.isinf(value):
        return "inf" if value > 0 else "-inf"
    text = format(Decimal(repr(value)), "f")
    return text.removesuffix(".0")


def plain_double(col: Column) -> Column:
    """shortest() of each value. Only what comes out with an exponent or is no finite number is looked at one by one."""
    ship(SparkSession.active())

    @F.arrow_udf("string")
    def text(values: pa.Array) -> pa.Array:
        out = pa.compute.replace_substring_regex(pa.compute.cast(values, pa.string()), r"\.0$", "")
        odd = pa.compute.fill_null(pa.compute.match_substring_regex(out, "[a-zA-Z]"), False)
        return pa.compute.replace_with_mask(out, odd, pa.array([shortest(v) for v in values.filter(odd).to_pylist()], type=pa.string()))

    return text(col.cast("double"))
