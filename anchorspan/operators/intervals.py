"""Interval joins and interval arithmetic on DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorspan.session import broadcast_if_small

#: Width of a position bin of the interval join, about the length of a long alignment block.
BIN = 1 << 16


def bins(start: Column, end: Column, width: int) -> Column:
    """The bins that [start, end) touches; a zero-length interval touches one, a turned one none."""
    first, last = F.floor(start / F.lit(width)), F.floor(F.greatest(start, end - 1) / F.lit(width))
    return F.when(end >= start, F.sequence(first, last))


def interval_join(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str], *, width: int = BIN, small_right: bool | None = None) -> DataFrame:
    """All pairs of rows with equal keys and overlapping intervals, each once.

    left_on and right_on name (key..., start, end). Both sides are cut into position bins, so the join is an equi-join on
    (key, bin) with a residual range test: a hot key is spread over its bins. A pair is kept in its first common bin,
    which needs no distinct. The right side is broadcast if its counted size allows it (small_right says it is known).
    Columns of the two sides must have different names. Null keys or ends match nothing.
    """
    *lk, ls, le = left_on
    *rk, rs, re = right_on
    a = left.withColumn("_bin", F.explode(bins(F.col(ls), F.col(le), width)))
    b = right.withColumn("_rbin", F.explode(bins(F.col(rs), F.col(re), width)))
    if small_right is None:
        b = broadcast_if_small(b)
    elif small_right:
        b = F.broadcast(b)
    on = F.col("_bin") == F.col("_rbin")
    for x, y in zip(lk, rk, strict=True):
        on &= F.col(x) == F.col(y)
    on &= (F.col(rs) < F.col(le)) & (F.col(re) > F.col(ls)) & (F.col("_bin") == F.floor(F.greatest(ls, rs) / F.lit(width)))
    return a.join(b, on).drop("_bin", "_rbin")


def intersect(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """struct<start, end> of what two half-open intervals share; null if they share no position."""
    return F.when((s1 < e2) & (e1 > s2), F.struct(F.greatest(s1, s2).alias("start"), F.least(e1, e2).alias("end")))
