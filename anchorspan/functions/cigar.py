"""CIGAR strings: parsing, lengths, reversal, merging, validity, and breaking at a reference offset."""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from anchorspan.session import ship

#: The nine operations, and those that use up reference and read.
OPERATIONS = "MIDNSHP=X"
ON_REFERENCE = "MDN=X"
ON_READ = "MIS=X"


def ops(col: Column) -> Column:
    """array<struct<len int, op string>>; empty for * or an empty text."""
    parts = F.regexp_extract_all(col, F.lit(rf"([0-9]+[{OPERATIONS}])"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, "^[0-9]+", 0).cast("int").alias("len"), F.right(p, F.lit(1)).alias("op")))


def text(col: Column) -> Column:
    """The string of an array of operations."""
    return F.array_join(F.transform(col, lambda o: F.concat(o["len"].cast("string"), o["op"])), "")


def _length(col: Column, kinds: str) -> Column:
    used = F.filter(ops(col), lambda o: o["op"].isin(*kinds))
    return F.aggregate(used, F.lit(0).cast("bigint"), lambda total, o: total + o["len"])


def reference_length(col: Column) -> Column:
    return _length(col, ON_REFERENCE)


def query_length(col: Column) -> Column:
    return _length(col, ON_READ)


def reverse(col: Column) -> Column:
    return text(F.reverse(ops(col)))


def merge_adjacent(col: Column) -> Column:
    """Equal neighbours become one operation, but for P."""
    empty = F.array().cast("array<struct<len:int,op:string>>")

    def step(done: Column, o: Column) -> Column:
        last = F.element_at(done, -1)
        same = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["op"] == o["op"]) & (o["op"] != "P")
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct((last["len"] + o["len"]).alias("len"), o["op"].alias("op"))))
        return F.when(same, joined).otherwise(F.concat(done, F.array(F.struct(o["len"].alias("len"), o["op"].alias("op")))))

    return text(F.aggregate(ops(col), empty, step))


def is_valid(col: Column, read_length: Column) -> Column:
    """Whether the operations use up just as many bases as the read has."""
    return query_length(col) == read_length


def break_cigar(cigar: str, at: int) -> tuple[str, str]:
    """(left, right) of a CIGAR broken after ``at`` reference bases.

    The operation that holds the break is parted. What it has left of the read is soft-clipped on the left side; the
    right side begins with a soft clip of all the read before the break. Without a break within it, all is left.
    """
    parts = [(int(n), o) for n, o in re.findall(rf"([0-9]+)([{OPERATIONS}])", cigar)]
    ends = list(accumulate(n if o in ON_REFERENCE else 0 for n, o in parts))
    hit = bisect_right(ends, at)
    if hit == len(parts):
        return _join(parts), ""
    size, op = parts[hit]
    kept = at - (ends[hit - 1] if hit else 0)
    on_read = size if op in ON_READ else 0
    read_before = sum(n for n, o in parts[:hit] if o in ON_READ)
    left = parts[:hit] + [(kept, op)] * (kept > 0) + [(on_read - kept, "S")] * (on_read > kept)
    right = [(read_before + kept, "S"), (size - kept, op), *parts[hit + 1 :]]
    return _join(left), _join(right)


def _join(parts: list[tuple[int, str]]) -> str:
    out: list[tuple[int, str]] = []
    for size, op in parts:
        if out and out[-1][1] == op and op != "P":
            out[-1] = (out[-1][0] + size, op)
        else:
            out.append((size, op))
    return "".join(f"{n}{o}" for n, o in out)


def broken(cigar: Column, at: Column) -> Column:
    """struct<left, right>: break_cigar() of each row."""
    ship(SparkSession.active())

    @F.pandas_udf("struct<left string, right string>")
    def pair(cigars: pd.Series, places: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([break_cigar(c or "", int(a)) for c, a in zip(cigars, places, strict=True)], columns=["left", "right"])

    return pair(cigar, at)
