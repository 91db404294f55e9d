"""What the conversions share: fields of a line, and the outcome of a record.

An outcome has the record's own columns and: status (ok, or why the record was rejected), out (array of output lines)
and reject (the line for the reject output, null if there is none).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAB = "\t"


def fields(line: Column) -> Column:
    """Fields by tabs; a final tab opens no field."""
    return F.split(F.when(line.endswith(TAB), line.substr(F.lit(1), F.length(line) - 1)).otherwise(line), TAB, -1)


def field(i: int, of: str = "fields") -> Column:
    """The field at place i (from 0), null beyond the end."""
    return F.get(of, F.lit(i))


def tail(start: int, of: str = "fields") -> Column:
    """The fields from place ``start`` on, as one text; null if there are none."""
    return F.when(F.size(of) > start, F.array_join(F.slice(of, start + 1, F.greatest(F.size(of) - start, F.lit(1))), TAB))


def joined(*parts: Column) -> Column:
    """Parts by tabs; null parts are left out."""
    return F.concat_ws(TAB, *parts)


def none_of(kind: str) -> Column:
    return F.array().cast(kind)


def lines_out(outcome: DataFrame, order: list[str]) -> DataFrame:
    """(side, order..., n, line): every output and reject line with its place. side is mapped or unmapped."""
    rows = F.concat(
        F.transform(F.coalesce("out", none_of("array<string>")), lambda x: F.struct(F.lit("mapped").alias("side"), x.alias("line"))),
        F.when(F.col("reject").isNotNull(), F.array(F.struct(F.lit("unmapped").alias("side"), F.col("reject").alias("line")))).otherwise(none_of("array<struct<side:string,line:string>>")),
    )
    return outcome.select(*order, F.posexplode(rows).alias("n", "x")).select("x.side", *order, "n", "x.line")


def stats(outcome: DataFrame) -> DataFrame:
    """(status, n) of an outcome."""
    return outcome.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
