"""GFF and GTF conversion: one segment of the feature's own size, or nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorspan.functions.numbers import unsigned
from anchorspan.operators.lift import Lifter
from anchorspan.plans.bed import SEGMENTS
from anchorspan.plans.common import field, fields, joined, none_of


def size(start: Column, end: Column) -> Column:
    """Bases of a 1-based closed feature."""
    return end - start + 1


def parsed(rows: DataFrame) -> DataFrame:
    kept = rows.where((F.col("line") != "") & ~F.col("line").startswith("#")).withColumn("fields", fields(F.col("line")))
    start, end = unsigned(field(3)), unsigned(field(4))
    bad = (F.size("fields") < 9) | start.isNull() | end.isNull() | ~field(6).isin("+", "-", ".")
    return kept.withColumns({"chrom": field(0), "start": start, "end": end, "strand": field(6), "bad": F.coalesce(bad, F.lit(True))})


def convert(rows: DataFrame, lifter: Lifter, rid: str = "at") -> DataFrame:
    """The outcome of GFF lines: status ok, unmapped, multiple, resized or parse_error. Columns after the ninth are dropped."""
    recs = lifter.with_segments(parsed(rows), rid, F.when(~F.col("bad"), F.col("chrom")), F.col("start") - 1, F.col("end"), F.col("strand"))
    recs = recs.withColumn("found", F.coalesce("segments", none_of(SEGMENTS))).withColumn("g", F.get("found", F.lit(0)))
    same = F.col("g.t_end") - F.col("g.t_start") == size(F.col("start"), F.col("end"))
    status = F.when(F.col("bad"), "parse_error").when(F.size("found") == 0, "unmapped").when(F.size("found") > 1, "multiple").when(~same, "resized").otherwise("ok")
    line = joined(F.col("g.t_chrom"), field(1), field(2), (F.col("g.t_start") + 1).cast("string"), F.col("g.t_end").cast("string"), field(5), F.col("g.t_strand"), field(7), field(8))
    got = recs.withColumn("status", status)
    ok = F.col("status") == "ok"
    return got.withColumns({"out": F.when(ok, F.array(line)).otherwise(none_of("array<string>")), "reject": F.when(~ok, F.col("line"))}).drop("found", "g", "segments")


def headers(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("line").startswith("#"))
