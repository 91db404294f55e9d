"""Conversion of large regions: the pieces of a region are taken together if enough of it is mapped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorspan.functions.chrom import trimmed
from anchorspan.functions.numbers import unsigned
from anchorspan.operators.lift import Lifter
from anchorspan.plans.bed import SEGMENTS, is_header
from anchorspan.plans.common import field, none_of

MIN_RATIO = 0.85


def parsed(rows: DataFrame) -> DataFrame:
    line = trimmed(F.col("line"))
    kept = rows.withColumn("line", line).where((F.col("line") != "") & ~is_header(F.col("line"))).withColumn("fields", F.split("line", "\t", -1))
    start, end = unsigned(field(1)), unsigned(field(2))
    strand = F.coalesce(F.get(F.filter("fields", lambda f: f.isin("+", "-")), F.lit(0)), F.lit("+"))
    bad = (F.size("fields") < 3) | start.isNull() | end.isNull() | (start >= end)
    return kept.withColumns({"chrom": field(0), "start": start, "end": end, "strand": strand, "bad": F.coalesce(bad, F.lit(True))})


def merged(found: str, start, end, min_ratio: float) -> dict:
    """The merged region of an array of segments: status, t_chrom, t_start, t_end, t_strand, ratio.

    One segment counts as wholly mapped whatever it covers. Several must lie on one chromosome, which is asked first, and
    cover min_ratio of the region; they span from the least start to the largest end, on the strand of the last.
    """
    g, n = F.col(found), F.size(found)
    covered = F.aggregate(g, F.lit(0).cast("bigint"), lambda total, x: total + x["s_end"] - x["s_start"])
    ratio = F.when(n == 1, F.lit(1.0)).otherwise(F.try_divide(covered.cast("double"), end - start))
    chroms = F.size(F.array_distinct(F.transform(g, lambda x: x["t_chrom"])))
    status = F.when(n == 0, "Unmap").when(n == 1, "ok").when(chroms > 1, "CrossChroms").when(ratio < min_ratio, "LowRatio").otherwise("ok")
    return {
        "status": status, "ratio": ratio, "t_chrom": F.get(g, F.lit(0))["t_chrom"], "t_start": F.array_min(F.transform(g, lambda x: x["t_start"])),
        "t_end": F.array_max(F.transform(g, lambda x: x["t_end"])), "t_strand": F.get(g, n - 1)["t_strand"],
    }


def ratio_text(ratio):
    """Four decimals, rounded half up on the decimal value."""
    return F.format_string("map_ratio=%.4f", ratio)


def convert(rows: DataFrame, lifter: Lifter, rid: str = "at", min_ratio: float = MIN_RATIO) -> DataFrame:
    """The outcome of region lines: status is ok, Unmap, CrossChroms, LowRatio or InvalidFormat (a region without length, too)."""
    recs = lifter.with_segments(parsed(rows), rid, F.when(~F.col("bad"), F.col("chrom")), F.col("start"), F.col("end"), F.col("strand"))
    recs = recs.withColumn("found", F.coalesce("segments", none_of(SEGMENTS))).drop("segments")
    got = recs.withColumns(merged("found", F.col("start"), F.col("end"), min_ratio))
    got = got.withColumn("status", F.when(F.col("bad"), "InvalidFormat").otherwise(F.col("status")))
    new = F.transform("fields", lambda f, i: F.when(i == 0, F.col("t_chrom")).when(i == 1, F.col("t_start").cast("string")).when(i == 2, F.col("t_end").cast("string")).otherwise(f))
    new = F.transform(new, lambda f: F.when(f.isin("+", "-"), F.col("t_strand")).otherwise(f))
    line = F.concat(F.array_join(new, "\t"), F.lit("\t"), ratio_text(F.col("ratio")))
    why = F.when(F.col("status") == "LowRatio", ratio_text(F.col("ratio"))).otherwise(F.col("status"))
    ok = F.col("status") == "ok"
    return got.withColumns({"out": F.when(ok, F.array(line)).otherwise(none_of("array<string>")), "reject": F.when(~ok, F.concat(F.col("line"), F.lit("\tFail\t"), why))}).drop("found")
