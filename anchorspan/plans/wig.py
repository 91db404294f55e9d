"""Conversion of value tracks: points with one place on the target, joined into runs of equal values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorspan.operators.lift import Lifter
from anchorspan.operators.runs import collapse_runs
from anchorspan.plans.bed import SEGMENTS
from anchorspan.plans.common import none_of


def convert_points(points: DataFrame, lifter: Lifter, rid: str = "at") -> DataFrame:
    """points (chrom, start, end, value, ...) with status (ok, unmapped, multiple, no_value) and t_chrom, t_start, t_end. A clipped point is kept; one without a value has no place."""
    recs = lifter.with_segments(points, rid, F.col("chrom"), F.col("start"), F.col("end"), F.lit("+"))
    recs = recs.withColumn("found", F.coalesce("segments", none_of(SEGMENTS))).withColumn("g", F.when((F.size("found") == 1) & F.col("value").isNotNull(), F.get("found", F.lit(0))))
    status = F.when(F.col("value").isNull(), "no_value").when(F.size("found") == 0, "unmapped").when(F.size("found") > 1, "multiple").otherwise("ok")
    return recs.withColumns({"status": status, "t_chrom": F.col("g.t_chrom"), "t_start": F.col("g.t_start"), "t_end": F.col("g.t_end")}).drop("segments", "found", "g")


def merge(graph: DataFrame, rid: str = "at") -> DataFrame:
    """(chrom, start, end, value): touching or overlapping records of a chromosome with equal values as one.

    Records go in order of start, then rid. A record joins if its value is within 1e-10 of the first one's and it starts
    at or before the end reached so far. NaN joins nothing and stays a record of its own.
    """
    runs = collapse_runs(graph, {"chrom": F.col("chrom")}, F.col(rid), F.col("start"), F.col("end"), F.col("value"))
    alone = graph.where(F.isnan("value")).select("chrom", "start", "end", "value")
    return runs.select("chrom", F.col("run_start").alias("start"), F.col("run_end").alias("end"), F.col("run_value").alias("value")).unionByName(alone)


def convert(points: DataFrame, lifter: Lifter, rid: str = "at") -> tuple[DataFrame, DataFrame]:
    """(merged bedGraph records on the target, points that were not converted) of good points."""
    done = convert_points(points, lifter, rid)
    ok = done.where("status = 'ok'").select(rid, F.col("t_chrom").alias("chrom"), F.col("t_start").alias("start"), F.col("t_end").alias("end"), "value")
    return merge(ok, rid), done.where("status <> 'ok'")
