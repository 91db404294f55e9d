"""MAF conversion: one segment, reference bases of the mapped range, columns found by the header of the file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorspan.functions import dna
from anchorspan.functions.numbers import unsigned
from anchorspan.operators.lift import Lifter
from anchorspan.plans.bed import SEGMENTS
from anchorspan.plans.common import fields, none_of
from anchorspan.sources import fasta

#: Columns that a header must have.
NEEDED = ["Chromosome", "Start_Position", "End_Position", "Strand", "Reference_Allele", "NCBI_Build"]


def header_of(rows: DataFrame) -> DataFrame:
    """(file, head_block, head_at, c_<name>...): the first line of each file that is a valid column header, with the places of its columns."""
    split = F.split("line", "\t", -1)
    valid = rows.where(~F.col("line").startswith("#")).withColumn("h", split)
    for name in NEEDED:
        valid = valid.where(F.array_contains("h", name))
    first = valid.groupBy("file").agg(F.min(F.struct("block", "at", "h")).alias("x"))
    return first.select("file", F.col("x.block").alias("head_block"), F.col("x.at").alias("head_at"), *[(F.array_position("x.h", n) - 1).cast("int").alias(f"c_{n}") for n in NEEDED])


def convert(rows: DataFrame, lifter: Lifter, build: str, chunks: DataFrame | None = None, rid: str = "at") -> DataFrame:
    """The outcome of MAF lines: status ok, unmapped, multiple, KeyError, parse_error, or no_header for lines before any valid header.

    Tumor alleles and Strand stay; the build column gets ``build``. Always mapped from the plus strand; a clipped range is kept.
    """
    data = rows.where((F.col("line") != "") & ~F.col("line").startswith("#")).join(header_of(rows), "file", "left")
    place = F.struct("block", "at")
    data = data.where(F.col("head_at").isNull() | (place != F.struct("head_block", "head_at")))
    before = F.col("head_at").isNull() | (place < F.struct("head_block", "head_at"))
    data = data.withColumns({"fields": fields(F.col("line")), "before": before})
    got = lambda n: F.get("fields", F.col(f"c_{n}"))
    start, end = unsigned(got("Start_Position")), unsigned(got("End_Position"))
    last = F.greatest(*[F.col(f"c_{n}") for n in NEEDED])
    recs = data.withColumns({"chrom": got("Chromosome"), "start": start, "end": end, "bad": F.coalesce((F.size("fields") <= last) | start.isNull() | end.isNull(), F.lit(True))})
    recs = lifter.with_segments(recs, rid, F.when(~F.col("bad") & ~F.col("before"), F.col("chrom")), F.col("start") - 1, F.col("end"), F.lit("+"))
    recs = recs.withColumn("found", F.coalesce("segments", none_of(SEGMENTS))).withColumn("g", F.when(F.size("found") == 1, F.get("found", F.lit(0))))
    if chunks is None:
        recs = recs.withColumn("new_ref", got("Reference_Allele"))
    else:
        asked = recs.withColumns({"_c": F.col("g.t_chrom"), "_s": F.col("g.t_start"), "_e": F.col("g.t_end")})
        recs = fasta.with_bases(asked.withColumnRenamed("_s", "_from").withColumnRenamed("_e", "_to"), chunks, rid, "_c", "_from", "_to", "_bases").drop("_c", "_from", "_to")
        recs = recs.withColumn("new_ref", F.when(F.col("g.t_strand") == "-", dna.revcomp(F.col("_bases"))).otherwise(F.col("_bases"))).drop("_bases")
    n = F.size("found")
    status = F.when(F.col("before"), "no_header").when(F.col("bad"), "parse_error").when(n == 0, "unmapped").when(n > 1, "multiple").when(F.col("new_ref").isNull(), "KeyError").otherwise("ok")
    new = {"Chromosome": F.col("g.t_chrom"), "Start_Position": (F.col("g.t_start") + 1).cast("string"), "End_Position": F.col("g.t_end").cast("string"), "Reference_Allele": F.col("new_ref"), "NCBI_Build": F.lit(build)}

    def changed(f, i):
        out = f
        for name, value in new.items():
            out = F.when(i == F.col(f"c_{name}"), value).otherwise(out)
        return out

    done = recs.withColumn("status", status)
    ok = F.col("status") == "ok"
    done = done.withColumns({"out": F.when(ok, F.array(F.array_join(F.transform("fields", changed), "\t"))).otherwise(none_of("array<string>")), "reject": F.when(~ok, F.col("line")), **{c: F.col(f"g.{c}") for c in ("t_chrom", "t_start", "t_end")}})
    return done.drop("found", "g", "segments", "before", "head_block", "head_at", *[f"c_{n}" for n in NEEDED])


def headers(rows: DataFrame) -> DataFrame:
    """Comment lines and the column header, as they go to the output."""
    head = header_of(rows).select(F.col("file").alias("f"), "head_block", "head_at")
    joined = rows.join(head, F.col("file") == F.col("f"), "left")
    is_head = F.coalesce((F.col("block") == F.col("head_block")) & (F.col("at") == F.col("head_at")), F.lit(False))
    return joined.where(F.col("line").startswith("#") | is_head).select(*rows.columns)
