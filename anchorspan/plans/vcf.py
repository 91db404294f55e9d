"""VCF and GVCF conversion: one place on the target, alleles rewritten for its strand and reference base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorspan.functions import dna, variants
from anchorspan.functions.chrom import rtrimmed
from anchorspan.functions.numbers import unsigned
from anchorspan.operators.lift import Lifter
from anchorspan.plans.bed import SEGMENTS
from anchorspan.plans.common import field, fields, joined, none_of, tail
from anchorspan.sources import fasta

#: Header lines that go to both outputs, and those that go to the rejects alone.
TO_BOTH = ["##fileformat", "##INFO", "##FILTER", "##FORMAT", "##ALT", "##SAMPLE", "##PEDIGREE"]
TO_BOTH_GVCF = [*TO_BOTH, "##GVCFBlock", "##GATKCommandLine", "##source"]
TO_REJECTS = ["##assembly", "##contig"]
PROGRAM = "##liftOverProgram=anchorspan"


def parsed(rows: DataFrame, trim: bool = True) -> DataFrame:
    line = rtrimmed(F.col("line")) if trim else F.col("line")
    kept = rows.withColumn("line", line).where((F.col("line") != "") & ~F.col("line").startswith("#")).withColumn("fields", fields(F.col("line")))
    pos = unsigned(field(1))
    return kept.withColumns({"chrom": field(0), "pos": pos, "bad": F.coalesce((F.size("fields") < 8) | pos.isNull(), F.lit(True))})


def _with_reference(recs: DataFrame, chunks: DataFrame | None, rid: str, wanted: Column) -> DataFrame:
    """recs with new_ref: the target's base at t_start where wanted, the record's own REF where not or without a reference."""
    if chunks is None:
        return recs.withColumn("new_ref", field(3))
    asked = recs.withColumns({"_chrom": F.when(wanted, F.col("g.t_chrom")), "_start": F.col("g.t_start"), "_end": F.col("g.t_start") + 1})
    got = fasta.with_bases(asked, chunks, rid, "_chrom", "_start", "_end", "_base").drop("_chrom", "_start", "_end")
    return got.withColumn("new_ref", F.when(wanted, F.col("_base")).otherwise(field(3))).drop("_base")


def convert(rows: DataFrame, lifter: Lifter, chunks: DataFrame | None = None, rid: str = "at", no_comp_allele: bool = False) -> DataFrame:
    """The outcome of VCF lines. status: ok, Unmap, Multiple_hits, KeyError or ParseError; a reject line is the line and Fail(status).

    With a reference (chunks as of sources.fasta), REF becomes the one base at the mapped position, whatever its length
    was. ALT alleles equal to it go, and ALT may become empty. END= in INFO becomes the mapped end. no_comp_allele is kept
    and has no effect: no remaining ALT equals REF.
    """
    recs = lifter.with_segments(parsed(rows), rid, F.when(~F.col("bad"), F.col("chrom")), F.col("pos") - 1, F.col("pos"), F.lit("+"))
    recs = recs.withColumn("found", F.coalesce("segments", none_of(SEGMENTS))).withColumn("g", F.when(F.size("found") == 1, F.get("found", F.lit(0))))
    recs = _with_reference(recs, chunks, rid, F.col("g").isNotNull())
    n = F.size("found")
    status = F.when(F.col("bad"), "ParseError").when(n == 0, "Unmap").when(n > 1, "Multiple_hits").when(F.coalesce(F.col("new_ref"), F.lit("")) == "", "KeyError").otherwise("ok")
    alt = variants.rewritten_alts(field(4), field(3), F.col("new_ref"), F.col("g.t_strand") == "-")
    got = recs.withColumns({"status": status, "new_alt": alt, "new_info": variants.replace_end(field(7), F.col("g.t_end")), "new_pos": F.col("g.t_start") + 1})
    line = joined(F.col("g.t_chrom"), F.col("new_pos").cast("string"), field(2), F.col("new_ref"), F.col("new_alt"), field(5), field(6), F.col("new_info"), tail(8))
    return _closed(got, line, F.concat(F.array_join("fields", "\t"), F.lit("\tFail("), F.col("status"), F.lit(")")))


def _closed(got: DataFrame, line: Column, reject: Column) -> DataFrame:
    ok = F.col("status") == "ok"
    done = got.withColumns({"out": F.when(ok, F.array(line)).otherwise(none_of("array<string>")), "reject": F.when(~ok, reject), "t_chrom": F.col("g.t_chrom"), "t_strand": F.col("g.t_strand")})
    return done.drop("found", "g", "segments")


def convert_gvcf(rows: DataFrame, lifter: Lifter, chunks: DataFrame | None = None, rid: str = "at", no_comp_allele: bool = False) -> DataFrame:
    """The outcome of GVCF lines. status: ok, Unmapped, Multiple, KeyError or ParseError; reject lines carry no reason.

    A line with END is a block: it maps as a whole, keeps REF and gets a new END. Other lines map one base. An ALT field
    of several alleles stays as it is.
    """
    recs = parsed(rows, trim=False).withColumn("stop", variants.end_position(field(7)))
    block = F.col("stop").isNotNull()
    recs = lifter.with_segments(recs, rid, F.when(~F.col("bad"), F.col("chrom")), F.col("pos") - 1, F.coalesce("stop", "pos"), F.lit("+"))
    recs = recs.withColumn("found", F.coalesce("segments", none_of(SEGMENTS))).withColumn("g", F.when(F.size("found") == 1, F.get("found", F.lit(0))))
    recs = _with_reference(recs, chunks, rid, F.col("g").isNotNull() & ~block)
    n = F.size("found")
    status = F.when(F.col("bad"), "ParseError").when(n == 0, "Unmapped").when(n > 1, "Multiple").when(~block & (F.coalesce(F.col("new_ref"), F.lit("")) == ""), "KeyError").otherwise("ok")
    turned = F.when(F.col("g.t_strand") == "-", dna.revcomp(field(4))).otherwise(field(4))
    alt = F.when(variants.is_non_ref(field(4)) | ~dna.is_dna(field(4)), field(4)).otherwise(F.when(turned == F.col("new_ref"), "").otherwise(turned))
    info = F.when(block, variants.set_end(field(7), F.col("g.t_end"))).otherwise(field(7))
    got = recs.withColumns({"status": status, "new_alt": alt, "new_info": info, "new_pos": F.col("g.t_start") + 1})
    line = joined(F.col("g.t_chrom"), F.col("new_pos").cast("string"), field(2), F.col("new_ref"), F.col("new_alt"), field(5), field(6), F.col("new_info"), tail(8))
    return _closed(got, line, F.array_join("fields", "\t"))


def header_lines(headers: list[str], contigs: list[tuple[str, int]], both: list[str]) -> tuple[list[str], list[str]]:
    """(mapped, unmapped) header lines of a converted file; contigs of the target come before the column line."""
    mapped, unmapped = [], []
    for line in headers:
        if line.startswith(tuple(both)):
            mapped.append(line)
            unmapped.append(line)
        elif line.startswith(tuple(TO_REJECTS)):
            unmapped.append(line)
        elif line.startswith("#CHROM"):
            mapped += [f"##contig=<ID={name},length={size}>" for name, size in contigs] + [PROGRAM, line]
            unmapped.append(line)
        else:
            mapped.append(line)
    return mapped, unmapped


def gvcf_contigs(headers: list[str], sizes: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The chain's target sizes, sorted, in the naming of the file's own first contig line."""
    first = next((x for x in headers if x.startswith("##contig=")), "ID=chr")
    if "ID=chr" in first:
        return sorted((n, s) for n, s in sizes if n.startswith("chr"))
    return sorted((n.removeprefix("chr"), s) for n, s in sizes)
