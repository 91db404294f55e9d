"""Conversion of alignments: the first segment of a read, turned with its block; the rest becomes unmapped in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorspan.functions import cigar, dna
from anchorspan.operators.lift import Lifter
from anchorspan.plans.bed import SEGMENTS
from anchorspan.plans.common import none_of

#: Flag bits, and tags that are not carried over.
PAIRED, UNMAPPED, REVERSE, SECONDARY = 0x1, 0x4, 0x10, 0x100
DROPPED_TAGS = ["QF", "OC", "OP"]
COLUMNS = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
_TYPES = {"flag": "int", "pos": "bigint", "mapq": "int", "pnext": "bigint", "tlen": "bigint"}


def parsed(rows: DataFrame) -> DataFrame:
    """Alignment lines as columns; pos and pnext from 0, tags as an array. Header and short lines are left out."""
    f = F.split("line", "\t", -1)
    kept = rows.where((F.col("line") != "") & ~F.col("line").startswith("@")).withColumn("f", f).where(F.size("f") >= 11)
    columns = {c: F.get("f", F.lit(i)).try_cast(_TYPES[c]) if c in _TYPES else F.get("f", F.lit(i)) for i, c in enumerate(COLUMNS)}
    columns |= {c: columns[c] - 1 for c in ("pos", "pnext")}
    return kept.withColumns(columns).withColumn("tags", F.slice("f", 12, F.greatest(F.size("f"), F.lit(1)))).drop("f")


def bit(flag: Column, mask: int) -> Column:
    return flag.bitwiseAND(F.lit(mask)) != 0


def convert(reads: DataFrame, lifter: Lifter, rid: str = "at", target_names: list[str] | None = None) -> DataFrame:
    """reads (COLUMNS and tags) rewritten, one row each, with status mapped, failed or unmapped (it was so before).

    target_names: sequences of the output header; a read that maps to any other fails. Mates are not followed: RNEXT is *,
    PNEXT and TLEN are 0. A read that maps more than once keeps its first segment and becomes secondary. The CIGAR is
    reversed with the read, never clipped.
    """
    before, reverse = bit(F.col("flag"), UNMAPPED), bit(F.col("flag"), REVERSE)
    end = F.col("pos") + cigar.reference_length(F.col("cigar"))
    recs = lifter.with_segments(reads, rid, F.when(~before, F.col("rname")), F.col("pos"), end, F.when(reverse, "-").otherwise("+"))
    recs = recs.withColumn("found", F.coalesce("segments", none_of(SEGMENTS))).withColumn("g", F.get("found", F.lit(0)))
    has_target = F.col("g.t_chrom").isin(target_names) if target_names is not None else F.lit(True)
    status = F.when(before, "unmapped").when(F.col("g").isNull() | ~has_target, "failed").otherwise("mapped")
    recs = recs.withColumn("status", status).withColumn("turned", (F.col("g.t_strand") == "-") != reverse)
    mapped, turned = F.col("status") == "mapped", F.col("turned")
    flag = F.col("flag").bitwiseXOR(F.when(turned, REVERSE).otherwise(0)).bitwiseOR(F.when(F.size("found") > 1, SECONDARY).otherwise(0))

    def either(yes: Column, no: Column) -> Column:
        return F.when(mapped, yes).otherwise(no)

    def flipped(c: str, how) -> Column:
        return F.when(mapped & turned & (F.col(c) != "*"), how(F.col(c))).otherwise(F.col(c))

    new = {
        "flag": F.when(mapped, flag).when(before, F.col("flag").bitwiseOR(F.lit(UNMAPPED))).otherwise(F.lit(UNMAPPED)), "rname": either(F.col("g.t_chrom"), F.lit("*")), "pos": either(F.col("g.t_start"), F.lit(0).cast("bigint")),
        "mapq": either(F.col("mapq"), F.lit(255)), "cigar": either(flipped("cigar", cigar.reverse), F.lit("*")), "rnext": F.lit("*"), "pnext": F.lit(0).cast("bigint"), "tlen": F.lit(0).cast("bigint"),
        "seq": flipped("seq", dna.read_revcomp), "qual": flipped("qual", F.reverse),
        "tags": either(F.filter("tags", lambda t: ~F.substring(t, 1, 2).isin(*DROPPED_TAGS)), none_of("array<string>")),
    }
    return recs.withColumns({k: v for k, v in new.items()}).drop("segments", "found", "g", "turned")


def line(df: DataFrame) -> Column:
    """The alignment line of converted reads."""
    fields = [F.col(c) + 1 if c in ("pos", "pnext") else F.col(c) for c in COLUMNS]
    return F.concat_ws("\t", *[f.cast("string") for f in fields], F.when(F.size("tags") > 0, F.array_join("tags", "\t")))


def stats(converted: DataFrame, flag: str = "flag") -> DataFrame:
    """(status, paired, n): reads by outcome and pairing."""
    return converted.groupBy("status", bit(F.col(flag), PAIRED).alias("paired")).agg(F.count(F.lit(1)).alias("n"))


def header_lines(headers: list[str], target_sizes: list[tuple[str, int]]) -> list[str]:
    """The header of a converted file: @HD, the target's sequences by name, and the @PG, @RG and @CO lines with their tagged parts."""
    out = ["@HD\tVN:1.0\tSO:coordinate"] + [f"@SQ\tSN:{n}\tLN:{s}" for n, s in sorted(target_sizes)]
    for x in headers:
        if x[:3] in ("@PG", "@RG", "@CO") and "\t" in x:
            first, *parts = x.split("\t")
            out.append("\t".join([first, *[p for p in parts if ":" in p]]))
    return out
