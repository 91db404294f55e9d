"""File conversions: read, convert, write both outputs in one job, count.

Each function takes a chain file and an input path, and gives back the counts of the run. By default the output is one
file with its header first and the lines in input order, as users of the formats expect, and the rejects beside it; with
single=False the output path becomes a folder with the parts of side=mapped and side=unmapped, written in parallel
without a sort and without header lines. Paths are those of any file system that all machines share.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorspan.operators.lift import Lifter
from anchorspan.plans import bed, gff, maf, region, sam, vcf, wig
from anchorspan.plans.common import lines_out
from anchorspan.sources import binary, chain, fasta, sink
from anchorspan.sources import lines as text_lines
from anchorspan.sources import wig as wig_source

ORDER = text_lines.ORDER
PLACE = "side string, part int, file string, block bigint, at bigint, n int, line string"


def load(spark: SparkSession, chain_path: str, style: str = "a", compat_mode: str = "improved") -> tuple[Lifter, chain.ChainFile]:
    loaded = chain.load(chain.read_lines(spark, chain_path))
    return Lifter(loaded.blocks, style, compat_mode=compat_mode), loaded


def reject_path(output: str, suffix: str) -> str:
    """The path of the rejects: the output's extension replaced by ``suffix``."""
    return os.path.splitext(output)[0] + suffix


def numbered(rows: DataFrame) -> DataFrame:
    """rows with rid, which is unique over all files and splits, as ``at`` is."""
    return rows.withColumn("rid", F.col("at"))


def placed(rows: DataFrame, side: str, part: int = 0) -> DataFrame:
    """Lines (file, block, at, line) with the place that they take in a file: by part, then in their order."""
    return rows.select(F.lit(side).alias("side"), F.lit(part).alias("part"), *ORDER, F.lit(0).alias("n"), "line")


def listed(spark: SparkSession, lines: list[str], side: str, part: int) -> DataFrame:
    """The same of lines in hand."""
    return spark.createDataFrame([(side, part, "", 0, i, 0, x) for i, x in enumerate(lines)], PLACE)


#: The part of a file in which the records stand; header lines have smaller ones.
RECORDS = 100


def write(outcome: DataFrame, output: str, rejects: str, heads: list[DataFrame] = (), single: bool = True) -> dict[str, int]:
    """Writes the lines of an outcome; gives total, success, failed and multi. heads: placed() header lines of either side."""
    rows = lines_out(outcome, ORDER).withColumn("part", F.lit(RECORDS))
    record, mapped, first = F.col("part") == RECORDS, F.col("side") == "mapped", F.col("n") == 0  # every record has a first line on one of the sides
    counts = {"total": first, "success": first & mapped, "failed": ~mapped, "multi": mapped & (F.col("n") == 1)}
    metrics = [F.count(F.when(record & c, 1)).alias(k) for k, c in counts.items()]
    if not single:
        return sink.write_folder(rows, output, metrics)
    rows = reduce(DataFrame.unionByName, heads, rows.select("side", "part", *ORDER, "n", "line"))
    return sink.write_lines(rows, ["side", "part", *ORDER, "n"], {"mapped": output, "unmapped": rejects}, metrics)


def convert_bed(spark: SparkSession, chain_path: str, source: str, output: str, style: str = "a", single: bool = True) -> dict[str, int]:
    lifter, _ = load(spark, chain_path, style)
    rows = numbered(text_lines.read(spark, source))
    return write(bed.convert(rows, lifter, "rid"), output, reject_path(output, ".bed.unmap"), [placed(bed.headers(rows), "mapped")], single)


def convert_region(spark: SparkSession, chain_path: str, source: str, output: str, style: str = "a", min_ratio: float = region.MIN_RATIO, single: bool = True) -> dict[str, int]:
    lifter, _ = load(spark, chain_path, style)
    return write(region.convert(numbered(text_lines.read(spark, source)), lifter, "rid", min_ratio), output, output + ".unmap", single=single)


def convert_gff(spark: SparkSession, chain_path: str, source: str, output: str, style: str = "a", single: bool = True) -> dict[str, int]:
    lifter, _ = load(spark, chain_path, style)
    rows = numbered(text_lines.read(spark, source))
    return write(gff.convert(rows, lifter, "rid"), output, reject_path(output, ".gff.unmap"), [placed(gff.headers(rows), "mapped")], single)


def _vcf_heads(rows: DataFrame, contigs: DataFrame, both: list[str]) -> list[DataFrame]:
    """The header lines of both sides. contigs: (length, name, file, block, at) of the target's sequences; they come before the column line, if there is one."""
    headers = rows.where(F.col("line").startswith("#"))
    spark = rows.sparkSession
    kept, column, rejected = (reduce(Column.__or__, [F.col("line").startswith(x) for x in xs]) for xs in (both, ["#CHROM"], vcf.TO_REJECTS))
    mapped = [placed(headers.where(kept | ~(rejected | column)), "mapped", 0), placed(headers.where(column & ~kept), "mapped", 3)]
    unmapped = [placed(headers.where(kept | rejected | column), "unmapped", 0)]
    if headers.where(column).head() is not None:
        line = F.concat(F.lit("##contig=<ID="), "name", F.lit(",length="), F.col("length").cast("string"), F.lit(">"))
        mapped += [placed(contigs.select(*ORDER, line.alias("line")), "mapped", 1), listed(spark, [vcf.PROGRAM], "mapped", 2)]
    return [*mapped, *unmapped]


def convert_vcf(spark: SparkSession, chain_path: str, source: str, reference: str | None, output: str, style: str = "a", gvcf: bool = False, no_comp_allele: bool = False, single: bool = True) -> dict[str, int]:
    """VCF, or GVCF. reference: a FASTA file of the target; without one REF stays as it is."""
    lifter, loaded = load(spark, chain_path, style)
    rows = numbered(text_lines.read(spark, source))
    chunks = fasta.read(spark, reference) if reference else None
    if gvcf:
        first = rows.where(F.col("line").startswith("##contig=")).orderBy(*ORDER).select("line").limit(1).collect()
        long = "ID=chr" in (first[0]["line"] if first else "ID=chr")
        sizes = loaded.sizes.where("side = 'target'").select(F.col("chrom").alias("name"), F.col("size").alias("length"))
        sizes = sizes.where(F.col("name").startswith("chr")) if long else sizes.withColumn("name", F.regexp_replace("name", "^chr", ""))
        contigs = sizes.select("length", "name", F.col("name").alias("file"), F.col("length").alias("block"), F.lit(0).cast("bigint").alias("at"))
        return write(vcf.convert_gvcf(rows, lifter, chunks, "rid", no_comp_allele), output, reject_path(output, ".gvcf.unmap"), _vcf_heads(rows, contigs, vcf.TO_BOTH_GVCF), single)
    contigs = fasta.in_file_order(text_lines.read(spark, reference), chunks) if reference else spark.createDataFrame([], "length bigint, name string, file string, block bigint, at bigint")
    return write(vcf.convert(rows, lifter, chunks, "rid", no_comp_allele), output, reject_path(output, ".vcf.unmap"), _vcf_heads(rows, contigs, vcf.TO_BOTH), single)


def convert_maf(spark: SparkSession, chain_path: str, source: str, reference: str | None, build: str, output: str, style: str = "a", single: bool = True) -> dict[str, int]:
    lifter, _ = load(spark, chain_path, style)
    rows = numbered(text_lines.read(spark, source))
    chunks = fasta.read(spark, reference) if reference else None
    return write(maf.convert(rows, lifter, build, chunks, "rid"), output, reject_path(output, ".maf.unmap"), [placed(maf.headers(rows), "mapped")], single)


def _lifted(points: DataFrame, lifter: Lifter, rid: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(lifted points with status, merged records, counts). The points are lifted once and kept by the workers; what is lost is lifted again."""
    lifted = wig.convert_points(points, lifter, rid).withColumn("status", F.when(F.col("error").isNotNull(), "wrong").otherwise(F.col("status"))).persist()
    n = {r["status"]: r["count"] for r in lifted.groupBy("status").count().collect()}
    wrong, ok = n.pop("wrong", 0), n.get("ok", 0)
    counts = {"total": sum(n.values()), "success": ok, "failed": sum(n.values()) - ok + wrong}
    placed_points = lifted.where("status = 'ok'").select(rid, F.col("t_chrom").alias("chrom"), F.col("t_start").alias("start"), F.col("t_end").alias("end"), "value")
    return lifted, wig.merge(placed_points, rid), counts


def convert_wig(spark: SparkSession, chain_path: str, source: str, output: str, style: str = "a") -> dict[str, int]:
    """Wiggle or bedGraph text to {output}.wig, with {output}.unmap.wig for points that have no place, if there are any."""
    lifter, _ = load(spark, chain_path, style)
    lifted, merged, counts = _lifted(numbered(wig_source.read(spark, source)), lifter, "rid")
    try:
        failed = lifted.where("status not in ('ok', 'wrong')").select("chrom", "start", "end", "value")
        rows = wig_source.wiggle_lines(merged).withColumn("side", F.lit("mapped")).unionByName(wig_source.wiggle_lines(failed).withColumn("side", F.lit("unmapped")))
        kept = F.count(F.when((F.col("side") == "mapped") & (F.col("place") >= 0), 1)).alias("kept")
        seen = sink.write_lines(rows, ["side", "chrom", "place"], {"mapped": f"{output}.wig", "unmapped": f"{output}.unmap.wig"}, [kept], optional="unmapped")
    finally:
        lifted.unpersist()
    return counts | {"merged": counts["success"] - seen["kept"]}


def convert_bigwig(spark: SparkSession, chain_path: str, source: str, output: str, style: str = "a") -> dict[str, int]:
    """A BigWig file to another; rejects as {output}.unmap.bedGraph.

    Tasks pack and compress the blocks of the new file, each for a range of places; one file has to be written by one writer,
    so the packed blocks go through the driver one after the other, which holds their places only.
    """
    binary.register(spark)
    lifter, loaded = load(spark, chain_path, style)
    lifted, merged, counts = _lifted(spark.read.format("bigwig").load(source).withColumn("error", F.lit(None).cast("string")), lifter, "at")
    try:
        known = {r["chrom"]: r["size"] for r in loaded.sizes.where("side = 'target'").collect()}
        ends = {r["chrom"]: (r["end"], r["n"]) for r in merged.groupBy("chrom").agg(F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).collect()}
        sizes = {c: chain.size_of(known, c) or end for c, (end, _) in ends.items()}
        blocks = binary.packed_bigwig(merged, sorted(sizes)).persist()
        try:
            places = [tuple(r) for r in blocks.orderBy("number", "first").drop("data").collect()]
            data = (bytes(r["data"]) for r in blocks.orderBy("number", "first").select("data").toLocalIterator(prefetchPartitions=True))
            sink.Target(spark, output).write(binary.bigwig_file(sizes, places, data))
        finally:
            blocks.unpersist()
        if counts["failed"]:
            line = wig_source.bedgraph_line(F.col("chrom"), F.col("start"), F.col("end"), F.col("value"))
            rows = lifted.where("status <> 'ok'").select(F.lit("unmapped").alias("side"), "chrom", "start", line.alias("line"))
            sink.write_lines(rows, ["chrom", "start"], {"unmapped": f"{output}.unmap.bedGraph"})
    finally:
        lifted.unpersist()
    return counts | {"merged": counts["success"] - sum(n for _, n in ends.values())}


def convert_alignments(spark: SparkSession, chain_path: str, source: str, output: str, style: str = "a") -> dict[str, int]:
    """SAM or BAM to SAM or BAM, by the extensions. CRAM is not supported.

    The blocks of a BAM file are packed by the tasks and go through the driver one after the other, as one file has one writer.
    """
    if source.endswith(".cram") or output.endswith(".cram"):
        raise ValueError("CRAM is not supported")
    lifter, loaded = load(spark, chain_path, style)
    sizes = [(r["chrom"], r["size"]) for r in loaded.sizes.where("side = 'target'").collect()]
    if source.endswith(".sam"):
        rows = numbered(text_lines.read(spark, source))
        headers = [r["line"] for r in rows.where(F.substring("line", 1, 3).isin("@PG", "@RG", "@CO")).orderBy(*ORDER).select("line").collect()]  # what header_lines() keeps
        reads = sam.parsed(rows)
    else:
        binary.register(spark)
        reads = spark.read.format("bam").load(source).withColumn("rid", F.concat_ws(":", "file", F.col("block").cast("string"), F.col("at").cast("string")))
        headers = binary.bam_header(source)
    done = sam.convert(reads.withColumn("flag0", F.col("flag")), lifter, "rid", [n for n, _ in sizes])
    head = sam.header_lines(headers, sizes)
    paired, status = sam.bit(F.col("flag0"), sam.PAIRED), F.col("status")
    metrics = [F.count(F.lit(1)).alias("total"), *[F.count(F.when(status == s, 1)).alias(s) for s in ("mapped", "failed", "unmapped")], F.count(F.when(paired, 1)).alias("paired")]
    lines = done.select(F.lit("mapped").alias("side"), F.lit(RECORDS).alias("part"), *ORDER, F.lit(0).alias("n"), sam.line(done).alias("line"), "status", "flag0")
    if output.endswith(".sam"):
        heads = listed(spark, head, "mapped", 0).withColumns({"status": F.lit(None).cast("string"), "flag0": F.lit(None).cast("int")})
        metrics[0] = F.count("status").alias("total")
        out = sink.write_lines(lines.unionByName(heads), ["part", *ORDER], {"mapped": output}, metrics)
    else:
        lines = lines.persist()
        try:
            out = lines.agg(*metrics).head().asDict()
            packed = binary.packed_bam(lines.orderBy(*ORDER).select("line"), head)
            data = (bytes(r["data"]) for r in packed.toLocalIterator(prefetchPartitions=True))
            sink.Target(spark, output).write(binary.bam_file(head, data))
        finally:
            lines.unpersist()
    return out | {"single": out["total"] - out["paired"]}
