"""Queries of the lift and of its parts over the delivered tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorspan.functions import chrom as names
from anchorspan.functions import cigar, dna, numbers, variants
from anchorspan.operators import lift
from anchorspan.operators.intervals import intersect, interval_join
from anchorspan.operators.lift import Lifter
from anchorspan.plans import bed as bed_plan
from anchorspan.plans import files
from anchorspan.plans import gff as gff_plan
from anchorspan.plans import maf as maf_plan
from anchorspan.plans import region as region_plan
from anchorspan.plans import sam as sam_plan
from anchorspan.plans import vcf as vcf_plan
from anchorspan.plans import wig as wig_plan
from anchorspan.sources import binary, chain, fasta, sink
from anchorspan.sources import lines as text_lines
from anchorspan.sources import wig as wig_source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.blocks_from_tables(table(spark, sf_dir, "chain_headers"), table(spark, sf_dir, "chain_lines"))


def lifter(spark: SparkSession, sf_dir: str, style: str = "a", max_sent: int = lift.MAX_SENT) -> Lifter:
    return Lifter(blocks(spark, sf_dir), style, max_sent=max_sent)


def newest(df: DataFrame, key: str) -> DataFrame:
    """One row per record id: the deliveries of a record are equal but for loaded_at. Cut df to the columns in need first."""
    return df.drop("loaded_at").distinct()


def bed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bed_records as BED lines: six columns, or twelve where the block columns are there. Null chromosomes, names, scores and strands become dots; a dot is an unknown chromosome."""
    df = table(spark, sf_dir, "bed_records")
    dotted = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    six = F.concat_ws("\t", dotted("chrom"), F.col("chrom_start").cast("string"), F.col("chrom_end").cast("string"), dotted("bed_name"), dotted("score"), dotted("strand"))
    more = F.concat_ws("\t", six, F.col("thick_start").cast("string"), F.col("thick_end").cast("string"), "item_rgb", F.col("block_count").cast("string"), "block_sizes", "block_starts")
    whole = F.col("thick_start").isNotNull() & F.col("thick_end").isNotNull() & F.col("item_rgb").isNotNull() & F.col("block_count").isNotNull() & F.col("block_sizes").isNotNull() & F.col("block_starts").isNotNull()
    return df.select(F.col("bed_id").alias("at"), F.when(whole, more).otherwise(six).alias("line")).distinct()


def vcf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vcf_records as VCF lines, with FORMAT and sample where they are there. QUAL is its shortest text without a closing .0; null fields become dots, which are an unknown chromosome, too."""
    df = table(spark, sf_dir, "vcf_records")
    dotted = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    columns = set(df.columns)
    qual = F.coalesce(numbers.plain_double(F.col("qual")), F.lit(".")) if "qual" in columns else F.lit(".")
    fields = [dotted("chrom"), F.col("pos").cast("string"), *[dotted(c) for c in ("variant_id", "ref_allele", "alt_alleles")], qual, dotted("filter_status"), dotted("info")]
    if {"gt_format", "sample_gt"} <= columns:
        fields += [F.when(F.col("gt_format").isNotNull() & F.col("sample_gt").isNotNull(), F.concat_ws("\t", "gt_format", "sample_gt"))]
    return df.select(F.col("vcf_id").alias("at"), F.concat_ws("\t", *fields).alias("line")).distinct()


def gff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gff_records as GFF lines. A score is its shortest text without a closing .0 (numbers.shortest); null fields become dots, which are an unknown chromosome, too."""
    df = table(spark, sf_dir, "gff_records")
    dotted = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    fields = [dotted("seqname"), dotted("gff_source"), dotted("feature"), F.col("feat_start").cast("string"), F.col("feat_end").cast("string"), F.coalesce(numbers.plain_double(F.col("score")), F.lit(".")), dotted("strand"), dotted("frame_code"), dotted("gff_attributes")]
    return df.select(F.col("gff_id").alias("at"), F.concat_ws("\t", *fields).alias("line")).distinct()


# ---- chains -------------------------------------------------------------------------------------------------------


@query
def chain_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain text back to headers: the tables as lines, parsed."""
    h = table(spark, sf_dir, "chain_headers")
    order = ["score", "t_name", "t_size", "t_strand", "t_start", "t_end", "q_name", "q_size", "q_strand", "q_start", "q_end", "chain_id"]
    lines = h.select(F.lit("x").alias("path"), F.col("chain_id").alias("line_no"), F.concat_ws(" ", F.lit("chain"), *[F.col(c).cast("string") for c in order]).alias("line"))
    return chain.load(lines).headers.select("chain_id", *chain.HEADER_FIELDS)


@query
def chain_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned interval pairs of every chain."""
    return blocks(spark, sf_dir)


@query
def chain_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from text: header and data lines in one stream of lines, run through the section parser."""
    h, d = table(spark, sf_dir, "chain_headers"), table(spark, sf_dir, "chain_lines")
    order = ["score", "t_name", "t_size", "t_strand", "t_start", "t_end", "q_name", "q_size", "q_strand", "q_start", "q_end", "chain_id"]
    head = h.select((F.col("chain_id") * 100_000).alias("line_no"), F.concat_ws(" ", F.lit("chain"), *[F.col(c).cast("string") for c in order]).alias("line"))
    data = d.select((F.col("chain_id") * 100_000 + 1 + F.col("block_no")).alias("line_no"), F.concat_ws("\t", *[F.col(c).cast("string") for c in ("block_size", "dt", "dq")]).alias("line"))
    lines = head.unionByName(data).select(F.lit("x").alias("path"), "line_no", "line")
    return chain.load(lines).blocks.drop("block_id")


@query
def chain_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence sizes of both sides, the last header's for each name."""
    sides = {"source": "t", "target": "q"}
    named = table(spark, sf_dir, "chain_headers").select("chain_id", *[F.col(f"{c}_{x}").alias(f"{s}_{x}") for s, c in sides.items() for x in ("name", "size")])
    return chain.sizes(named, F.col("chain_id"))


def _chain_lines(spark: SparkSession, sf_dir: str, comments: bool = False) -> DataFrame:
    """The chain tables as lines of one file. comments: with blank and # lines between chains, and one within every third chain after its second line."""
    h, d = table(spark, sf_dir, "chain_headers"), table(spark, sf_dir, "chain_lines")
    order = ["score", "t_name", "t_size", "t_strand", "t_start", "t_end", "q_name", "q_size", "q_strand", "q_start", "q_end", "chain_id"]
    first = F.col("chain_id") * 1_000_000
    head = h.select((first + 10).alias("line_no"), F.concat_ws(" ", F.lit("chain"), *[F.col(c).cast("string") for c in order]).alias("line"))
    data = d.select((first + 20 + F.col("block_no") * 2).alias("line_no"), F.concat_ws("\t", *[F.col(c).cast("string") for c in ("block_size", "dt", "dq")]).alias("line"))
    parts = [head, data]
    if comments:
        parts += [h.select((first + 1).alias("line_no"), F.lit("# chain").alias("line")), h.select((first + 2).alias("line_no"), F.lit("  ").alias("line")), h.where("chain_id % 3 = 0").select((first + 23).alias("line_no"), F.lit("# inside").alias("line"))]
    return reduce(DataFrame.unionByName, parts).select(F.lit("x").alias("path"), "line_no", "line")


@query
def chain_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the chains as text with blank and # lines; a # line within a chain ends it."""
    return chain.load(_chain_lines(spark, sf_dir, True)).blocks.drop("block_id")


@query
def chain_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain lines that are made faulty by turns, with the kind of their fault."""
    n, x = F.col("line_no") % 11, F.split("line", r"\s+")
    cut = lambda i, value: F.array_join(F.transform(x, lambda v, k: F.when(k == i, F.lit(value)).otherwise(v)), " ")
    lines = _chain_lines(spark, sf_dir)
    head = F.col("line").startswith("chain")
    turns = F.when(head, F.when(F.col("line_no") % 7_000_000 == 10, cut(4, "x")).when(F.col("line_no") % 5_000_000 == 10, cut(3, "12a")).when(F.col("line_no") % 3_000_000 == 10, cut(6, "9999999999999")).when(F.col("line_no") % 2_000_000 == 10, F.array_join(F.slice(x, 1, 9), " "))).otherwise(
        F.when(n == 1, F.concat("line", F.lit("\t4"))).when(n == 2, cut(0, "0")).when(n == 3, cut(0, "-4"))
    )
    headers, data = chain.parse(lines.withColumn("line", F.coalesce(turns, "line")))
    faulty = [df.where(F.col("error").isNotNull()).select("line_no", F.col("error").alias("kind")) for df in (headers, data)]
    return faulty[0].unionByName(faulty[1])


@query
def chain_size_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target size of every record chromosome, by its name as it is, without chr, or with it."""
    sizes = {r["chrom"]: r["size"] for r in chain_sizes(spark, sf_dir).where("side = 'target'").collect()}
    c = F.col("chrom")
    known = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])
    asked = table(spark, sf_dir, "bed_records").where(c.isNotNull()).select("chrom").distinct()
    return asked.select("chrom", F.coalesce(*[F.try_element_at(known, n) for n in (c, F.regexp_replace(c, "^chr", ""), F.concat(F.lit("chr"), c))]).alias("size"))


@query
def fasta_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences made of the reference alleles of a chromosome as FASTA lines over many splits, read as chunks of 50 bases."""
    v = newest(table(spark, sf_dir, "vcf_records").select("vcf_id", "chrom", "ref_allele"), "vcf_id").select("vcf_id", names.chrom_key(F.col("chrom")).alias("file"), "ref_allele").where("file is not null and ref_allele is not null")
    lines = v.select("file", F.floor(F.col("vcf_id") / 500).alias("block"), F.col("vcf_id").alias("at"), F.col("ref_allele").alias("line"))
    heads = v.select("file").distinct().select("file", F.lit(-1).cast("bigint").alias("block"), F.lit(-1).cast("bigint").alias("at"), F.concat(F.lit("> "), "file", F.lit(" made up")).alias("line"))
    return fasta.from_lines(lines.unionByName(heads), 50)


@query
def blocks_per_chrom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each source chromosome."""
    return blocks(spark, sf_dir).groupBy("source_chrom").agg(F.count(F.lit(1)).alias("n_blocks"))


# ---- names and scalars --------------------------------------------------------------------------------------------


@query
def chrom_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling of a chromosome with its key, alias and both styles."""
    c = F.col("chrom")
    seen = table(spark, sf_dir, "bed_records").where(c.isNotNull()).select("chrom").distinct()
    return seen.select("chrom", names.normalize(c).alias("normal"), names.chrom_key(c).alias("chrom_key"), names.alias_key(c).alias("alias_key"), names.apply_style(c, "s").alias("short_name"), names.apply_style(c, "l").alias("long_name"))


@query
def chroms_equivalent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether both ends of a chain lie on chromosomes of one name."""
    h = table(spark, sf_dir, "chain_headers")
    return h.select("chain_id", names.equivalent(F.col("t_name"), F.col("q_name")).alias("same_name"))


@query
def chrom_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain's own name of every record chromosome that has one."""
    bed = table(spark, sf_dir, "bed_records").select(F.col("chrom").alias("q_chrom"))
    return lift.resolved_names(bed, blocks(spark, sf_dir))


@query
def chrom_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records per table whose chromosome the chain has (semi join on resolved names)."""
    bed = newest(table(spark, sf_dir, "bed_records").select("bed_id", "chrom", "chrom_start", "chrom_end", "strand", "thick_start", "thick_end"), "bed_id").select(F.col("chrom").alias("q_chrom"), "bed_id")
    known = lift.resolved_names(bed, blocks(spark, sf_dir))
    return bed.join(known, "q_chrom", "left_semi").groupBy("q_chrom").agg(F.count(F.lit(1)).alias("n_records"))


@query
def dna_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complement, reverse complement, read reverse complement and validity of reference alleles."""
    r = F.col("ref_allele")
    rows = newest(table(spark, sf_dir, "vcf_records").select("vcf_id", "ref_allele", "alt_alleles", "info", "pos"), "vcf_id")
    return rows.select("vcf_id", dna.complement(r).alias("complement"), dna.revcomp(r).alias("revcomp"), dna.read_revcomp(r).alias("read_revcomp"), dna.is_dna(r).alias("is_dna"))


@query
def strand_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strand of a record on the target for each pair of strands."""
    h = table(spark, sf_dir, "chain_headers")
    return h.select("chain_id", lift.combined_strand(F.col("t_strand"), F.col("q_strand")).alias("combined"))


@query
def intersect_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the record and its thick part share."""
    bed = newest(table(spark, sf_dir, "bed_records").select("bed_id", "chrom", "chrom_start", "chrom_end", "strand", "thick_start", "thick_end"), "bed_id").where(F.col("thick_start").isNotNull())
    both = intersect(F.col("chrom_start"), F.col("chrom_end"), F.col("thick_start"), F.col("thick_end"))
    return bed.select("bed_id", both["start"].alias("both_start"), both["end"].alias("both_end"))


@query
def info_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of INFO by key, flags as empty texts, and END rewritten in both ways."""
    i = F.col("info")
    rows = newest(table(spark, sf_dir, "vcf_records").select("vcf_id", "info", "pos"), "vcf_id").where(i.isNotNull())
    got = variants.info_map(i)
    return rows.select(
        "vcf_id", F.try_element_at(got, F.lit("DP")).alias("dp"), F.try_element_at(got, F.lit("DB")).alias("db"), variants.info_value(i, "AF").alias("af"), variants.end_position(i).alias("end_position"),
        variants.replace_end(i, F.col("pos")).alias("end_replaced"), variants.set_end(i, F.col("pos")).alias("end_set"),
    )


@query
def vcf_variant_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = newest(table(spark, sf_dir, "vcf_records").select("vcf_id", "ref_allele", "alt_alleles", "info", "pos"), "vcf_id")
    return rows.select("vcf_id", variants.variant_type(F.col("ref_allele"), F.coalesce("alt_alleles", F.lit("."))).alias("variant_type"), variants.is_non_ref(F.coalesce("alt_alleles", F.lit("."))).alias("is_non_ref"))


def cigars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up CIGARs of bed_records: nine operations in turn, with neighbours of one kind."""
    bed = newest(table(spark, sf_dir, "bed_records").select("bed_id", "chrom", "chrom_start", "chrom_end", "strand", "thick_start", "thick_end"), "bed_id")
    size = F.col("chrom_end") - F.col("chrom_start")
    parts = [F.concat((F.pmod(size * (k + 3) + F.col("bed_id"), F.lit(50)) + 1).cast("string"), F.substring(F.lit("MIDNSHP=XMM"), (F.pmod(F.col("bed_id") + k * (k + 1) / 2, F.lit(11)) + 1).cast("int"), F.lit(1))) for k in range(5)]
    return bed.select("bed_id", F.concat(*parts).alias("cigar"))


@query
def cigar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths on reference and read, the reversed and the merged CIGAR."""
    c = F.col("cigar")
    return cigars(spark, sf_dir).select("bed_id", "cigar", cigar.reference_length(c).alias("ref_length"), cigar.query_length(c).alias("read_length"), cigar.reverse(c).alias("reversed"), cigar.merge_adjacent(c).alias("merged"))


@query
def cigar_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the CIGARs use up 60 or 100 read bases."""
    c = F.col("cigar")
    return cigars(spark, sf_dir).select("bed_id", cigar.is_valid(c, F.lit(60)).alias("fits_60"), cigar.is_valid(c, F.lit(100)).alias("fits_100"))


@query
def cigar_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CIGARs broken at half of their reference length."""
    got = cigars(spark, sf_dir).withColumn("pair", cigar.broken(F.col("cigar"), F.floor(cigar.reference_length(F.col("cigar")) / 2)))
    return got.select("bed_id", F.col("pair.left").alias("left_part"), F.col("pair.right").alias("right_part"))


# ---- the lift -----------------------------------------------------------------------------------------------------


def _segments(spark: SparkSession, sf_dir: str, style: str = "a", max_sent: int = lift.MAX_SENT) -> DataFrame:
    bed = newest(table(spark, sf_dir, "bed_records").select("bed_id", "chrom", "chrom_start", "chrom_end", "strand", "thick_start", "thick_end"), "bed_id").select("bed_id", "chrom", "chrom_start", "chrom_end", "strand")
    return lifter(spark, sf_dir, style, max_sent).with_segments(bed, "bed_id", F.col("chrom"), F.col("chrom_start"), F.col("chrom_end"), F.col("strand"))


def _exploded(df: DataFrame) -> DataFrame:
    return df.select("bed_id", F.size("segments").alias("n_segments"), F.explode("segments").alias("g")).select("bed_id", "n_segments", "g.*")


@query
def lift_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of every BED record in order, with its place on the target."""
    return _exploded(_segments(spark, sf_dir))


@query
def lift_segments_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the binned join, as for blocks that are too many to be sent."""
    return _exploded(_segments(spark, sf_dir, max_sent=0))


@query
def lift_chrom_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(_segments(spark, sf_dir, "s")).select("bed_id", "seq", "t_chrom")


@query
def lift_chrom_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(_segments(spark, sf_dir, "l")).select("bed_id", "seq", "t_chrom")


@query
def lift_arity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by their number of segments; -1 for an unknown chromosome."""
    return _segments(spark, sf_dir).groupBy(F.coalesce(F.size("segments"), F.lit(-1)).alias("n_segments")).agg(F.count(F.lit(1)).alias("n_records"))


@query
def lift_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without a segment, and whether the chain knows their chromosome."""
    return _segments(spark, sf_dir).where(F.coalesce(F.size("segments"), F.lit(0)) <= 0).select("bed_id", F.col("segments").isNotNull().alias("chrom_known"))


@query
def map_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first place of the first base of every record."""
    bed = newest(table(spark, sf_dir, "bed_records").select("bed_id", "chrom", "chrom_start", "chrom_end", "strand", "thick_start", "thick_end"), "bed_id").select("bed_id", "chrom", "chrom_start")
    got = lifter(spark, sf_dir).with_segments(bed, "bed_id", F.col("chrom"), F.col("chrom_start"), F.col("chrom_start") + 1, F.lit("+"))
    return got.where(F.size("segments") > 0).select("bed_id", F.get("segments", F.lit(0)).alias("g")).select("bed_id", "g.t_chrom", "g.t_start", "g.t_strand")


@query
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of GFF features and chain blocks that share a base, by chromosome key."""
    gff = newest(table(spark, sf_dir, "gff_records").select("gff_id", "seqname", "feat_start", "feat_end"), "gff_id").where("feat_start <= feat_end").select("gff_id", names.chrom_key(F.col("seqname")).alias("k"), (F.col("feat_start") - 1).alias("s"), F.col("feat_end").alias("e"))
    b = blocks(spark, sf_dir).select("block_id", names.chrom_key(F.col("source_chrom")).alias("bk"), "source_start", "source_end")
    return interval_join(gff, b, ["k", "s", "e"], ["bk", "source_start", "source_end"]).select("gff_id", "block_id")


# ---- the formats --------------------------------------------------------------------------------------------------


@query
def lift_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BED records converted: one row per output line, rejects with their line."""
    out = bed_plan.convert(bed_lines(spark, sf_dir), lifter(spark, sf_dir))
    lines = F.when(F.size("out") > 0, F.col("out")).otherwise(F.array("reject"))
    return out.select(F.col("at").alias("bed_id"), "status", F.posexplode(lines).alias("line_no", "line"))


@query
def bed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bed_plan.convert(bed_lines(spark, sf_dir), lifter(spark, sf_dir))
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n_records"), F.sum(F.size("out")).alias("n_lines"))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of the hundredfold length around each BED record's start."""
    bed = newest(table(spark, sf_dir, "bed_records").select("bed_id", "chrom", "chrom_start", "chrom_end", "strand", "thick_start", "thick_end"), "bed_id")
    start, size = F.col("chrom_start"), F.col("chrom_end") - F.col("chrom_start")
    strand = F.coalesce("strand", F.lit("."))
    return bed.select(F.col("bed_id").alias("at"), F.concat_ws("\t", F.coalesce("chrom", F.lit(".")), start.cast("string"), (start + size * F.when(F.col("bed_id") % 3 == 0, 0).when(F.col("bed_id") % 3 == 1, 10).otherwise(100)).cast("string"), F.lit("r"), F.lit("0"), strand).alias("line"))


@query
def lift_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with their outcome, ratio in ten-thousandths and merged place."""
    out = region_plan.convert(_regions(spark, sf_dir), lifter(spark, sf_dir), min_ratio=0.6)
    ok = F.col("status") == "ok"
    return out.select(F.col("at").alias("bed_id"), "status", F.round(F.col("ratio"), 6).alias("ratio"), *[F.when(ok, F.col(c)).alias(c) for c in ("t_chrom", "t_start", "t_end", "t_strand")])


@query
def region_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = region_plan.convert(_regions(spark, sf_dir), lifter(spark, sf_dir), min_ratio=0.6)
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n_regions"))


@query
def lift_vcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VCF records converted without a reference; out_line has QUAL, FORMAT and sample as they were, and is null for rejects."""
    out = vcf_plan.convert(vcf_lines(spark, sf_dir), lifter(spark, sf_dir))
    ok = F.col("status") == "ok"
    return out.select(F.col("at").alias("vcf_id"), "status", *[F.when(ok, F.col(c)).alias(c) for c in ("t_chrom", "new_pos", "new_ref", "new_alt", "new_info")], F.get("out", F.lit(0)).alias("out_line"))


#: The made-up reference repeats this.
REFERENCE = "ACGTTGCAGTCA"


def reference(spark: SparkSession, sf_dir: str, asked: DataFrame) -> DataFrame:
    """A made-up reference as chunks: base p of every sequence is letter p modulo 12 of REFERENCE; sequences are as long as the chain says.

    Of its chunks only those are made that asked (name, start, end) reaches under a name or its other form, and the
    first of every sequence, by which its name is known.
    """
    sizes = chain_sizes(spark, sf_dir).where("side = 'target'").select(F.col("chrom").alias("name"), "size")
    spans = asked.where("start >= 0 and end > start").select(F.explode(F.array(F.col("name"), fasta.other_name(F.col("name")))).alias("name"), "start", "end")
    reached = spans.select("name", F.explode(F.sequence(F.floor(F.col("start") / fasta.CHUNK), F.floor((F.col("end") - 1) / fasta.CHUNK))).alias("chunk_no"))
    chunk_nos = reached.unionByName(sizes.select("name", F.lit(0).cast("bigint").alias("chunk_no"))).distinct()
    first = F.col("chunk_no") * fasta.CHUNK
    rows = chunk_nos.join(sizes, "name").where(first < F.col("size"))
    length = (F.least(first + fasta.CHUNK, F.col("size")) - first).cast("int")
    letters = F.repeat(F.lit(REFERENCE), F.lit(fasta.CHUNK // len(REFERENCE) + 2))
    return rows.select("name", "chunk_no", F.substring(letters, (first % len(REFERENCE)).cast("int") + 1, length).alias("seq"))


@query
def lift_vcf_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VCF records converted with a reference: its base becomes REF; places beyond it fail."""
    lines, to_target = vcf_lines(spark, sf_dir), lifter(spark, sf_dir)
    asked = vcf_plan.convert(lines, to_target).where(F.col("t_chrom").isNotNull()).select(F.col("t_chrom").alias("name"), (F.col("new_pos") - 1).alias("start"), F.col("new_pos").alias("end"))
    out = vcf_plan.convert(lines, to_target, reference(spark, sf_dir, asked))
    ok = F.col("status") == "ok"
    return out.select(F.col("at").alias("vcf_id"), "status", *[F.when(ok, F.col(c)).alias(c) for c in ("t_chrom", "new_pos", "new_ref", "new_alt")])


@query
def fasta_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases of the reference under each GFF feature, by a name with or without prefix."""
    gff = newest(table(spark, sf_dir, "gff_records").select("gff_id", "seqname", "feat_start", "feat_end"), "gff_id").select("gff_id", F.col("seqname").alias("q_name"), (F.col("feat_start") - 1).alias("q_from"), F.col("feat_end").alias("q_to"))
    asked = gff.select(F.col("q_name").alias("name"), F.col("q_from").alias("start"), F.col("q_to").alias("end"))
    return fasta.with_bases(gff, reference(spark, sf_dir, asked), "gff_id", "q_name", "q_from", "q_to", "bases").select("gff_id", "bases")


@query
def lift_gvcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VCF records read as GVCF: those with END map as blocks."""
    out = vcf_plan.convert_gvcf(vcf_lines(spark, sf_dir), lifter(spark, sf_dir))
    ok = F.col("status") == "ok"
    return out.select(F.col("at").alias("vcf_id"), "status", *[F.when(ok, F.col(c)).alias(c) for c in ("t_chrom", "new_pos", "new_alt", "new_info")])


@query
def lift_gvcf_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a reference: the base at the new place becomes REF of all records but blocks."""
    lines, to_target = vcf_lines(spark, sf_dir), lifter(spark, sf_dir)
    placed = vcf_plan.convert_gvcf(lines, to_target).where(F.col("t_chrom").isNotNull() & F.col("stop").isNull())
    asked = placed.select(F.col("t_chrom").alias("name"), (F.col("new_pos") - 1).alias("start"), F.col("new_pos").alias("end"))
    out = vcf_plan.convert_gvcf(lines, to_target, reference(spark, sf_dir, asked))
    return out.select(F.col("at").alias("vcf_id"), "status", F.get("out", F.lit(0)).alias("out_line"))


@query
def lift_gff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GFF features converted; out_line is null for rejects."""
    out = gff_plan.convert(gff_lines(spark, sf_dir), lifter(spark, sf_dir))
    return out.select(F.col("at").alias("gff_id"), "status", F.get("out", F.lit(0)).alias("out_line"))


def maf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = newest(table(spark, sf_dir, "raw_lines"), "line_id").where("file_kind = 'maf'")
    return raw.select(F.col("file_name").alias("file"), F.lit(0).cast("bigint").alias("block"), F.col("line_no").alias("at"), "line_id", F.regexp_replace("raw_line", "\r\\z", "").alias("line"))


@query
def lift_maf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The MAF lines of raw_lines converted by the header of their file, without a reference."""
    out = maf_plan.convert(maf_lines(spark, sf_dir), lifter(spark, sf_dir), "new", rid="line_id")
    return out.select("line_id", "status", F.get("out", F.lit(0)).alias("out_line"))


@query
def lift_maf_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a reference: the bases of the mapped range become Reference_Allele, turned on the minus strand."""
    lines, to_target = maf_lines(spark, sf_dir), lifter(spark, sf_dir)
    placed = maf_plan.convert(lines, to_target, "new", rid="line_id").where(F.col("t_chrom").isNotNull())
    asked = placed.select(F.col("t_chrom").alias("name"), F.col("t_start").alias("start"), F.col("t_end").alias("end"))
    out = maf_plan.convert(lines, to_target, "new", reference(spark, sf_dir, asked), rid="line_id")
    return out.select("line_id", "status", F.get("out", F.lit(0)).alias("out_line"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest(table(spark, sf_dir, "wig_points"), "point_id").select(F.col("point_id").alias("at"), "track_id", "chrom", F.col("point_start").alias("start"), F.col("point_end").alias("end"), F.col("point_value").alias("value"))


@query
def lift_wig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the tracks with their outcome and place on the target; those without a value come out as no_value."""
    out = wig_plan.convert_points(_points(spark, sf_dir), lifter(spark, sf_dir))
    return out.select(F.col("at").alias("point_id"), "status", "t_chrom", "t_start", "t_end")


@query
def wig_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of each track and chromosome, rounded to halves, as merged bedGraph records. A NaN is a record of its own, given with a null value; a point without a value ends a run and is none."""
    value = F.when(F.isnan("value"), F.col("value")).otherwise(F.floor(F.col("value") * 2) / 2)
    rows = _points(spark, sf_dir).select("at", F.concat_ws("|", "track_id", names.chrom_key(F.col("chrom"))).alias("chrom"), "start", "end", value.alias("value"))
    return wig_plan.merge(rows).withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def _wig_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points as lines of one file per track, each as bedGraph, variableStep, or fixedStep with its value twice, in turn. Points without a value leave the word none after a declaration."""
    p, tab = _points(spark, sf_dir).where("value is not null or at % 3 > 0"), lambda *c: F.concat_ws("\t", *[x.cast("string") for x in c])
    c, s, e, v = F.coalesce("chrom", F.lit("none")), F.col("start"), F.col("end"), F.coalesce(F.col("value").cast("string"), F.lit("none"))
    c = F.regexp_replace(c, r"\s", "_")
    kind = F.col("at") % 3
    step = F.concat(F.lit("fixedStep chrom="), c, F.lit(" start="), (s + 1).cast("string"), F.lit(" step=7 span="), (e - s).cast("string"))
    lines = F.when(kind == 0, F.array(tab(c, s, e, v))).when(kind == 1, F.array(F.concat(F.lit("variableStep chrom="), c, F.lit(" span="), (e - s).cast("string")), F.concat_ws(" ", (s + 1).cast("string"), v))).otherwise(F.array(step, v, v))
    rows = p.select(F.col("track_id").alias("file"), F.floor(F.col("at") / 5000).alias("block"), "at", F.posexplode(lines).alias("n", "line"))
    return rows.select("file", "block", (F.col("at") * 4 + F.col("n")).alias("at"), "line")


@query
def wig_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracks as wiggle text, parsed again; lines that are no points come with their error. A NaN has a null value."""
    got = wig_source.points(_wig_text(spark, sf_dir))
    ok = F.col("error").isNull()
    return got.select(F.col("at").alias("line_no"), "error", *[F.when(ok, F.col(c)).alias(c) for c in ("chrom", "start", "end")], F.when(ok & ~F.isnan("value"), F.col("value")).alias("value"))


@query
def bedgraph_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with a value as bedGraph lines."""
    p = _points(spark, sf_dir).where(F.col("value").isNotNull() & F.col("chrom").isNotNull())
    return p.select(F.col("at").alias("point_id"), wig_source.bedgraph_line(F.col("chrom"), F.col("start"), F.col("end"), F.col("value")).alias("line"))


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up reads of bed_records: the interval as one match, every seventh unmapped, every third paired."""
    bed = newest(table(spark, sf_dir, "bed_records").select("bed_id", "chrom", "chrom_start", "chrom_end", "strand", "thick_start", "thick_end"), "bed_id")
    i = F.col("bed_id")
    flag = F.when(i % 7 == 0, 4).otherwise(0) + F.when(F.col("strand") == "-", 16).otherwise(0) + F.when(i % 3 == 0, 1).otherwise(0)
    seq = F.concat(F.substring(F.lit("ACGTN"), (i % 4 + 1).cast("int"), F.lit(2)), F.lit("acR"))
    return bed.select(
        i.alias("at"), F.concat(F.lit("read"), i.cast("string")).alias("qname"), flag.cast("int").alias("flag"), F.col("chrom").alias("rname"), F.col("chrom_start").alias("pos"), (i % 60).cast("int").alias("mapq"),
        F.concat(F.lit("2S"), (F.col("chrom_end") - F.col("chrom_start")).cast("string"), F.lit("M3I")).alias("cigar"), F.lit("=").alias("rnext"), F.lit(5).cast("bigint").alias("pnext"), F.lit(9).cast("bigint").alias("tlen"),
        seq.alias("seq"), F.lit("FGHIJ").alias("qual"), F.array(F.lit("NM:i:1"), F.lit("OC:Z:5M")).alias("tags"),
    )


@query
def lift_sam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads converted: flags, place, CIGAR and sequence on the target."""
    out = sam_plan.convert(_reads(spark, sf_dir), lifter(spark, sf_dir))
    return out.select(F.col("at").alias("bed_id"), "status", "flag", "rname", "pos", "mapq", "cigar", "seq", "qual", F.array_join("tags", ";").alias("tags"))


@query
def sam_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads as alignment lines, parsed, converted and written as lines again."""
    reads = _reads(spark, sf_dir).withColumn("rname", F.coalesce("rname", F.lit("*")))
    text = reads.select("at", sam_plan.line(reads).alias("line"))
    done = sam_plan.convert(sam_plan.parsed(text), lifter(spark, sf_dir))
    return done.select(F.col("at").alias("bed_id"), sam_plan.line(done).alias("line"))


@query
def sam_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = _reads(spark, sf_dir).withColumn("flag0", F.col("flag"))
    return sam_plan.stats(sam_plan.convert(reads, lifter(spark, sf_dir)), "flag0")


# ---- files --------------------------------------------------------------------------------------------------------


def _scratch(spark: SparkSession) -> str:
    """A new folder below the shared one that the session names; one of this machine only where none is named, as in tests."""
    return f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.gettempdir()}/anchorspan-{uuid.uuid4().hex}"


def _file(rows: DataFrame, order: str, path: str, head: list[str] = ()) -> str:
    """Writes the column ``line`` as one file, in order."""
    first = rows.sparkSession.createDataFrame([(i - len(head), x) for i, x in enumerate(head)], "at bigint, line string")
    lines = rows.select(F.col(order).cast("bigint").alias("at"), "line").unionByName(first).withColumn("side", F.lit("mapped"))
    sink.write_lines(lines, ["at"], {"mapped": path})
    return path


@query
def file_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BED records through files: chain and records are written, the file is converted to one file and one of rejects, and both are read."""
    at = _scratch(spark)
    files.convert_bed(spark, _file(_chain_lines(spark, sf_dir), "line_no", f"{at}/a.chain"), _file(bed_lines(spark, sf_dir), "at", f"{at}/in.bed"), f"{at}/out.bed")
    sides = {"mapped": f"{at}/out.bed", "unmapped": f"{at}/out.bed.unmap"}
    return reduce(DataFrame.unionByName, [text_lines.read(spark, p).select(F.lit(s).alias("side"), "line") for s, p in sides.items()])


@query
def file_bam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads through files: alignment text is converted to a BAM file, which is read in splits."""
    at = _scratch(spark)
    reads = _reads(spark, sf_dir).withColumn("rname", F.coalesce("rname", F.lit("*")))
    text = reads.select("at", sam_plan.line(reads).alias("line"))
    files.convert_alignments(spark, _file(_chain_lines(spark, sf_dir), "line_no", f"{at}/a.chain"), _file(text, "at", f"{at}/in.sam", ["@HD\tVN:1.0"]), f"{at}/out.bam")
    binary.register(spark)
    got = spark.read.format("bam").option("splitBytes", 100_000).load(f"{at}/out.bam")
    return got.select(sam_plan.line(got).alias("line"))


# ---- checks of one result against another -------------------------------------------------------------------------


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = []
    for name, s in (("lift_ref", "a"), ("lift_test", "b")):
        df = table(spark, sf_dir, name).where(F.col("lift_key").isNotNull())
        top = df.groupBy(names.trimmed(F.col("lift_key")).alias("lift_key")).agg(F.max(F.struct("loaded_at", "chrom", "chrom_start", "chrom_end", "strand")).alias(s))
        sides.append(top)
    return sides[0].join(sides[1], "lift_key", "left")


@query
def accuracy_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reference record as identical, partial (some overlap), mismatch or missing in the test."""
    a, b = F.col("a"), F.col("b")
    same_chrom = names.chrom_key(a["chrom"]).eqNullSafe(names.chrom_key(b["chrom"]))
    same = same_chrom & a["chrom_start"].eqNullSafe(b["chrom_start"]) & a["chrom_end"].eqNullSafe(b["chrom_end"])
    overlap = same_chrom & (a["chrom_start"] < b["chrom_end"]) & (a["chrom_end"] > b["chrom_start"])
    kind = F.when(b.isNull(), "missing").when(same, "identical").when(overlap, "partial").otherwise("mismatch")
    return _paired(spark, sf_dir).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n_records"))


@query
def drift_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records on one chromosome in both results by how far their starts lie apart."""
    a, b = F.col("a"), F.col("b")
    both = _paired(spark, sf_dir).where(b.isNotNull() & (names.chrom_key(a["chrom"]) == names.chrom_key(b["chrom"])))
    drift = F.abs(a["chrom_start"] - b["chrom_start"])
    bucket = F.when(drift == 0, "0").when(drift == 1, "1").when(drift <= 100, "2-100").when(drift > 100, ">100").otherwise("unknown")
    return both.groupBy(bucket.alias("drift")).agg(F.count(F.lit(1)).alias("n_records"))
