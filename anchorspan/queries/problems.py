"""Queries p1 to p5 over the delivered tables. Each runs its operator with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorspan.functions.chrom import chrom_key, trimmed
from anchorspan.operators import keystats, lineparse, packed, runs, tablediff

#: A chromosome is overloaded if it holds at least this share of the keyed rows of its table.
HOT_SHARE = 0.05


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _by_chrom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both record tables compressed to (record_table, chrom_key, value, freq); the value is the length on the reference."""
    value = {"bed_records": F.col("chrom_end") - F.col("chrom_start"), "vcf_records": F.length("ref_allele").cast("bigint")}
    sides = [table(spark, sf_dir, name).select(F.lit(name).alias("record_table"), chrom_key(F.col("chrom")).alias("chrom_key"), v.alias("v")) for name, v in value.items()]
    return keystats.compress(sides[0].unionByName(sides[1]), {k: F.col(k) for k in KEYS}, F.col("v"))


KEYS = ["record_table", "chrom_key"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chromosome keys that hold at least 5 % of the keyed rows of their table."""
    return keystats.hot_keys(keystats.key_counts(_by_chrom(spark, sf_dir), KEYS), ["record_table"], HOT_SHARE).select(*KEYS)


def p1_chrom_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per table and chromosome: rows, distinct lengths, their mode and percentiles, and the bases of bed_records covered."""
    rows = keystats.ranked(_by_chrom(spark, sf_dir), KEYS)
    bed = table(spark, sf_dir, "bed_records")
    covered = keystats.covered_parts(bed, {"chrom_key": chrom_key(F.col("chrom"))}, F.col("chrom_start"), F.col("chrom_end")).withColumn("record_table", F.lit("bed_records"))
    both = rows.unionByName(covered, allowMissingColumns=True)  # one aggregate for both: a row has either a value or a covered part
    per = both.groupBy(*KEYS).agg(*keystats.counts(), keystats.percentile(0.5).alias("p50"), keystats.percentile(0.9).alias("p90"), F.sum("covered").alias("covered"))
    return per.select(*KEYS, "n_rows", "n_values", "n_distinct", F.col("top.v").alias("mode"), (-F.col("top.f")).alias("mode_freq"), "p50", "p90", "covered")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two or more points of a track and chromosome with the same value."""
    return _runs(spark, sf_dir, 2).select("track_id", "chrom_key", "run_start", "run_end", "n_points")


def p2_bedgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run, single points too, as one bedGraph record with its value, number of points and duration."""
    return _runs(spark, sf_dir, 1).withColumn("duration", F.col("run_end") - F.col("run_start"))


def _runs(spark: SparkSession, sf_dir: str, least: int) -> DataFrame:
    points = table(spark, sf_dir, "wig_points")
    entity = {"track_id": F.col("track_id"), "chrom_key": chrom_key(F.col("chrom"))}
    return runs.collapse_runs(points, entity, F.col("point_id"), F.col("point_start"), F.col("point_end"), F.col("point_value"), min_points=least)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data lines that fail, with the fault that their cheapest edits state."""
    return lineparse.failed(table(spark, sf_dir, "raw_lines")).select("line_id", "fault").distinct()


def p3_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that load: their file, place and fields."""
    return lineparse.loaded(table(spark, sf_dir, "raw_lines"))


PACKED = {"info": ("vcf_records", "vcf_id", True), "alt_alleles": ("vcf_records", "vcf_id", False), "block_sizes": ("bed_records", "bed_id", False), "gff_attributes": ("gff_records", "gff_id", True)}


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per value of each packed field that holds at least two."""
    out = None
    for field, (name, key, pairs) in PACKED.items():
        part = packed.unpack(table(spark, sf_dir, name), F.col(key), F.col(field), pairs, field, at_least=2)
        out = part if out is None else out.unionByName(part)
    return out


#: Rows of a chunk: the two tools differ in one of some twenty records, so longer chunks would nearly all differ somewhere.
DIFF_CHUNK = 8
FIELDS = ["chrom", "chrom_start", "chrom_end", "strand"]


def _lift_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = []
    for name in ("lift_ref", "lift_test"):
        fields = {"chrom": chrom_key(F.col("chrom")), "chrom_start": F.col("chrom_start"), "chrom_end": F.col("chrom_end"), "strand": F.col("strand")}
        sides.append(tablediff.newest(table(spark, sf_dir, name), trimmed(F.col("lift_key")), fields, F.col("loaded_at")))
    return tablediff.diff(*sides, FIELDS, {"chrom_start": 1, "chrom_end": 1}, missing=("missing_in_ref", "missing_in_test"), chunk_rows=DIFF_CHUNK)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that one copy lacks and fields that differ between the copies."""
    return _lift_diff(spark, sf_dir).select(F.col("key").alias("lift_key"), "diff_kind")


def p5_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The differences with the values of both copies."""
    return _lift_diff(spark, sf_dir).select(F.col("key").alias("lift_key"), "diff_kind", F.col("left_value").alias("ref_value"), F.col("right_value").alias("test_value"))


QUERIES = {f.__name__: f for f in (p1_found, p1_chrom_stats, p2_found, p2_bedgraph, p3_found, p3_loaded, p4_found, p5_found, p5_values)}
