import pytest
from pyspark.sql import functions as F

from anchorspan.operators.lift import Lifter
from anchorspan.sources import chain
from anchorspan.streaming import lift
from tests.chains import PLUS

SCHEMA = "id long, chrom string, start long, end long, strand string, at timestamp"


def test_lift_of_a_stream(spark, tmp_path):
    lifter = Lifter(chain.load(chain.lines_of(spark, PLUS)).blocks)
    rows = [(1, "chr7", 5020, 5080, "+"), (1, "chr7", 5020, 5080, "+"), (2, "chr7", 0, 50, "+"), (3, "zz", 0, 50, "+"), (4, "chr7", 5100, 5200, "-")]
    df = spark.createDataFrame([(*r,) for r in rows], "id long, chrom string, start long, end long, strand string").withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    once = lift.delivered_once(stream, "id", "at", "1 hour")
    lifted = lift.lift_stream(once, lifter, F.col("chrom"), F.col("start"), F.col("end"), F.col("strand"))
    q = lifted.writeStream.format("memory").queryName("lifted").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.id, r.status) for r in spark.table("lifted").collect()) == [(1, "ok"), (2, "unmapped"), (3, "unknown_chrom"), (4, "multi")]
    counts = lift.outcome_counts(lift.lift_stream(stream, lifter, F.col("chrom"), F.col("start"), F.col("end"), F.col("strand")), "at", "1 day", "1 hour")
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.status, r.n) for r in spark.table("counts").collect()} == {("ok", 2), ("unmapped", 1), ("unknown_chrom", 1), ("multi", 1)}


def test_batches_are_lifted_by_the_join(spark, tmp_path):
    """Blocks that are not sent to the workers: the result is that of the projection."""
    lifter = Lifter(chain.load(chain.lines_of(spark, PLUS)).blocks, max_sent=0)
    rows = [(1, "chr7", 5020, 5080, "+"), (2, "chr7", 0, 50, "+"), (3, "zz", 0, 50, "+"), (4, "7", 5100, 5200, "-"), (5, None, 1, 2, None)]
    spark.createDataFrame(rows, "id long, chrom string, start long, end long, strand string").withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id"))).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    got = {}
    write = lambda batch, number: got.update({number: [(r.id, r.status, r.segments and [(g.t_chrom, g.t_start) for g in r.segments]) for r in batch.orderBy("id").collect()]})
    q = lift.lift_batches(stream, lifter, F.col("chrom"), F.col("start"), F.col("end"), F.col("strand"), write).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert got == {0: [(1, "ok", [("chr7", 12020)]), (2, "unmapped", []), (3, "unknown_chrom", None), (4, "multi", [("7", 12100), ("7", 12165)]), (5, "unknown_chrom", None)]}
    with pytest.raises(ValueError):
        lift.lift_stream(stream, lifter, F.col("chrom"), F.col("start"), F.col("end"), F.col("strand"))
