import importlib.util
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else value


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    texts = importlib.util.find_spec("anchorspan.llm") is not None
    assert any(q.startswith("p6_") for q in entry.queries()) == texts
    for n in range(1, 6):
        assert f"p{n}_found" in entry.queries()


@data
def test_flagship(spark):
    got = entry.entry(spark)
    assert got.columns == ["bed_id", "status", "line_no", "line"] and got.count() > 0


@pytest.fixture
def production(spark):
    """The session as it is used: with adaptive execution and compiled plans, which other tests leave out for their time."""
    names = ["spark.sql.adaptive.enabled", "spark.sql.codegen.wholeStage", "spark.sql.codegen.factoryMode"]
    before = {n: spark.conf.get(n) for n in names}
    for n, value in zip(names, ["true", "true", "FALLBACK"], strict=True):
        spark.conf.set(n, value)
    yield spark
    for n, value in before.items():
        spark.conf.set(n, value)


#: One query of each kind; the driver compares all of them.
CHECKED = ["p3_loaded", "p5_values", "chain_faults", "wig_text", "file_bed", "lift_gvcf_reference", "p1_found", "p1_chrom_stats", "p2_found", "p3_found", "p4_found", "p5_found", "chain_text_blocks", "chrom_resolve", "lift_segments", "lift_segments_join", "lift_bed", "lift_region", "lift_vcf", "lift_gvcf", "lift_maf", "wig_merge", "lift_sam"]


@data
@pytest.mark.parametrize("name", [n for n in CHECKED if n in entry.oracle_sql()])
def test_query_equals_its_sql(production, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for file in os.listdir(DATA):
        db.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    want = db.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](production, DATA)
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    place = [want.columns.index(c) for c in columns]
    assert sorted(repr(plain(tuple(r[c] for c in columns))) for r in got.collect()) == sorted(repr(plain(tuple(r[i] for i in place))) for r in want.fetchall())


@data
def test_result_does_not_depend_on_partitions(spark):
    seen = set()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 7):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.add(tuple(sorted(tuple(r) for r in entry.queries()["p2_found"](spark, DATA).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1
