"""Queries over small tables of their own, against values worked out by hand."""

from anchorspan.queries import domain


def tables(spark, folder, **rows):
    """Tables of rows (schema, values) as the queries read them."""
    for name, (schema, values) in rows.items():
        spark.createDataFrame(values, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def chain(size, start, length, target=None):
    """One chain of one block: chr1 from base 0 to base ``start`` of a target sequence of that size."""
    head = "chain_id bigint, score bigint, t_name string, t_size bigint, t_strand string, t_start bigint, t_end bigint, q_name string, q_size bigint, q_strand string, q_start bigint, q_end bigint"
    lines = "chain_id bigint, block_no int, block_size bigint, dt bigint, dq bigint"
    return {"chain_headers": (head, [(1, 1, "chr1", length, "+", 0, length, target or "chr1", size, "+", start, start + length)]), "chain_lines": (lines, [(1, 0, length, None, None)])}


VCF = "vcf_id bigint, chrom string, pos bigint, variant_id string, ref_allele string, alt_alleles string, filter_status string, info string"


def test_the_reference_is_as_long_as_the_chain_says(spark, tmp_path):
    start = 50_000_001
    values = [(1, "chr1", 10, None, "G", "T", None, None), (2, "1", 20_000, None, "G", "T", None, None), (3, "chr1", 99_000, None, "G", "T", None, None)]
    got = {r["vcf_id"]: r for r in domain.lift_vcf_reference(spark, tables(spark, tmp_path, vcf_records=(VCF, values), **chain(60_000_000, start, 50_000))).collect()}
    for key, pos in ((1, 10), (2, 20_000)):
        assert (got[key]["status"], got[key]["new_pos"], got[key]["new_ref"]) == ("ok", start + pos, domain.REFERENCE[(start + pos - 1) % 12])
    assert got[3]["status"] == "Unmap"


GFF = "gff_id bigint, seqname string, gff_source string, feature string, feat_start bigint, feat_end bigint, score double, strand string, frame_code string, gff_attributes string"


def test_features_are_fetched_whole(spark, tmp_path):
    size = 5_000_000
    spans = {1: ("chr1", 101, 300), 2: ("1", 16_300, 40_000), 3: ("chr1", 4_990_001, 5_000_100), 4: ("chr1", 5_000_001, 5_000_100), 5: ("zz", 1, 200)}
    rows = [(k, n, None, None, a, b, None, "+", None, None) for k, (n, a, b) in spans.items()]
    got = {r["gff_id"]: r["bases"] for r in domain.fasta_fetch(spark, tables(spark, tmp_path, gff_records=(GFF, rows), **chain(size, 0, 1000))).collect()}
    want = {k: "".join(domain.REFERENCE[p % 12] for p in range(a - 1, min(b, size))) or None for k, (_, a, b) in spans.items()}
    assert got == want | {5: None}


def test_quoted_info_is_looked_up(spark, tmp_path):
    info = {1: 'DP=43;AF=0.1;NOTE="x|y";END=7', 2: '"DP=38"', 3: "DB;DP=5", 4: None, 5: 'DP=9;NOTE="a; DB"'}
    got = {r["vcf_id"]: tuple(r)[1:] for r in domain.info_lookup(spark, tables(spark, tmp_path, vcf_records=(VCF, [(k, "chr1", 50, None, "G", "T", None, x) for k, x in info.items()]))).collect()}
    assert got == {
        1: ("43", None, "0.1", 7, 'DP=43;AF=0.1;NOTE="x|y";END=50', 'DP=43;AF=0.1;NOTE="x|y";END=50'), 2: (None, None, None, None, '"DP=38"', '"DP=38";END=50'),
        3: ("5", "", None, None, "DB;DP=5", "DB;DP=5;END=50"), 5: ("9", None, None, None, 'DP=9;NOTE="a; DB"', 'DP=9;NOTE="a; DB";END=50'),
    }


def test_gff_keeps_its_score(spark, tmp_path):
    scores = {1: 0.533, 2: None, 3: 1.0, 4: 1e-7, 5: 12345678.25, 6: float("nan")}
    rows = [(k, "chr1", "src", "exon", 11, 20, x, "+", "0", "ID=a") for k, x in scores.items()]
    got = {r["gff_id"]: r["out_line"].split("\t")[5] for r in domain.lift_gff(spark, tables(spark, tmp_path, gff_records=(GFF, rows), **chain(5_000, 0, 1000))).collect()}
    assert got == {1: "0.533", 2: ".", 3: "1", 4: "0.0000001", 5: "12345678.25", 6: "NaN"}


def test_points_and_features_without_a_value_or_chromosome_stay(spark, tmp_path):
    points = [(1, "t", "chr1", 10, 20, 0.5, 1), (2, "t", "chr1", 20, 30, None, 1), (3, "t", "chr1", 30, 40, float("nan"), 1), (4, "t", None, 30, 40, 1.0, 1)]
    wig = "point_id bigint, track_id string, chrom string, point_start bigint, point_end bigint, point_value double, loaded_at bigint"
    features = [(1, None, None, None, 11, 20, None, "+", None, None), (2, "chr1", None, None, 11, 20, None, "+", None, None)]
    at = tables(spark, tmp_path, wig_points=(wig, points), gff_records=(GFF, features), **chain(5_000, 0, 1000))
    assert sorted((r["point_id"], r["status"], r["t_start"]) for r in domain.lift_wig(spark, at).collect()) == [(1, "ok", 10), (2, "no_value", None), (3, "ok", 30), (4, "unmapped", None)]
    assert sorted((r["gff_id"], r["status"]) for r in domain.lift_gff(spark, at).collect()) == [(1, "unmapped"), (2, "ok")]


def test_maf_gets_the_bases_of_its_new_place(spark, tmp_path):
    texts = ["Chromosome Start_Position End_Position Strand Reference_Allele NCBI_Build", "chr1 11 30 + A old", "chr1 4001 4002 + A old"]
    lines = [(k, "maf", "a.maf", k, x.replace(" ", "\t")) for k, x in enumerate(texts)]
    made = chain(60_000_000, 0, 1000)
    made["chain_headers"][1][0] = (1, 1, "chr1", 1000, "+", 0, 1000, "chr1", 60_000_000, "-", 5_000_000, 5_001_000)
    got = {r["line_id"]: r for r in domain.lift_maf_reference(spark, tables(spark, tmp_path, raw_lines=("line_id bigint, file_kind string, file_name string, line_no bigint, raw_line string", lines), **made)).collect()}
    end = 60_000_000 - 5_000_010
    bases = "".join(domain.REFERENCE[p % 12] for p in range(end - 20, end))
    turned = bases[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert (got[1]["status"], got[1]["out_line"].split("\t")) == ("ok", ["chr1", str(end - 19), str(end), "+", turned, "new"])
    assert got[2]["status"] == "unmapped"
