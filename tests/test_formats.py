import gzip

import pytest
from pyspark.sql import functions as F

from anchorspan import cli
from anchorspan.operators.lift import Lifter
from anchorspan.plans import bed, files, gff, maf, region, sam, vcf, wig
from anchorspan.sources import binary, chain, fasta, sink
from anchorspan.sources import lines as text_lines
from anchorspan.sources import wig as wig_source
from tests.chains import BACK, MINUS, PLUS


@pytest.fixture(scope="module")
def plus(spark):
    return Lifter(chain.load(chain.lines_of(spark, PLUS)).blocks)


@pytest.fixture(scope="module")
def minus(spark):
    return Lifter(chain.load(chain.lines_of(spark, MINUS)).blocks)


def run(spark, plan, texts, *args):
    rows = text_lines.from_rows(spark, [t.replace(" ", "\t") for t in texts])
    return [(r.status, [x.replace("\t", " ") for x in r.out], r.reject and r.reject.replace("\t", " ")) for r in plan(rows, *args).orderBy("at").collect()]


def test_bed(spark, plus):
    got = run(spark, bed.convert, ["# head", "track x", "chr7 5020 5080", "chr7 5100 5200 n 5 - 1 2", "chr7 0 50 n", "chr7 x 50", "chr7 007 050 q", "chr7 1", "", "chr7 180 120", "chr7 5020 5080 n 5 ."], plus)
    assert got == [
        ("ok", ["chr7 12020 12080"], None), ("multi", ["chr7 12100 12120 n 5 -", "chr7 12165 12215 n 5 -"], None), ("unmapped", [], "chr7 0 50 n"), ("parse_error", [], "chr7 x 50"), ("unmapped", [], "chr7 7 50 q"),
        ("parse_error", [], "chr7 1"), ("unmapped", [], "chr7 180 120"), ("ok", ["chr7 12020 12080 n 5 +"], None),
    ]


@pytest.mark.parametrize("max_sent", [500_000, 0])
def test_span_segments_in_both_forms(spark, max_sent):
    lifter = Lifter(chain.load(chain.lines_of(spark, PLUS)).blocks, max_sent=max_sent)
    rows = [(1, "chr7", [(5010, 5020), (5125, 5135), (5110, 5160)], "+"), (2, "chr7", None, "-"), (3, "zz", [(1, 2)], "+"), (4, "chr7", [], "+"), (5, "7", [(5160, 5170)], "-")]
    df = spark.createDataFrame(rows, "rid long, chrom string, spans array<struct<s:long,e:long>>, strand string")
    got = lifter.with_span_segments(df, "rid", F.col("chrom"), F.col("spans"), F.col("strand"), "parts").orderBy("rid").collect()
    shown = [r.parts and [x and [(g.t_chrom, g.t_start, g.t_end, g.t_strand) for g in x] for x in r.parts] for r in got]
    want = [[[("chr7", 12010, 12020, "+")], [], [("chr7", 12110, 12120, "+"), ("chr7", 12165, 12175, "+")]], None, [None], None, [[("7", 12175, 12185, "-")]]]
    assert [x or None for x in shown] == want


def test_bed12(spark, plus, minus):
    texts = [
        "chr7 5010 5225 g 5 + 5020 5215 0 2 20,30, 0,185, more", "chr7 5010 5225 g 5 + 5020 5215 0 2 20,30 0,110", "chr7 5010 5225 g 5 + 5020 5215 0 2 x 0,200", "chr7 5010 5090 g 5 + a b 0 1 80 0",
    ]
    got = run(spark, bed.convert, texts, plus)
    assert got[0] == ("ok", ["chr7 12010 12240 g 5 + 12020 12230 0 2 20,30 0,200 more"], None)
    assert got[1][0] == "unmapped"  # the second block lies over a gap
    assert got[2] == ("multi", ["chr7 12010 12120 g 5 + 12020 12120 0 2 x 7000,7200", "chr7 12165 12240 g 5 + 12175 12240 0 2 x 7155,7355"], None)
    assert got[3] == ("ok", ["chr7 12010 12090 g 5 + 12010 12090 0 1 80 0"], None)
    assert run(spark, bed.convert, ["chr9 1110 1285 g 5 + 1120 1280 0 2 20,30 0,100"], minus)[0][0] == "unmapped"


def test_region(spark, plus):
    got = run(spark, region.convert, ["chr7 5000 5430 a", "chr7 5000 5250 a 0 -", "chr7 4900 5120 x", "chr5 1 5", "chr7 5 5", "chr7 9 5", "chr7 b 5"], plus, "at", 0.85)
    assert got == [
        ("LowRatio", [], "chr7 5000 5430 a Fail map_ratio=0.7907"), ("LowRatio", [], "chr7 5000 5250 a 0 - Fail map_ratio=0.8000"), ("ok", ["chr7 12000 12120 x map_ratio=1.0000"], None), ("Unmap", [], "chr5 1 5 Fail Unmap"),
        ("InvalidFormat", [], "chr7 5 5 Fail InvalidFormat"), ("InvalidFormat", [], "chr7 9 5 Fail InvalidFormat"), ("InvalidFormat", [], "chr7 b 5 Fail InvalidFormat"),
    ]
    assert run(spark, region.convert, ["chr7 5000 5250 a 0 -"], plus, "at", 0.75) == [("ok", ["chr7 12000 12245 a 0 - map_ratio=0.8000"], None)]
    two = Lifter(chain.load(chain.lines_of(spark, "chain 1 a 100 + 0 40 b 100 + 0 40 1\n40\n\nchain 1 a 100 + 50 90 c 100 + 0 40 2\n40\n")).blocks)
    assert run(spark, region.convert, ["a 0 100"], two)[0][0] == "CrossChroms"


def test_gff(spark, plus):
    texts = ["##gff", "chr7 s exon 5001 5120 . + . ID=1 extra", "chr7 s exon 4951 5050 . + . ID=2", "chr7 s exon 5001 5120 . ? . x", "chr7 s exon 5121 5150 . . . x", "chr7 s exon 5001 5120 . . 0 y", "chr7 s exon 5001"]
    assert [(s, o) for s, o, _ in run(spark, gff.convert, texts, plus)] == [
        ("ok", ["chr7 s exon 12001 12120 . + . ID=1"]), ("resized", []), ("parse_error", []), ("unmapped", []), ("ok", ["chr7 s exon 12001 12120 . + 0 y"]), ("parse_error", []),
    ]


def reference(spark, text):
    return fasta.from_lines(text_lines.from_rows(spark, text.split("\n")), chunk=16)


def test_fasta(spark):
    chunks = fasta.from_lines(text_lines.from_rows(spark, [">a one", "ACGTACGTAC", "  GGGG  ", "", ">chrB", "TT", ">a", "ccccccccccccccccccccccTG", ">empty"]), chunk=16).cache()
    assert {(r.name, r.length) for r in fasta.lengths(chunks).collect()} == {("a", 24), ("chrB", 2)}
    asks = spark.createDataFrame([(1, "a", 20, 30), (2, "B", 0, 1), (3, "chrB", 5, 9), (4, "zz", 0, 1), (5, None, 0, 1), (6, "a", 10, 20), (7, "chra", 22, 23)], "rid long, n string, s long, e long")
    got = fasta.with_bases(asks, chunks, "rid", "n", "s", "e", "bases", chunk=16).orderBy("rid").collect()
    assert [r.bases for r in got] == ["CCTG", "T", None, None, None, "CCCCCCCCCC", "T"]


def test_fasta_over_splits(spark):
    rows = [("f", 0, 0, ">x"), ("f", 0, 1, "AAAA"), ("f", 9, 2, "CCCC"), ("f", 9, 3, "GG"), ("f", 20, 4, "T"), ("f", 20, 5, ">y"), ("f", 20, 6, "AC"), ("f", 30, 7, "GT")]
    chunks = fasta.from_lines(spark.createDataFrame(rows, "file string, block long, at long, line string"), chunk=4)
    assert {(r.name, r.chunk_no, r.seq) for r in chunks.collect()} == {("x", 0, "AAAA"), ("x", 1, "CCCC"), ("x", 2, "GGT"), ("y", 0, "ACGT")}


def test_vcf(spark, plus, minus):
    texts = ["##x", "chr7 5011 r1 A G,A 30 PASS DP=1;END=9;CIEND=5 GT 0/1", "chr7 5121 . A G . . .", "chr7 y . A G . . .", "chr7 5011 . ACG <DEL>,AT . . DB"]
    assert run(spark, vcf.convert, texts, plus) == [
        ("ok", ["chr7 12011 r1 A G 30 PASS DP=1;END=12011;CIEND=12011 GT 0/1"], None), ("Unmap", [], "chr7 5121 . A G . . . Fail(Unmap)"), ("ParseError", [], "chr7 y . A G . . . Fail(ParseError)"),
        ("ok", ["chr7 12011 . ACG <DEL>,AT . . DB"], None),
    ]
    assert run(spark, vcf.convert, ["chr9 1121 . A G,ACC . . ."], minus) == [("ok", ["chr9 7080 . A C,AGG . . ."], None)]
    bases = reference(spark, ">chr7\n" + "ACGTTGCA" * 1540)
    got = run(spark, vcf.convert, ["chr7 5011 . ACG G,AT,C . . .", "chr7 5301 . A G . . ."], plus, fasta_chunked(bases))
    assert got == [("ok", ["chr7 12011 . G GT . . ."], None), ("KeyError", [], "chr7 5301 . A G . . . Fail(KeyError)")]


def fasta_chunked(chunks):
    """Chunks of the size that the conversions expect."""
    return chunks.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "seq"))), lambda x: x["seq"]), "").alias("seq")).select("name", F.lit(0).cast("bigint").alias("chunk_no"), "seq")


def test_multiple_hits(spark):
    two = Lifter(chain.load(chain.lines_of(spark, "chain 1 a 100 + 0 40 b 100 + 0 40 1\n40\n\nchain 1 a 100 + 0 40 c 100 + 0 40 2\n40\n")).blocks)
    assert run(spark, vcf.convert, ["a 5 . A G . . ."], two) == [("Multiple_hits", [], "a 5 . A G . . . Fail(Multiple_hits)")]
    assert run(spark, vcf.convert_gvcf, ["a 5 . A G . . ."], two) == [("Multiple", [], "a 5 . A G . . .")]


def test_gvcf(spark, plus, minus):
    texts = ["chr7 5011 . A <NON_REF> . . END=5040;DP=5 GT 0/0", "chr7 5011 . C T 30 PASS DP=9", "chr7 5011 . A G,T . . .", "chr7 5110 . A . . . END=5140", "chr7 5100 . A <*> . . END=5200"]
    assert run(spark, vcf.convert_gvcf, texts, plus) == [
        ("ok", ["chr7 12011 . A <NON_REF> . . END=12040;DP=5 GT 0/0"], None), ("ok", ["chr7 12011 . C T 30 PASS DP=9"], None), ("ok", ["chr7 12011 . A G,T . . ."], None), ("ok", ["chr7 12110 . A . . . END=12120"], None),
        ("Multiple", [], "chr7 5100 . A <*> . . END=5200"),
    ]
    assert run(spark, vcf.convert_gvcf, ["chr9 1121 . A AC . . .", "chr9 1121 . A T . . ."], minus) == [("ok", ["chr9 7080 . A GT . . ."], None), ("ok", ["chr9 7080 . A  . . ."], None)]


def test_vcf_headers():
    heads = ["##fileformat=VCFv4.2", "##contig=<ID=1>", "##other", "#CHROM x"]
    assert vcf.header_lines(heads, [("chr1", 10)], vcf.TO_BOTH) == (["##fileformat=VCFv4.2", "##other", "##contig=<ID=chr1,length=10>", vcf.PROGRAM, "#CHROM x"], ["##fileformat=VCFv4.2", "##contig=<ID=1>", "#CHROM x"])
    assert vcf.gvcf_contigs(heads, [("chr2", 5), ("chr1", 9)]) == [("1", 9), ("2", 5)]
    assert vcf.gvcf_contigs([], [("chr2", 5), ("x", 9)]) == [("chr2", 5)]


MAF_HEAD = "Hugo NCBI_Build Chromosome Start_Position End_Position Strand Reference_Allele Tumor"


def test_maf(spark, plus, minus):
    texts = ["#version", "early", MAF_HEAD, "G old chr7 5011 5012 + AC T", "G old chr7 5121 5121 + A T", "G old chr7 x 5 + A T", "short"]
    assert run(spark, maf.convert, texts, plus, "new") == [
        ("no_header", [], "early"), ("ok", ["G new chr7 12011 12012 + AC T"], None), ("unmapped", [], "G old chr7 5121 5121 + A T"), ("parse_error", [], "G old chr7 x 5 + A T"), ("parse_error", [], "short"),
    ]
    bases = fasta_chunked(reference(spark, ">chr9\n" + "ACGTTGCA" * 1000))
    assert run(spark, maf.convert, [MAF_HEAD, "G old chr9 1121 1123 + AAA T"], minus, "new", bases) == [("ok", ["G new chr9 7078 7080 + TGC T"], None)]


def points(spark, texts):
    got = wig_source.points(text_lines.from_rows(spark, texts)).orderBy("at").collect()
    return [(r.chrom, r.start, r.end, r.value) if r.error is None else r.error for r in got]


def test_wig_lines(spark):
    texts = [
        "track type=wiggle", "5", "fixedStep chrom=c start=100 step=100 span=50", "1", "2.5", "chrX 5 9 7.5", "x", "3", "fixedStep chrom=c", "4", "variableStep chrom=d span=10", "200 1", "bad 2", "7", "fixedStep chrom=e start=1", "9", "10",
    ]
    assert points(spark, texts) == [
        "data before declaration", ("c", 99, 149, 1.0), ("c", 199, 249, 2.5), ("chrX", 5, 9, 7.5), "invalid number", ("c", 299, 349, 3.0), "missing start", ("c", 399, 449, 4.0), ("d", 199, 209, 1.0), "invalid number", "too few fields",
        ("e", 0, 1, 9.0), ("e", 1, 2, 10.0),
    ]


def test_wig_over_splits(spark):
    rows = [("f", 0, 0, "fixedStep chrom=c start=11 step=10"), ("f", 0, 1, "1"), ("f", 8, 2, "2"), ("f", 8, 3, "3"), ("f", 16, 4, "4"), ("f", 16, 5, "variableStep chrom=d"), ("f", 24, 6, "5 1")]
    got = wig_source.points(spark.createDataFrame(rows, "file string, block long, at long, line string")).orderBy("at").collect()
    assert [(r.chrom, r.start, r.value) for r in got] == [("c", 10, 1.0), ("c", 20, 2.0), ("c", 30, 3.0), ("c", 40, 4.0), ("d", 4, 1.0)]


def test_wig_merge(spark):
    nan = float("nan")
    rows = [(0, "a", 0, 100, 1.0), (1, "a", 100, 200, 1.0), (2, "a", 200, 300, 1.0), (3, "b", 0, 150, 1.0), (4, "b", 100, 200, 1.0), (5, "a", 300, 400, 2.0), (6, "a", 500, 600, 2.0), (7, "c", 0, 5, nan), (8, "c", 5, 9, nan)]
    got = wig.merge(spark.createDataFrame(rows, "at long, chrom string, start long, end long, value double"))
    assert sorted((r.chrom, r.start, r.end, str(r.value)) for r in got.collect()) == [
        ("a", 0, 300, "1.0"), ("a", 300, 400, "2.0"), ("a", 500, 600, "2.0"), ("b", 0, 200, "1.0"), ("c", 0, 5, "nan"), ("c", 5, 9, "nan"),
    ]


SAM_READS = [
    "r1 0 chr9 1121 60 10M2S = 7 9 AACGTNacgtAC ABCDEFGHIJKL NM:i:1 OC:Z:x", "r2 16 chr9 1121 60 5M * 0 0 AACGT *", "r3 4 * 0 0 * * 0 0 AC FF XX:Z:q", "r4 0 chr5 5 3 2M * 0 0 AC FF", "r5 1 chr9 1121 9 2M * 0 0 * *",
]


def test_sam(spark, minus):
    reads = sam.parsed(text_lines.from_rows(spark, ["@HD\tVN:1.0"] + [r.replace(" ", "\t") for r in SAM_READS]))
    done = sam.convert(reads.withColumn("flag0", F.col("flag")), minus, target_names=["chr9"])
    got = [r.line.replace("\t", " ") for r in done.withColumn("line", sam.line(done)).orderBy("at").collect()]
    assert got == [
        "r1 16 chr9 7071 60 2S10M * 1 0 GTACGTNACGTT LKJIHGFEDCBA NM:i:1", "r2 0 chr9 7076 60 5M * 1 0 ACGTT *", "r3 4 * 1 255 * * 1 0 AC FF", "r4 4 * 1 255 * * 1 0 AC FF", "r5 17 chr9 7079 9 2M * 1 0 * *",
    ]
    assert {(r.status, r.paired, r.n) for r in sam.stats(done, "flag0").collect()} == {("mapped", False, 2), ("mapped", True, 1), ("unmapped", False, 1), ("failed", False, 1)}
    assert [r.status for r in sam.convert(reads, minus, target_names=[]).where("qname = 'r1'").collect()] == ["failed"]


def test_bam_round_trip(spark, tmp_path):
    head = ["@HD\tVN:1.0", "@SQ\tSN:chr1\tLN:1000", "@SQ\tSN:chr2\tLN:1000"]
    lines = [r.replace(" ", "\t") for r in ["r1 0 chr2 121 60 10M2S = 7 9 AACGTNACGTAC ABCDEFGHIJKL NM:i:1 XX:Z:abc XF:f:1.5 XA:A:c XB:B:s,1,-2", "r3 4 * 0 0 * * 0 0 AC FF"]]
    binary.write_bam(str(tmp_path / "a.bam"), head, lines * 3000)
    binary.register(spark)
    got = spark.read.format("bam").load(str(tmp_path / "a.bam"))
    assert got.count() == 6000
    assert [r.line for r in got.withColumn("line", sam.line(got)).orderBy("at").limit(2).collect()] == lines
    assert binary.bam_header(str(tmp_path / "a.bam")) == head
    with pytest.raises(ValueError):
        with gzip.open(tmp_path / "no.bam", "wb") as f:
            f.write(b"no")
        list(binary.read_bam(str(tmp_path / "no.bam")))


@pytest.mark.parametrize("split", [1, 700, 70_000, 1 << 30])
def test_bam_in_splits(spark, tmp_path, split):
    """Every record comes out once, in order, wherever the file is cut; long records cross several blocks and splits."""
    head = ["@SQ\tSN:chr1\tLN:100000", "@SQ\tSN:chr2\tLN:1000"]
    sizes = [5, 90, 151, 70_000, 3, 180_000] if split > 600 else [5, 40]
    lines = []
    for i in range(200 if split > 600 else 30):
        n = sizes[i % len(sizes)]
        fields = [f"r{i}", 16 * (i % 2), f"chr{1 + i % 2}", i % 900 + 1, 9, f"{n}M", "*", 0, 0, ("ACGTN" * n)[:n], "".join(chr(33 + (i * 7 + k) % 90) for k in range(n)), f"NM:i:{i}"]
        lines.append("\t".join(map(str, fields)))
    path = str(tmp_path / "a.bam")
    binary.write_bam(path, head, lines)
    bam = binary.BamFile(path)
    step = max(split, 37)
    got = [r for a in range(0, bam.length, step) for r in binary.BamFile(path).records(a, min(a + step, bam.length))] if split > 600 or bam.length < 40_000 else []
    assert [r[0] for r in got] == [x.split("\t")[0] for x in lines]
    assert [r[9] for r in got] == [x.split("\t")[9] for x in lines] and [r[10] for r in got] == [x.split("\t")[10] for x in lines]
    assert [r[-1] for r in got] == sorted({r[-1] for r in got})
    if split == 70_000:
        binary.register(spark)
        read = spark.read.format("bam").option("splitBytes", bam.length // 8).load(path)
        assert read.rdd.getNumPartitions() > 5
        assert [r.line for r in read.withColumn("line", sam.line(read)).orderBy("at").collect()] == lines


def test_bigwig_index_of_several_levels():
    blocks = [(k // 1000, k % 1000 * 10, k % 1000 * 10 + 9, 10_000 + k, 5) for k in range(5000)]
    import io

    reader = object.__new__(binary.BigWig)
    reader.file, reader.order, reader.index_at, reader.packed = io.BytesIO(binary._index(blocks, 0, fan=4)), "<", 0, 0
    seen = []
    reader._block = lambda where, size, chrom: iter([(where, size, chrom)])
    for c in range(5):
        seen += [w for w, _, _ in reader.intervals(c)]
    assert seen == [b[3] for b in blocks]


def test_bigwig_round_trip(spark, tmp_path):
    rows = [(c, s, s + 5, float(s % 7)) for c in ("chr1", "chr2") for s in range(0, 30_000, 10)]
    binary.write_bigwig(str(tmp_path / "a.bw"), [("chr2", 40_000), ("chr1", 50_000)], rows)
    binary.register(spark)
    got = spark.read.format("bigwig").load(str(tmp_path / "a.bw")).orderBy("at").collect()
    assert [(r.chrom, r.start, r.end, r.value) for r in got] == rows
    assert binary.BigWig(str(tmp_path / "a.bw")).chroms() == [("chr1", 0, 50_000), ("chr2", 1, 40_000)]


def test_files(spark, tmp_path):
    path = lambda n: str(tmp_path / n)
    with gzip.open(path("a.chain.gz"), "wt") as f:
        f.write(PLUS)
    (tmp_path / "in.bed").write_text("# h\nchr7\t5020\t5080\tx\r\nchr7\t0\t5\nchr7\t5100\t5200\n")
    assert files.convert_bed(spark, path("a.chain.gz"), path("in.bed"), path("out.bed")) == {"total": 3, "success": 2, "failed": 1, "multi": 1}
    assert (tmp_path / "out.bed").read_text() == "# h\nchr7\t12020\t12080\tx\nchr7\t12100\t12120\nchr7\t12165\t12215\n"
    assert (tmp_path / "out.bed.unmap").read_text() == "chr7\t0\t5\n"
    assert files.convert_bed(spark, path("a.chain.gz"), path("in.bed"), path("folder"), single=False)["total"] == 3
    assert spark.read.text(path("folder/side=mapped")).count() == 3
    (tmp_path / "in.vcf").write_text("##fileformat=x\n#CHROM\tPOS\nchr7\t5011\t.\tA\tG\t.\t.\t.\nchr7\t1\t.\tA\tG\t.\t.\t.\n")
    (tmp_path / "r.fa").write_text(">chr7\n" + "ACGT" * 3100 + "\n")
    assert files.convert_vcf(spark, path("a.chain.gz"), path("in.vcf"), path("r.fa"), path("out.vcf"))["success"] == 1
    assert (tmp_path / "out.vcf").read_text() == f"##fileformat=x\n##contig=<ID=chr7,length=12400>\n{vcf.PROGRAM}\n#CHROM\tPOS\nchr7\t12011\t.\tG\t\t.\t.\t.\n"
    assert (tmp_path / "out.vcf.unmap").read_text().splitlines()[-1].endswith("Fail(Unmap)")
    (tmp_path / "in.wig").write_text("fixedStep chrom=chr7 start=5001 step=10 span=10\n1\n1\n2\nx\nvariableStep chrom=chr7\n1 5\n")
    assert files.convert_wig(spark, path("a.chain.gz"), path("in.wig"), path("w")) == {"total": 4, "success": 3, "failed": 2, "merged": 1}
    assert (tmp_path / "w.wig").read_text() == "variableStep chrom=chr7 span=20\n12001\t1\n12021\t2\n"
    assert (tmp_path / "w.unmap.wig").read_text() == "variableStep chrom=chr7\n1\t5\n"
    binary.write_bigwig(path("in.bw"), [("chr7", 6000)], [("chr7", 5000, 5010, 1.0), ("chr7", 5010, 5020, 1.0), ("chr7", 5125, 5135, 2.0)])
    assert files.convert_bigwig(spark, path("a.chain.gz"), path("in.bw"), path("out.bw")) == {"total": 3, "success": 2, "failed": 1, "merged": 1}
    assert (tmp_path / "out.bw.unmap.bedGraph").read_text() == "chr7\t5125\t5135\t2\n"
    assert list(binary.BigWig(path("out.bw")).intervals(0)) == [(12000, 12020, 1.0)]
    (tmp_path / "in.sam").write_text("@HD\tVN:1.0\n@PG\tID:x\tjunk\n" + "r1\t0\tchr7\t5021\t60\t5M\t*\t0\t0\tAACGT\tABCDE\n")
    want = {"total": 1, "mapped": 1, "failed": 0, "unmapped": 0, "paired": 0, "single": 1}
    assert files.convert_alignments(spark, path("a.chain.gz"), path("in.sam"), path("out.bam")) == want
    (tmp_path / "back.chain").write_text(BACK)
    assert files.convert_alignments(spark, path("back.chain"), path("out.bam"), path("back.sam")) == want
    assert (tmp_path / "back.sam").read_text().splitlines()[-2:] == ["@PG\tID:x", "r1\t0\tchr7\t5021\t60\t5M\t*\t1\t0\tAACGT\tABCDE"]
    with pytest.raises(ValueError):
        files.convert_alignments(spark, path("a.chain.gz"), path("a.cram"), path("b.sam"))


def test_parts_out_of_sight_fail(spark, tmp_path, monkeypatch):
    """Where the tasks' disks are not the driver's, nothing is written and nothing is lost silently."""
    (tmp_path / "a.chain").write_text(PLUS)
    (tmp_path / "in.bed").write_text("chr7\t5020\t5080\n" * 50)
    monkeypatch.setattr(sink.Target, "parts", lambda self, folder: [])
    with pytest.raises(OSError, match="share"):
        files.convert_bed(spark, str(tmp_path / "a.chain"), str(tmp_path / "in.bed"), str(tmp_path / "out.bed"))
    assert not (tmp_path / "out.bed").exists() and not list(tmp_path.glob("*parts*"))


def test_contigs_come_in_file_order(spark):
    rows = text_lines.from_rows(spark, [">b", "AC", ">a x", "ACG", ">c", "T", ">b", "AAAA"])
    got = fasta.in_file_order(rows, fasta.from_lines(rows)).orderBy(*text_lines.ORDER).collect()
    assert [(r["name"], r["length"]) for r in got] == [("a", 3), ("c", 1), ("b", 4)]


def test_command_line(spark, tmp_path):
    (tmp_path / "a.chain").write_text(PLUS)
    (tmp_path / "in.bed").write_text("chr7\t5000\t5250\n")
    a, i, o = (str(tmp_path / n) for n in ("a.chain", "in.bed", "out.bed"))
    assert cli.main(["region", a, i, o, "-r", "0.75"])["success"] == 1
    assert (tmp_path / "out.bed").read_text() == "chr7\t12000\t12245\tmap_ratio=0.8000\n"
    assert cli.main(["--compat-mode", "strict", "bed", a, i, o, "--chromid", "s"])["multi"] == 1
    assert (tmp_path / "out.bed").read_text() == "7\t12000\t12120\n7\t12165\t12245\n"
    for line in (["gff", a, i], ["vcf", a, i, "r"], ["gvcf", a, i, "r"], ["maf", a, i, "r", "-b", "x"], ["wig", a, i], ["bigwig", a, i], ["bam", a, i, o]):
        assert cli.parser().parse_args(line).command == line[0]
