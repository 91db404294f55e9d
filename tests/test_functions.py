import random

import pytest
from pyspark.sql import functions as F

from anchorspan.functions import chrom, cigar, dna, numbers, variants


def each(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_dna(spark):
    assert each(spark, ["AACGT", "ATGC", "", None, "acgRYN", "SWU-"], dna.revcomp) == ["ACGTT", "GCAT", "", None, "NRYcgt", "-UWS"]
    seen = ["".join(random.Random(i).choices("ACGTRYSWKMBVDHNacgtryswkmbvdhn", k=20)) for i in range(20)]
    assert each(spark, seen, lambda c: dna.revcomp(dna.revcomp(c))) == seen
    assert each(spark, ["", "ACGN", "A,C", "<DEL>", "U", "AC\n"], dna.is_dna) == [True, True, False, False, False, False]
    assert each(spark, ["acgtR", "*"], dna.read_revcomp) == ["NACGT", "N"]


def test_chromosome_names(spark):
    names = ["chr1", "CHR1", "1", "M", "chrM", "MT", "chr", " chr7 ", "chrUn_1", None, ""]
    assert each(spark, names, chrom.chrom_key) == ["1", "1", "1", "MT", "MT", "MT", "CHR", "7", "UN_1", None, ""]
    assert each(spark, names[:5], chrom.alias_key) == ["1", "1", "1", "m", "m"]
    assert each(spark, ["Chr1", "1", "chr"], lambda c: chrom.apply_style(c, "l")) == ["chr1", "chr1", "chrchr"]
    assert each(spark, ["Chr1", "1", "chr"], lambda c: chrom.apply_style(c, "s")) == ["1", "1", "chr"]
    assert each(spark, ["chr1", "1"], lambda c: chrom.follow_habit(F.lit("chr5"), c)) == ["chr5", "5"]
    assert [chrom.parse_style(x) for x in ("A", "as-is", "short", "L")] == ["a", "a", "s", "l"]
    with pytest.raises(ValueError):
        chrom.parse_style("x")
    with pytest.raises(ValueError):
        chrom.apply_style(F.lit("x"), "q")


def test_numbers(spark):
    texts = ["5", "+5", " 5", "-5", "", "5.0", None, "007", "9223372036854775807", "9223372036854775808", "5\n"]
    assert each(spark, texts, numbers.unsigned) == [5, 5, None, None, None, None, None, 7, 2**63 - 1, None, None]
    assert each(spark, ["1", "-1.5e3", ".5", "1.", "x", "", None], numbers.real) == [1.0, -1500.0, 0.5, 1.0, None, None, None]
    assert str(each(spark, ["NaN"], numbers.real)[0]) == "nan"
    assert each(spark, [1.0, 0.1, 1e22, 1e-7, -2.5, None, float("inf")], numbers.plain_double, "double") == ["1", "0.1", "1" + "0" * 22, "0.0000001", "-2.5", None, "inf"]


def test_cigar_lengths(spark):
    texts = ["10M2I3D5M", "5S10=2X3N4H6P", "*", "", None]
    assert each(spark, texts, cigar.reference_length) == [18, 15, 0, 0, None]
    assert each(spark, texts, cigar.query_length) == [17, 17, 0, 0, None]
    assert each(spark, ["10M2I3D", "*"], cigar.reverse) == ["3D2I10M", ""]
    assert each(spark, ["5M5M3I3I2P2P1M", "1M"], cigar.merge_adjacent) == ["10M6I2P2P1M", "1M"]
    assert each(spark, ["10M2I", "10M3I"], lambda c: cigar.is_valid(c, F.lit(12))) == [True, False]


def test_cigar_break():
    assert cigar.break_cigar("10M", 4) == ("4M6S", "4S6M")
    assert cigar.break_cigar("5M2I10M", 5) == ("5M2I10S", "7S10M")
    assert cigar.break_cigar("10M", 10) == ("10M", "")
    assert cigar.break_cigar("5M4D5M", 7) == ("5M2D", "7S2D5M")


def test_info(spark):
    infos = ["DP=5;DB;AF=0.1,0.2", ".", "DB", "DP=1;DP=2", "", None]
    assert each(spark, infos, variants.info_map) == [{"DP": "5", "DB": "", "AF": "0.1,0.2"}, {}, {"DB": ""}, {"DP": "2"}, {}, None]
    assert each(spark, infos, lambda c: variants.info_value(c, "DP")) == ["5", None, None, "2", None, None]
    end = F.lit(200)
    assert each(spark, ["END=100;DP=50", "CIEND=5,9;END=", "DP=1"], lambda c: variants.replace_end(c, end)) == ["END=200;DP=50", "CIEND=200,9;END=200", "DP=1"]
    assert each(spark, ["END=100;DP=50", "DP=50", "CIEND=1"], lambda c: variants.set_end(c, end)) == ["END=200;DP=50", "DP=50;END=200", "CIEND=1;END=200"]
    assert each(spark, ["END=100", "END=x", "DP=1"], variants.end_position) == [100, None, None]


def test_alleles(spark):
    assert each(spark, ["A", "AT", "A,AAA", "<DEL>"], lambda c: variants.variant_type(F.lit("C"), c)) == ["Substitution", "Insertion", "Substitution", "Insertion"]
    turned = lambda ref, new, minus: lambda c: variants.rewritten_alts(c, F.lit(ref), F.lit(new), F.lit(minus))
    assert each(spark, ["G", "A,G", "<DEL>", "ACC", "*", "A"], turned("A", "A", False)) == ["G", "G", "<DEL>", "ACC", "*", ""]
    assert each(spark, ["G", "ACC", "A]chr2:5]"], turned("A", "T", True)) == ["C", "TGG", "A]chr2:5]"]
