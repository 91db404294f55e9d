import bz2
import gzip

import pytest

from anchorspan.sources import chain
from tests.chains import BOTH_MINUS, MINUS, PLUS


def rows(spark, text):
    got = chain.load(chain.lines_of(spark, text)).blocks.orderBy("block_id").collect()
    return [(r.source_chrom, r.source_start, r.source_end, r.target_chrom, r.target_start, r.target_end, r.target_strand) for r in got]


def test_blocks_of_two_chains(spark):
    assert rows(spark, PLUS) == [
        ("chr7", 5000, 5120, "chr7", 12000, 12120, "+"), ("chr7", 5150, 5230, "chr7", 12165, 12245, "+"), ("chr7", 5290, 5430, "chr7", 12320, 12460, "+"),
        ("chr9", 300, 335, "chr9", 610, 645, "+"), ("chr9", 350, 390, "chr9", 655, 695, "+"),
    ]


def test_minus_sides_are_turned(spark):
    assert rows(spark, MINUS) == [("chr9", 1100, 1170, "chr9", 7030, 7100, "-"), ("chr9", 1195, 1290, "chr9", 6915, 7010, "-")]
    assert rows(spark, BOTH_MINUS) == [("scafQ", 500, 560, "scafR", 825, 885, "-"), ("scafQ", 410, 480, "scafR", 730, 800, "-")]


def test_blank_and_comment_lines_end_a_chain(spark):
    text = "# before\nchain 1 a 100 + 0 50 b 100 + 0 50 1\n10 5 5\n# inside\n20\n\n7\n"
    assert rows(spark, text) == [("a", 0, 10, "b", 0, 10, "+")]
    assert rows(spark, "") == []


def test_sizes_take_the_last_header(spark):
    text = "chain 1 a 100 + 0 50 b 100 + 0 50 1\n50\n\nchain 1 a 200 + 0 50 b 300 + 0 50\n50\n"
    loaded = chain.load(chain.lines_of(spark, text))
    assert {(r.side, r.chrom, r.size) for r in loaded.sizes.collect()} == {("source", "a", 200), ("target", "b", 300)}
    assert sorted(r.chain_id for r in loaded.headers.collect()) == ["", "1"]


@pytest.mark.parametrize(
    ("line", "number", "kind"),
    [
        ("chain 1 a 100 x 0 50 b 100 + 0 50 1", 1, "InvalidStrand"), ("chain one a 100 + 0 50 b 100 + 0 50 1", 1, "InvalidNumber"), ("chain 1 a 100 + 60 50 b 100 + 0 50 1", 1, "InvalidCoordinates"),
        ("chain 1 a 100 + 0 500 b 100 + 0 50 1", 1, "InvalidCoordinates"), ("chain 1 a 100 +", 1, "InvalidHeader"), ("chainx 1 a 100 + 0 50 b 100 + 0 50 1", 1, "InvalidHeader"),
        ("chain 1 a 100 + 0 50 b 100 + 0 50 1\n10 5", 2, "InvalidDataLine"), ("chain 1 a 100 + 0 50 b 100 + 0 50 1\n0", 2, "InvalidDataLine"), ("chain 1 a 100 + 0 50 b 100 + 0 50 1\n10 -5 5", 2, "InvalidNumber"),
    ],
)
def test_faults(spark, line, number, kind):
    with pytest.raises(chain.ChainError) as e:
        chain.load(chain.lines_of(spark, line + "\n"))
    assert (e.value.line_number, e.value.kind) == (number, kind)
    assert str(e.value).startswith(f"Line {number}: ")
    assert rows_lenient(spark, line) == 0


def rows_lenient(spark, line):
    return chain.load(chain.lines_of(spark, line), strict=False).blocks.count()


@pytest.mark.parametrize("name", ["a.chain", "a.chain.gz", "a.chain.bz2", "gz_without_suffix", "bz_without_suffix"])
def test_compressed_files(spark, tmp_path, name):
    data = PLUS.encode()
    path = tmp_path / name
    path.write_bytes(gzip.compress(data) if "gz" in name else bz2.compress(data) if "bz" in name else data)
    assert chain.detect_compression(str(path)) == ("gzip" if "gz" in name else "bzip2" if "bz" in name else "plain")
    assert chain.load(chain.read_lines(spark, str(path))).blocks.count() == 5
