import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from anchorspan.operators.intervals import interval_join
from anchorspan.operators import lift
from anchorspan.operators.lift import BlockIndex, Lifter, Resolver
from anchorspan.sources import chain
from tests.chains import BOTH_MINUS, MINUS, PLUS

SCHEMA = "rid long, chrom string, start long, end long, strand string"


def lifted(spark, text, queries, style="a", max_sent=500_000, width=64):
    lifter = Lifter(chain.load(chain.lines_of(spark, text)).blocks, style, max_sent=max_sent, width=width)
    df = spark.createDataFrame([(i, *q) for i, q in enumerate(queries)], SCHEMA)
    got = lifter.with_segments(df, "rid", F.col("chrom"), F.col("start"), F.col("end"), F.col("strand")).orderBy("rid").collect()
    return [None if r.segments is None else [tuple(g)[1:] for g in r.segments] for r in got]


PROBES = [
    (("chr7", 5020, 5080, "+"), [(5020, 5080, "chr7", 12020, 12080, "+")]), (("chr7", 5020, 5080, "-"), [(5020, 5080, "chr7", 12020, 12080, "-")]), (("chr7", 4950, 5050, "+"), [(5000, 5050, "chr7", 12000, 12050, "+")]),
    (("chr7", 0, 50, "+"), []), (("chrNONE", 0, 50, "+"), None), (("7", 5160, 5170, "+"), [(5160, 5170, "7", 12175, 12185, "+")]), (("CHR7", 5160, 5170, "+"), [(5160, 5170, "chr7", 12175, 12185, "+")]),
    (("Chr7", 5160, 5170, "+"), [(5160, 5170, "chr7", 12175, 12185, "+")]), (("chr7", 5100, 5200, "+"), [(5100, 5120, "chr7", 12100, 12120, "+"), (5150, 5200, "chr7", 12165, 12215, "+")]), (("chr7", 5125, 5145, "+"), []),
    (("chr7", 5120, 5150, "+"), []), (("chr7", 5160, 5160, "+"), [(5160, 5160, "chr7", 12175, 12175, "+")]), ((None, 1, 5, "+"), None), (("chr7", None, 5, "+"), []), (("chr7", 5080, 5020, "+"), []),
    (("chr7", 5020, 5080, None), [(5020, 5080, "chr7", 12020, 12080, "+")]), (("chr7", -5, 5001, "+"), [(5000, 5001, "chr7", 12000, 12001, "+")]), (("", 1, 5, "+"), None),
]


@pytest.mark.parametrize("max_sent", [500_000, 0])
def test_probes_in_both_forms(spark, max_sent):
    assert lifted(spark, PLUS, [q for q, _ in PROBES], max_sent=max_sent) == [w for _, w in PROBES]


def test_minus_target_measures_from_its_end(spark):
    assert lifted(spark, MINUS, [("chr9", 1120, 1150, "+"), ("chr9", 1120, 1150, "-")]) == [[(1120, 1150, "chr9", 7050, 7080, "-")], [(1120, 1150, "chr9", 7050, 7080, "+")]]


@pytest.mark.parametrize(("style", "name"), [("s", "7"), ("l", "chr7"), ("a", "chr7")])
def test_styles(spark, style, name):
    assert lifted(spark, PLUS, [("chr7", 5020, 5080, "+")], style)[0][0][2] == name


def test_no_records_and_no_blocks(spark):
    assert lifted(spark, PLUS, []) == []
    assert lifted(spark, "", [("chr1", 1, 5, "+")]) == [None]
    assert lifted(spark, "", [("chr1", 1, 5, "+")], max_sent=-1) == [None]


def test_resolver_prefers_exact_then_alias():
    r = Resolver(["1", "chr1", "chrX", "ctgchr5"])
    assert [r(x) for x in ("1", "chr1", "CHR1", "x", "X", "chrM", None, "chrctgchr5")] == ["1", "chr1", "1", "chrX", "chrX", None, None, "ctgchr5"]


def brute(blocks, chrom, start, end, strand):
    out = []
    for sc, s, e, tc, ts, te, td in blocks:
        if sc == chrom and s < end and e > start and start <= end:
            a, b = max(s, start), min(e, end)
            t = te - (a - s) - (b - a) if td == "-" else ts + a - s
            out.append(((s, e), (a, b, tc, t, t + b - a, "+" if (strand == "-") == (td == "-") else "-")))
    return [x for _, x in sorted(out, key=lambda x: x[0])]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_against_brute_force(spark, seed):
    rng = random.Random(seed)
    text = ""
    for i in range(12):
        sizes = [(rng.randint(1, 90), rng.randint(0, 40), rng.randint(0, 40)) for _ in range(rng.randint(1, 6))]
        a, b = sum(x[0] + x[1] for x in sizes), sum(x[0] + x[2] for x in sizes)
        s, t = rng.randint(0, 400), rng.randint(0, 400)
        text += f"chain 1 chr{rng.randint(1, 2)} 2000 {rng.choice('+-')} {s} {s + a} chr{rng.randint(1, 3)} 2000 {rng.choice('+-')} {t} {t + b} {i}\n"
        text += "".join(f"{x} {y} {z}\n" for x, y, z in sizes[:-1]) + f"{sizes[-1][0]}\n\n"
    blocks = [tuple(r)[1:] for r in chain.load(chain.lines_of(spark, text)).blocks.orderBy("block_id").collect()]
    queries = []
    for _ in range(150):
        s = rng.randint(0, 1990)
        queries.append((f"chr{rng.randint(1, 2)}", s, s + rng.choice([0, 1, 7, 60, 500]), rng.choice("+-")))
    want = [brute(blocks, *q) for q in queries]
    assert lifted(spark, text, queries) == want
    assert lifted(spark, text, queries, max_sent=0) == want
    assert all(b - a == y - x for r in want for a, b, _, x, y, _ in r)


def test_both_minus(spark):
    assert lifted(spark, BOTH_MINUS, [("scafQ", 510, 520, "+")]) == [[(510, 520, "scafR", 865, 875, "-")]]


def test_interval_join_against_brute_force(spark):
    rng = random.Random(5)
    a = [(i, rng.choice("xy"), s, s + rng.choice([0, 1, 30, 500])) for i in range(120) for s in [rng.randint(0, 900)]]
    b = [(i, rng.choice("xy"), s, s + rng.choice([1, 10, 300])) for i in range(90) for s in [rng.randint(0, 900)]]
    left = spark.createDataFrame(a + [(900, None, 1, 5), (901, "x", None, 5), (902, "x", 50, 10)], "i long, k string, s long, e long")
    right = spark.createDataFrame(b + [(900, None, 1, 5)], "j long, k2 string, s2 long, e2 long")
    want = sorted((i, j) for i, k, s, e in a for j, k2, s2, e2 in b if k == k2 and s2 < e and e2 > s)
    for small in (None, False):
        got = interval_join(left, right, ["k", "s", "e"], ["k2", "s2", "e2"], width=64, small_right=small)
        assert sorted((r.i, r.j) for r in got.collect()) == want


def index(start, end, chroms=None):
    n = len(start)
    return BlockIndex(pa.table({"block_id": np.arange(n), "source_chrom": ["c"] * n if chroms is None else chroms, "source_start": start, "source_end": end, "target_chrom": ["t"] * n, "target_start": start, "target_end": end, "target_strand": ["+"] * n}))


@pytest.mark.parametrize("few", [0, 4, 32])
def test_nested_blocks_against_brute_force(monkeypatch, few):
    monkeypatch.setattr(lift, "FEW", few)
    rng = np.random.default_rng(few)
    for _ in range(60):
        n, q = int(rng.integers(1, 200)), int(rng.integers(1, 30))
        start = rng.integers(0, 500, n)
        blocks = index(start, start + rng.choice([1, 5, 50, 500], n), rng.choice(list("ab"), n))
        names, s = list(rng.choice(list("abz"), q)), rng.integers(-5, 510, q)
        e = s + rng.choice([-3, 0, 1, 20, 600], q)
        known, query, block = blocks.overlaps(names, s, e)
        of = {j: k for k, (a, b) in blocks.span.items() for j in range(a, b)}
        want = [(i, j) for i in range(q) for j in range(n) if of[j] == names[i] and s[i] <= e[i] and blocks.start[j] < e[i] and blocks.end[j] > s[i]]
        assert list(zip(query.tolist(), block.tolist(), strict=True)) == want
        assert known.tolist() == [x in blocks.span for x in names]


def test_a_block_over_all_others_costs_no_memory():
    import tracemalloc

    start = np.append(np.arange(500_000) * 500, 0)
    blocks = index(start, np.append(start[:-1] + 300, 250_000_000))
    s = np.random.default_rng(3).integers(0, 250_000_000 - 200, 10_000)
    tracemalloc.start()
    _, query, block = blocks.overlaps(["c"] * len(s), s, s + 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    assert len(query) == 10_000 + (((s % 500) < 300) | ((s % 500) > 300)).sum()
    assert ((blocks.start[block] < s[query] + 200) & (blocks.end[block] > s[query])).all()
