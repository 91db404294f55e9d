import itertools
import math
import os
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from anchorspan.operators import keystats, lineparse, packed, runs, tablediff
from anchorspan.queries import problems
from tests import brute

NAN = float("nan")


def test_key_counts_percentiles_and_hot_keys(spark):
    rng = random.Random(3)
    rows = [("t", "hot", rng.randint(-5, 40)) for _ in range(400)] + [("t", k, rng.choice([None, 7, 2**40, -(2**40)])) for k in "abc" for _ in range(9)] + [("t", None, 1), (None, "x", 1), ("u", "only_null", None)] * 2
    df = spark.createDataFrame(rows, "tab string, k string, v long").withColumn("value", F.lit("clash")).withColumn("freq", F.lit(0))
    compressed = keystats.compress(df, {"tab": F.col("tab"), "key": F.col("k")}, F.col("v"))
    got = {(r.tab, r.key): r for r in keystats.key_counts(compressed, ["tab", "key"]).collect()}
    at = {(r.tab, r.key, r.p): r.percentile for r in keystats.percentiles(compressed, ["tab", "key"], [0.0, 0.25, 0.5, 1.0]).collect()}
    groups = {}
    for t, k, v in rows:
        if t is not None and k is not None:
            groups.setdefault((t, k), []).append(v)
    assert set(got) == set(groups)
    for key, vs in groups.items():
        real = sorted(v for v in vs if v is not None)
        r = got[key]
        assert (r.n_rows, r.n_values, r.n_distinct) == (len(vs), len(real), len(set(real)))
        top = min(((-real.count(v), v) for v in set(real)), default=(None, None))
        assert (r.mode, r.mode_freq) == (top[1], None if top[0] is None else -top[0])
        for p in (0.0, 0.25, 0.5, 1.0):
            assert at.get((*key, p)) == (real[max(1, math.ceil(p * len(real))) - 1] if real else None)
    exact = spark.createDataFrame([("t", str(k), 7 if k == 0 else 1) for k in range(134)], "tab string, key string, n_rows long")
    assert [r.key for r in keystats.hot_keys(exact, ["tab"], 0.05).collect()] == ["0"]  # 7 of 140
    hot = keystats.hot_keys(keystats.key_counts(compressed, ["tab", "key"]), ["tab"], 0.05).collect()
    assert {(r.tab, r.key) for r in hot} == {("t", "hot"), ("u", "only_null")}


def test_percentiles_of_doubles(spark):
    values = [0.5, -1.25, 3.75, 3.75, 1e300, -1e300, 0.0, NAN]
    compressed = keystats.compress(spark.createDataFrame([("a", v) for v in values], "k string, v double"), {"k": F.col("k")}, F.col("v"))
    got = {r.p: r.percentile for r in keystats.percentiles(compressed, ["k"], [0.125, 0.5, 0.75, 0.875]).collect()}
    assert got == {0.125: -1e300, 0.5: 0.5, 0.75: 3.75, 0.875: 1e300}


def test_percentiles_where_values_crowd(spark):
    """A narrow range far from zero, a huge outlier, tiny and equal values: every bucket stays small and the rank is exact."""
    rng = random.Random(6)
    sets = {
        "times": [1_700_000_000_000_000 + rng.randint(0, 10**12) for _ in range(300)], "outlier": [rng.randint(1, 1000) for _ in range(200)] + [2**62, -(2**62)], "wide": [rng.choice([-1, 1]) * rng.randint(0, 2 ** rng.randint(0, 62)) for _ in range(300)],
        "near": [2**62 + rng.randint(0, 5000) for _ in range(200)], "one": [7] * 50,
    }
    compressed = keystats.compress(spark.createDataFrame([(k, v) for k, vs in sets.items() for v in vs], "k string, v long"), {"k": F.col("k")}, F.col("v"))
    ps = [0.0, 0.01, 0.3, 0.5, 0.9, 1.0]
    got = {(r.k, r.p): r.percentile for r in keystats.percentiles(compressed, ["k"], ps).collect()}
    assert got == {(k, p): sorted(vs)[max(1, math.ceil(p * len(vs))) - 1] for k, vs in sets.items() for p in ps}
    buckets = compressed.withColumn("b", keystats.bucket_of(F.col("value"))).collect()
    for k in ("times", "outlier", "wide"):
        seen = [r.b for r in sorted((r for r in buckets if r.k == k), key=lambda r: r.value)]
        assert seen == sorted(seen) and len(set(seen)) > 0.5 * min(len(seen), 190)
    doubles = [0.0, -0.0, 5e-324, 1e-300, 1e-20, 1.0, 1.0 + 1e-9, 1e300, math.inf, -math.inf, NAN, -1e-300, 1.7e308]
    placed = {repr(r.v): r.b for r in spark.createDataFrame([(v,) for v in doubles], "v double").withColumn("b", keystats.bucket_of(F.col("v"))).collect()}
    order = sorted((v for v in doubles if v == v), key=lambda v: v)
    assert [placed[repr(v)] for v in order] == sorted(placed[repr(v)] for v in order) and placed["nan"] > placed["inf"] > placed["1.7e+308"] > placed["1e+300"]


def test_plan_of_the_chromosome_statistics(spark):
    """Three scans and ten exchanges at most, and no task with all rows of a chromosome."""
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    plan = problems.p1_chrom_stats(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 5 and len(re.findall(r"(?<!Reused)(?<!Broadcast)Exchange ", plan)) <= 11


@pytest.mark.parametrize("width", [4, 1 << 16])
def test_covered_bases(spark, width):
    rng = random.Random(9)
    rows = [("a", s, s + rng.randint(-1, 30)) for _ in range(150) for s in [rng.randint(-20, 900)]] + [("a", 5, 9)] * 50 + [("b", 0, 0), ("c", 3, 1000), (None, 1, 2), ("a", None, 5)]
    got = keystats.covered_bases(spark.createDataFrame(rows, "k string, s long, e long"), {"k": F.col("k")}, F.col("s"), F.col("e"), width)
    want = {k: brute.covered([(s, e) for x, s, e in rows if x == k and s is not None]) for k in "ac"}
    assert {r.k: r.covered for r in got.collect()} == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k string, v long, s long, e long, id long, x double, t string, line_id long, file_kind string, file_name string, line_no long, raw_line string")
    compressed = keystats.compress(none, {"k": F.col("k")}, F.col("v"))
    assert keystats.key_counts(compressed, ["k"]).count() == keystats.percentiles(compressed, ["k"], [0.5]).count() == 0
    assert keystats.covered_bases(none, {"k": F.col("k")}, F.col("s"), F.col("e")).count() == 0
    assert runs.collapse_runs(none, {"k": F.col("k")}, F.col("id"), F.col("s"), F.col("e"), F.col("x")).count() == 0
    assert lineparse.failed(none).count() == lineparse.loaded(none).count() == 0
    assert packed.unpack(none, F.col("id"), F.col("t"), True, "f").count() == 0
    sides = tablediff.newest(none, F.col("k"), {"v": F.col("v")}, F.col("e"))
    assert tablediff.diff(sides, sides, ["v"]).count() == 0


def made_points(seed, n=400):
    rng = random.Random(seed)
    out, at = [], {}
    for i in range(n):
        entity = rng.choice(["a", "a", "a", "b\x1f", ""])
        start = at.get(entity, -40) + rng.choice([1, 2, 2, 2, 9, 70])
        at[entity] = start
        value = rng.choice([0.0, 0.0, 0.0, 1.0, 1.0 + 4e-11, 1.0 + 9e-11, 1.0 + 1.7e-10, None, NAN, math.inf])
        out.append((i, entity, start, start + rng.choice([0, 2, 2, 3, 40, 300]), value))
    out += rng.sample(out, 30) + [(9000, None, 1, 2, 0.0), (9001, "a", None, 2, 0.0), (9002, "a", 1, None, 0.0)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("seed", "chunk"), [(1, 8), (2, 32), (3, 1 << 20), (4, 3)])
def test_runs_against_brute_force(spark, seed, chunk):
    points = made_points(seed)
    df = spark.createDataFrame(points, "id long, k string, s long, e long, v double").withColumn("chunk", F.lit("clash"))
    got = runs.collapse_runs(df, {"k": F.col("k")}, F.col("id"), F.col("s"), F.col("e"), F.col("v"), chunk=chunk)
    assert sorted(tuple(r)[:4] for r in got.collect()) == brute.runs(points)
    few = runs.collapse_runs(df, {"k": F.col("k")}, F.col("id"), F.col("s"), F.col("e"), F.col("v"), chunk=chunk, min_points=3)
    assert sorted(tuple(r)[:4] for r in few.collect()) == [r for r in brute.runs(points) if r[3] >= 3]


def test_ties_of_starts_go_by_id(spark):
    points = [(2, "a", 0, 5, 1.0), (1, "a", 0, 9, 1.0), (3, "a", 0, 5, 2.0), (4, "a", 4, 5, 2.0)]
    got = runs.collapse_runs(spark.createDataFrame(points, "id long, k string, s long, e long, v double"), {"k": F.col("k")}, F.col("id"), F.col("s"), F.col("e"), F.col("v"))
    assert sorted(tuple(r) for r in got.collect()) == [("a", 0, 5, 2, 2.0), ("a", 0, 9, 2, 1.0)]


BED_AT = {"chrom": 1, "start": 2, "end": 3, "strand": 6}
line_text = st.text(alphabet='chr1+-."\t 059XA\r', max_size=30)


@settings(max_examples=400, deadline=None)
@given(line_text)
def test_cheapest_edits_state_the_fault(line):
    assert lineparse.diagnose(line, 3, 12, BED_AT, "bed")[0] == brute.fault(line, "bed", 3, 12, BED_AT)
    assert lineparse.diagnose(line, 5, 5, {"chrom": 1, "start": 2, "allele": 4}, "vcf")[0] == brute.fault(line, "vcf", 5, 5, {"chrom": 1, "start": 2, "allele": 4})
    maf = {"chrom": 2, "start": 1, "end": 4, "strand": 3, "allele": 4}
    assert lineparse.diagnose(line, 4, 4, maf, "maf")[0] == brute.fault(line, "maf", 4, 4, maf)


@pytest.mark.parametrize(
    ("line", "edits"),
    [
        ("chr1 5\t9\tn", ["insert delimiter in field 1"]), ('chr1\t5\t9\tn"', ["delete quote at 10"]), ("chr1\t5\t9\t\tn\tq", ["delete 1 delimiter after field 5"]), ("chr1\tx\t9\tn", ["replace number"]), ("chr1\t5\t9\tn", []),
    ],
)
def test_edits_mend_the_line(line, edits):
    fault, got, cost = lineparse.diagnose(line, 4, 5, BED_AT, "bed")
    assert got == edits
    assert (fault is None) == (not edits) and (cost == 0) == (not edits)


def test_long_lines_are_parsed_whole():
    assert lineparse.diagnose("chr1\t5\t9\t" + "x" * 200_000 + '"', 3, 12, BED_AT, "bed")[0] == "broken_quoting"
    assert lineparse.diagnose("chr1" + "\t" * 30_000 + "x", 3, 12, BED_AT, "bed")[0] == "wrong_field_count"


WIDE = {"chrom": 1, "start": 2, "allele": 4}


def test_wide_lines_get_their_cheapest_edits():
    """Edits of one kind whatever the width; lines of 100,000 columns take seconds."""
    for columns in (20, 456, 457, 2_000, 100_000):
        line = "chr1\t5\t.\tA\t" + "\t".join(["0/1"] * columns)
        legal = columns + 4
        assert lineparse.diagnose(line, legal, legal, WIDE, "vcf") == (None, [], 0)
        assert lineparse.diagnose(line + "\tx" * 440, legal, legal, WIDE, "vcf") == ("wrong_field_count", [f"delete 440 delimiters after field {legal}"], 440_000)
        assert lineparse.diagnose(line, legal + 440, legal + 440, WIDE, "vcf") == ("wrong_field_count", ["insert 440 delimiters at the end"], 440_000)
        fault, edits, _ = lineparse.diagnose(line + '"', legal, legal, WIDE, "vcf")
        assert (fault, edits) == ("broken_quoting", [f"delete quote at {len(line)}"])
        fault, edits, _ = lineparse.diagnose('chr1\t5\t"' + line[7:], legal, legal, WIDE, "vcf")
        assert (fault, edits) == ("broken_quoting", ["delete quote at 7"])
        split = line.replace("\tA\t", "\t\t\tA\t")
        assert lineparse.diagnose(split, legal, legal, WIDE, "vcf")[1] == ["delete 2 delimiters after field 4"]  # the empty fields and A as one


def wrong(fields, typed, kind):
    return sum(lineparse._type_cost(fields[i - 1], k, kind) for i, k in typed.items())


cells = st.lists(st.sampled_from(["chr1", "5", "9", "+", "-", ".", "A", "", "0", "00", "9223372036854775807", "x!", '"5"', "5 9", "chr1 5 9"]), min_size=1, max_size=7)


@settings(max_examples=300, deadline=None)
@given(cells, st.integers(1, 9), st.sampled_from([("bed", {1: "chrom", 2: "start", 3: "end", 6: "strand"}), ("vcf", {1: "chrom", 2: "start", 4: "allele"}), ("maf", {2: "chrom", 1: "start", 4: "end", 3: "strand", 5: "allele"})]))
def test_least_cost_against_all_edits(given_fields, goal, format):
    kind, roles = format
    typed = {i: k for i, k in roles.items() if i <= goal}
    n, ways = len(given_fields), []
    if goal < n:
        for cuts in itertools.combinations(range(1, n), goal - 1):
            ways.append(["".join(given_fields[a:b]) for a, b in itertools.pairwise([0, *cuts, n])])
    elif goal > n:
        parts = [[[f]] + [[" ".join(x) for x in (f.split()[:k], f.split()[k:])] for k in range(1, len(f.split())) if '"' not in f] + ([f.split()] if len(f.split()) > 2 else []) for f in given_fields]
        for choice in itertools.product(*parts):
            flat = [x for c in choice for x in c]
            for at in itertools.combinations_with_replacement(range(len(flat) + 1), goal - len(flat)) if goal >= len(flat) else []:
                made = list(flat)
                for p in sorted(at, reverse=True):
                    made.insert(p, "")
                ways.append(made)
    if ways:
        cost, edits, fields = lineparse._fit("\t".join(given_fields) + "\t" * (given_fields[-1] == ""), goal, goal, roles, kind)
        assert len(fields) == goal and cost == abs(goal - n) * 1000 + min(wrong(w, typed, kind) for w in ways) == abs(goal - n) * 1000 + wrong(fields, typed, kind)
        assert edits


def raw_lines():
    head = "Hugo\tChromosome\tStart_Position\tEnd_Position\tStrand\tReference_Allele"
    files = {
        ("bed", "a"): ["# h", "track x", "chr1\t1\t5", "chr1\t1\t5\t", "chr1\t1", "", " \t", 'chr1\t"1"\t5', '"a\tb"\t1\t5', "chr 1\t1\t5", "\t1\t5", "chr1\t9\t5", "chr1\t1\t5\tn\t0\t+-", "chr1\t1\t5\tn\t0\t.", "chr1\t1\t5\r", "chr1\t1\t5\r\r", 'c\t1\t5\t"', "c\t1\t9223372036854775808", "c\t+1\t05", "c\t1\t5" + "\tx" * 10],
        ("vcf", "b"): ["##m", "#CHROM\tPOS\tID\tREF\tALT", "1\t5\t.\tA\tG", "1\t5\t.\tA", "1\t5\t.\tZ\tG", "1\tx\t.\tA\tG", '1\t5\t"a\tb"\tA\tG', "1\t5\t.\t\tG"],
        ("vcf", "nohead"): ["1\t5\t.\tA\tG\t.\t.\t.", "1\t5"],
        ("maf", "c"): ["#v", head, "g\tchr1\t1\t5\t+\tA", "g\tchr1\t1\t5\t.\tA", "g\tchr1\t1\t5\t-\t-", "g\tchr1\t7\t5\t-\t-", "g\tchr1\t1\t5\t-\t", "g\tchr1", ""],
        ("maf", "odd"): ["a\tb", "x\ty", "x"], ("other", "d"): ["x"],
    }
    out, i = [], 0
    for (kind, name), texts in files.items():
        for n, text in enumerate(texts, start=1):
            i += 1
            out.append((i, kind, name, n, text))
    return [*out, (900, "bed", "a", 90, None), out[4], out[7]], head.split("\t")


def test_lines_of_files(spark):
    rows, head = raw_lines()
    df = spark.createDataFrame(rows, "line_id long, file_kind string, file_name string, line_no long, raw_line string").withColumn("fields", F.lit("clash"))
    want = {}
    maf_at = {"chrom": 2, "start": 3, "end": 4, "strand": 5, "allele": 6}
    for i, kind, name, n, raw in rows:
        if raw is None or kind == "other" or raw.startswith("#") or (kind == "bed" and raw.startswith(("track", "browser"))) or raw == "\t".join(head) or (name == "odd" and n == 1):
            continue
        least, most = {"a": (3, 12), "b": (5, 5), "nohead": (8, 10**9), "c": (6, 6), "odd": (2, 2)}[name]
        at = {"bed": BED_AT, "vcf": {"chrom": 1, "start": 2, "allele": 4}, "maf": maf_at if name == "c" else {}}[kind]
        want[i] = brute.fault(raw[:-1] if raw.endswith("\r") else raw, kind, least, most, at)
    got = {(r.line_id, r.fault) for r in lineparse.failed(df).collect()}
    assert got == {(i, f) for i, f in want.items() if f}
    good = {r.line_id: r.fields for r in lineparse.loaded(df).collect()}
    assert set(good) == {i for i, f in want.items() if f is None}
    texts = {r[0]: r[4] for r in rows}
    assert all(good[i] == [brute.bare(f) for f in brute.cut(texts[i].removesuffix("\r"))] for i in good)


FIELDS = [
    "DP=1;AF=0.1,0.2", '"DP=1;DB"', '"a;b";c', "A=1,B=2", "A=1, B=2,3", 'gene_id "G1", tag "a, b"; tag "c""d"', 'x "y" z;q', ";;a;;b | c|", 'N="a=b;c";=5;k=', " . ", ".", "", None, '"', '"a', 'a"b', '""', 'A="x', "a\x01b;c\x011\x01d", 'k "v\x01w";l', "é=ü,ß=1",
    'a,b "c"', 'a , b  "c";d', "a=1;a=1;a", '"a""b";c', '"a" ; "b"', "k=v=w;x==y", ",a=1,", '"x;y"', "a;b\nc",
]
LISTS = ["A,C", '"A,C"', '"A","C"', "A", " A / C|;T ", ",", ".", None, "", '"A C" T', '"a""b",c', "A\tC\nG", '"A', "\x01,\x010\x01", '"x"y z']


@pytest.mark.parametrize(("pairs", "texts"), [(True, FIELDS), (False, LISTS + FIELDS)])
def test_packed_fields_against_brute_force(spark, pairs, texts):
    rng = random.Random(4)
    texts = texts + ["".join(rng.choices('ab=,;|/ "\x01.0', k=rng.randint(1, 14))) for _ in range(300)] + ['"' + "x;" * 50_000 + '";y', 'k="' + "ab" * 30_000 + '";z']
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:5], "id long, t string").withColumn("packed", F.lit("clash"))
    for least in (1, 2):
        got = {}
        for r in packed.unpack(df, F.col("id"), F.col("t"), pairs, "f", least).collect():
            assert r.item_no not in got.setdefault(r.record_id, {})
            got[r.record_id][r.item_no] = (r.item_key, r.item_value)
        want = {i: dict(enumerate(brute.unpacked(t, pairs), start=1)) for i, t in rows}
        for i, t in rows:
            assert got.get(i, {}) == (want[i] if len(want[i]) >= least else {}), repr(t)


@pytest.mark.parametrize("chunk_rows", [1, 5, 64])
def test_diff_against_brute_force(spark, chunk_rows):
    rng = random.Random(8)
    left = {f"k{i:04}": (rng.choice(["a", "b", None]), rng.choice([None, 10, 20])) for i in range(900)}
    right = {k: v for k, v in left.items() if rng.random() > 0.03}
    for k in rng.sample(sorted(right), 60):
        right[k] = (rng.choice(["a", "b", None, ""]), rng.choice([None, 10, 11, 12, 21]))
    right |= {f"n{i}": ("a", 1) for i in range(25)}
    frame = lambda d: spark.createDataFrame([(k, *v) for k, v in d.items()], "key string, a string, n long")
    got = tablediff.diff(frame(left), frame(right), ["a", "n"], {"n": 1}, missing=("missing_left", "missing_right"), chunk_rows=chunk_rows, partitions=3).collect()
    names = {"0": "a", "1": "n"}
    want = {(k, names.get(x, x)) for k, x in brute.diff(left, right, [0, 1])}
    assert sorted((r.key, r.diff_kind) for r in got) == sorted(want)
    for r in got:
        if r.diff_kind in ("a", "n"):
            i = "an".index(r.diff_kind)
            shown = lambda v: None if v is None else str(v)
            assert (r.left_value, r.right_value) == (shown(left[r.key][i]), shown(right[r.key][i]))
    none = spark.createDataFrame([], "key string, a string, n long")
    assert tablediff.diff(frame(left), none, ["a", "n"]).count() == len(left)


def test_null_differs_from_any_text(spark):
    left = spark.createDataFrame([("a", None), ("b", ""), ("c", "\0"), ("d", None), (None, "x")], "key string, v string")
    right = spark.createDataFrame([("a", "\0"), ("b", None), ("c", "\0"), ("d", None), (None, "y")], "key string, v string")
    assert sorted(tuple(r) for r in tablediff.diff(left, right, ["v"]).collect()) == [("a", "v", None, "\0"), ("b", "v", "", None)]


def test_fields_of_matched_chunks_are_left_alone(spark):
    frame = lambda rows: spark.createDataFrame(rows, "key string, v long")
    rows = [(f"k{i:05}", i) for i in range(4000)]
    other = [(k, -1 if k == "k01234" else v) for k, v in rows if k != "k03000"]
    keys = [r.key for r in tablediff.open_keys(frame(rows), frame(other), ["v"], chunk_rows=8, partitions=2).collect()]
    assert {"k01234", "k03000"} <= set(keys) and len(keys) == len(set(keys)) < 200


def test_chunks_find_their_way_back():
    import numpy as np

    keys = np.random.default_rng(1).integers(0, 2**62, 5000).astype(np.uint64)
    whole, less = tablediff.chunk_ids(keys), tablediff.chunk_ids(np.delete(keys, 100))
    assert 40 < whole[-1] < 160
    assert (np.diff(whole[1000:]) == np.diff(less[999:])).all()


def test_newest_delivery_holds(spark):
    rows = [("k", 1, "old"), ("k", 3, "new"), ("k", 2, "mid"), (None, 1, "x"), ("n", None, "a"), ("n", 1, None), ("t", 1, "a"), ("t", 1, "b")]
    got = tablediff.newest(spark.createDataFrame(rows, "k string, o long, v string").withColumn("x", F.lit(1)), F.col("k"), {"v": F.col("v")}, F.col("o"))
    assert {(r.key, r.v) for r in got.collect()} == {("k", "new"), ("n", None), ("t", "b")}


def test_found_queries_have_the_stated_columns():
    assert {"p1_found", "p2_found", "p3_found", "p4_found", "p5_found"} <= set(problems.QUERIES)
