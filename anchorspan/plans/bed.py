"""BED conversion: every segment of a record is a line; a BED12 record keeps its blocks together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorspan.functions.chrom import rtrimmed
from anchorspan.functions.numbers import unsigned
from anchorspan.operators.lift import Lifter
from anchorspan.plans.common import field, fields, joined, none_of, tail

#: What header lines begin with.
HEADERS = ["#", "track", "browser"]


def is_header(line: Column) -> Column:
    out = F.lit(False)
    for h in HEADERS:
        out |= line.startswith(h)
    return out


def parsed(rows: DataFrame) -> DataFrame:
    """rows (.., line) without blank and header lines, with fields, chrom, start, end, strand and bad (no three valid fields)."""
    line = rtrimmed(F.col("line"))
    kept = rows.withColumn("line", line).where((F.col("line") != "") & ~is_header(F.col("line"))).withColumn("fields", fields(F.col("line")))
    start, end = unsigned(field(1)), unsigned(field(2))
    strand = F.when(field(5) == "-", "-").otherwise("+")
    return kept.withColumns({"chrom": field(0), "start": start, "end": end, "strand": strand, "bad": F.coalesce((F.size("fields") < 3) | start.isNull() | end.isNull(), F.lit(True))})


def _numbers(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), unsigned), lambda x: x.isNotNull())


def convert(rows: DataFrame, lifter: Lifter, rid: str = "at") -> DataFrame:
    """The outcome of BED lines: columns of parsed() with n_segments, status (ok, multi, unmapped, parse_error), out, reject.

    A record of 7 to 11 columns keeps its first six. A record whose start is beyond its end is unmapped.
    """
    n = F.size("fields")
    recs = parsed(rows)
    sizes, starts = _numbers(field(10)), _numbers(field(11))
    is12 = n >= 12
    recs = recs.withColumns({"sizes": F.when(is12, sizes), "starts": F.when(is12, starts)})
    blocked = is12 & (F.size("sizes") == F.size("starts")) & (F.size("sizes") > 0) & ~F.col("bad")
    recs = recs.withColumn("blocked", F.coalesce(blocked, F.lit(False)))
    recs = lifter.with_segments(recs, rid, F.when(~F.col("blocked"), F.col("chrom")), F.col("start"), F.col("end"), F.col("strand"))
    spans = F.when(F.col("blocked"), F.transform(F.arrays_zip("starts", "sizes"), lambda b: F.struct((F.col("start") + b["starts"]).alias("s"), (F.col("start") + b["starts"] + b["sizes"]).alias("e"))))
    recs = lifter.with_span_segments(recs, rid, F.col("chrom"), spans, F.col("strand"), "parts")
    whole = recs.withColumn("found", F.coalesce("segments", none_of(SEGMENTS)))
    simple = F.transform("found", lambda g: _simple_line(g))
    made = whole.withColumn("kept12", _blocked_line())
    original = joined(F.col("chrom"), F.col("start").cast("string"), F.col("end").cast("string"), tail(3))
    out = F.when(F.col("bad"), none_of("array<string>")).when(F.col("blocked"), F.when(F.col("kept12").isNotNull(), F.array("kept12")).otherwise(none_of("array<string>"))).otherwise(simple)
    made = made.withColumn("out", out)
    status = F.when(F.col("bad"), "parse_error").when(F.size("out") == 0, "unmapped").when(F.size("out") > 1, "multi").otherwise("ok")
    reject = F.when(F.col("bad"), F.col("line")).when(F.size("out") == 0, original)
    return made.withColumns({"n_segments": F.size("found"), "status": status, "reject": reject}).drop("sizes", "starts", "blocked", "segments", "parts", "found", "kept12")


SEGMENTS = "array<struct<seq:int,s_start:bigint,s_end:bigint,t_chrom:string,t_start:bigint,t_end:bigint,t_strand:string>>"


def _simple_line(g: Column) -> Column:
    n = F.size("fields")
    text = lambda c: c.cast("string")
    shift = g["t_start"] - F.col("start")
    thick_start = F.greatest(unsigned(field(6)) + shift, F.when(unsigned(field(6)).isNotNull(), g["t_start"]))
    thick_end = F.least(unsigned(field(7)) + shift, F.when(unsigned(field(7)).isNotNull(), g["t_end"]))
    starts = F.filter(F.split(field(11), ","), lambda x: x != "")
    moved = F.array_join(F.transform(starts, lambda x: F.when(x.rlike(r"\A[+-]?[0-9]+\z"), text(x.try_cast("bigint") + shift)).otherwise(x)), ",")
    wide = lambda c: F.when(n >= 12, c)
    return joined(
        g["t_chrom"], text(g["t_start"]), text(g["t_end"]), field(3), field(4), F.when(n > 5, g["t_strand"]),
        wide(text(thick_start)), wide(text(thick_end)), wide(field(8)), wide(field(9)), wide(field(10)), wide(moved), tail(12),
    )


def _blocked_line() -> Column:
    """The line of a BED12 record whose blocks each have one segment, all on one target chromosome; else null."""
    text = lambda c: c.cast("string")
    single = F.forall("parts", lambda p: F.coalesce(F.size(p), F.lit(-1)) == 1)
    got = F.transform("parts", lambda p: F.get(p, F.lit(0)))
    first, last = F.get(got, F.lit(0)), F.get(got, F.size(got) - 1)
    ns, ne = first["t_start"], last["t_end"]
    thick_s, thick_e = F.coalesce(unsigned(field(6)), F.col("start")), F.coalesce(unsigned(field(7)), F.col("end"))
    nts = F.least(ns + F.greatest(thick_s - F.col("start"), F.lit(0)), ne)
    nte = F.greatest(F.greatest(ne - F.greatest(F.col("end") - thick_e, F.lit(0)), F.lit(0)), ns)
    sound = single & F.forall(got, lambda g: g["t_chrom"] == first["t_chrom"]) & F.forall(got, lambda g: g["t_start"] >= ns) & (nts <= nte) & (nts >= ns) & (nte <= ne)
    line = joined(
        first["t_chrom"], text(ns), text(ne), field(3), field(4), first["t_strand"], text(nts), text(nte), field(8), text(F.size(got)),
        F.array_join(F.transform(got, lambda g: text(g["t_end"] - g["t_start"])), ","), F.array_join(F.transform(got, lambda g: text(g["t_start"] - ns)), ","), tail(12),
    )
    return F.when(F.col("blocked") & sound, line)


def headers(rows: DataFrame) -> DataFrame:
    """The header lines, as they go to the output."""
    line = rtrimmed(F.col("line"))
    return rows.where(is_header(line)).withColumn("line", line)
