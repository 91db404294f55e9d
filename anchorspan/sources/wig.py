"""Wiggle and bedGraph text as points, and points as wiggle text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorspan.functions.chrom import trimmed
from anchorspan.functions.numbers import plain_double, real, unsigned
from anchorspan.sources import lines as text_lines


def _option(line: Column, key: str) -> Column:
    """The value of the last key=value part of a declaration; null if there is none."""
    parts = F.filter(F.split(line, r"\s+"), lambda p: p.startswith(f"{key}="))
    return F.substring(F.get(parts, F.size(parts) - 1), len(key) + 2, 1_000_000)


def points(rows: DataFrame) -> DataFrame:
    """(file, block, at, chrom, start, end, value, error) of wiggle lines; error is null for a point, else why a line is none.

    A declaration holds until the next valid one, over splits of a file, too. A line of four or more fields that reads as
    chrom, start, end, value is bedGraph whatever is declared. The n-th value after a fixedStep declaration stands at
    start + n * step (step is the span unless given); lines that are no such values do not count.
    """
    line = trimmed(F.col("line"))
    skip = (line == "") | line.startswith("#") | line.startswith("track") | line.startswith("browser")
    rows = rows.select("file", "block", "at", line.alias("line")).where(~skip)
    is_decl = F.col("line").startswith("variableStep") | F.col("line").startswith("fixedStep")
    fixed = F.col("line").startswith("fixedStep")
    text = {k: _option(F.col("line"), k) for k in ("chrom", "span", "start", "step")}
    number = {k: unsigned(text[k]) for k in ("span", "start", "step")}
    wrong = F.lit(False)
    for k in number:
        wrong |= text[k].isNotNull() & number[k].isNull()
    decl_error = F.when(wrong, "invalid number").when(text["chrom"].isNull(), "missing chrom").when(fixed & text["start"].isNull(), "missing start")
    f = F.split("line", r"\s+")
    part = lambda i: F.get(f, F.lit(i))
    rows = rows.withColumns(
        {
            "is_decl": is_decl, "decl_error": F.when(is_decl, decl_error), "fixed": fixed, "chrom": text["chrom"], "span": F.coalesce(number["span"], F.lit(1).cast("bigint")), "start": number["start"],
            "step": F.coalesce(number["step"], number["span"], F.lit(1).cast("bigint")), "n": F.size(f), "c": part(0), "s": unsigned(part(1)), "e": unsigned(part(2)), "v": real(part(3)),
            "pos": unsigned(part(0)), "v2": real(part(1)), "v1": real(F.col("line")),
        }
    )
    graph = ~F.col("is_decl") & (F.col("n") >= 4) & F.col("s").isNotNull() & F.col("e").isNotNull() & F.col("v").isNotNull()
    rows = rows.withColumn("graph", F.coalesce(graph, F.lit(False)))
    rows = rows.withColumn("begins", F.col("is_decl") & F.col("decl_error").isNull()).withColumn("counts", (~F.col("is_decl") & ~F.col("graph") & F.col("v1").isNotNull()).cast("bigint"))
    state = ["fixed", "chrom", "span", "start", "step"]
    got = text_lines.carried(rows, "begins", "counts", state).where(~F.col("begins"))
    c = lambda n: F.col(f"carried_{n}")
    step_start = F.when(c("fixed"), c("start") - 1 + F.col("before") * c("step")).otherwise(F.col("pos") - 1)
    start = F.when(F.col("graph"), F.col("s")).otherwise(step_start)
    error = (
        F.when(F.col("is_decl"), F.col("decl_error")).when(F.col("graph"), F.lit(None)).when(~F.col("started"), "data before declaration")
        .when(c("fixed"), F.when(F.col("v1").isNull(), "invalid number")).when(F.col("n") < 2, "too few fields").when(F.col("pos").isNull() | F.col("v2").isNull(), "invalid number")
    )
    return got.select(
        "file", "block", "at", F.when(F.col("graph"), F.col("c")).otherwise(c("chrom")).alias("chrom"), start.alias("start"), F.when(F.col("graph"), F.col("e")).otherwise(step_start + c("span")).alias("end"),
        F.when(F.col("graph"), F.col("v")).when(c("fixed"), F.col("v1")).otherwise(F.col("v2")).alias("value"), error.alias("error"),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    return points(text_lines.read(spark, path))


def bedgraph_line(chrom: Column, start: Column, end: Column, value: Column) -> Column:
    return F.concat_ws("\t", chrom, start.cast("string"), end.cast("string"), plain_double(value))


def wiggle_lines(graph: DataFrame) -> DataFrame:
    """(chrom, place, line): variableStep text of (chrom, start, end, value), one declaration per chromosome.

    The declared span is that of the first record of the chromosome, as the format has one span for all that follow.
    Order by chrom, place.
    """
    span = graph.groupBy("chrom").agg(F.min_by(F.col("end") - F.col("start"), F.struct("start", "end", "value")).alias("span"))
    head = F.concat(F.lit("variableStep chrom="), F.col("chrom"), F.when(F.col("span") > 1, F.concat(F.lit(" span="), F.col("span").cast("string"))).otherwise(""))
    heads = span.select("chrom", F.lit(-1).cast("bigint").alias("place"), head.alias("line"))
    return heads.unionByName(graph.select("chrom", F.col("start").alias("place"), F.concat_ws("\t", (F.col("start") + 1).cast("string"), plain_double(F.col("value"))).alias("line")))
