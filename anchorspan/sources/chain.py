"""Alignment chains: text lines to headers, data lines and blocks; or blocks from header and line tables.

The columns that a chain file calls target are the source of a lift, and those it calls query are its target.
"""

from __future__ import annotations

import bz2
import gzip
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anchorspan.functions.chrom import trimmed
from anchorspan.functions.numbers import unsigned
from anchorspan.session import ship

HEADER_FIELDS = ["score", "source_name", "source_size", "source_strand", "source_start", "source_end", "target_name", "target_size", "target_strand", "target_start", "target_end"]
_NUMBERS = ["score", "source_size", "source_start", "source_end", "target_size", "target_start", "target_end"]


class ChainError(ValueError):
    """A line of a chain file that is not valid. kind names the fault, content holds at most 100 characters of the line."""

    def __init__(self, message: str, line_number: int, kind: str, content: str | None = None):
        super().__init__(f"Line {line_number}: {message}")
        self.message, self.line_number, self.kind = message, line_number, kind
        self.content = None if content is None else content[:100]


def detect_compression(path: str) -> str:
    """gzip, bzip2 or plain: by the file's extension, else by its first bytes."""
    if path.endswith(".gz"):
        return "gzip"
    if path.endswith(".bz2"):
        return "bzip2"
    with open(path, "rb") as f:
        return compression_of(f.read(3))


def compression_of(head: bytes) -> str:
    return "gzip" if head[:2] == b"\x1f\x8b" else "bzip2" if head[:3] == b"BZh" else "plain"


def decompressed(path: str, data: bytes) -> bytes:
    kind = "gzip" if path.endswith(".gz") else "bzip2" if path.endswith(".bz2") else compression_of(data[:3])
    return gzip.decompress(data) if kind == "gzip" else bz2.decompress(data) if kind == "bzip2" else data


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of one or more chain files, compressed or not, whatever their names."""
    ship(spark)

    @F.pandas_udf("array<string>")
    def lines(paths: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([decompressed(p, c).decode("utf-8", "replace").removesuffix("\n").split("\n") for p, c in zip(paths, contents, strict=True)])

    files = spark.read.format("binaryFile").load(path).select("path", lines("path", "content").alias("lines"))
    return files.select("path", F.posexplode("lines").alias("at", "line")).select("path", (F.col("at") + 1).cast("bigint").alias("line_no"), "line")


def lines_of(spark: SparkSession, text: str | bytes) -> DataFrame:
    """The same for the text of one chain file."""
    text = text.decode("utf-8", "replace") if isinstance(text, bytes) else text
    rows = [("", i + 1, line) for i, line in enumerate(text.removesuffix("\n").split("\n"))]
    return spark.createDataFrame(rows, "path string, line_no bigint, line string")


def parse(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers, data lines), each with path, line_no, line, chain_seq, its fields, and error and message of a faulty line.

    A blank line or one that begins with # ends a chain; data lines outside of one are left out. The window runs over the
    lines of one file, which are one task's in any case: a compressed file is not splittable.
    """
    rows = lines.select("path", "line_no", trimmed(F.col("line")).alias("line"))
    is_end = (F.col("line") == "") | F.col("line").startswith("#")
    is_head = F.col("line").startswith("chain")
    order = Window.partitionBy("path").orderBy("line_no")
    rows = rows.withColumn("kind", F.when(is_end, "end").when(is_head, "header").otherwise("data"))
    opener = F.struct("line_no", "kind")
    last = F.last(F.when(F.col("kind") != "data", opener), ignorenulls=True).over(order)
    rows = rows.withColumn("opener", last).withColumn("chain_seq", F.col("opener.line_no"))
    rows = rows.withColumn("f", F.split("line", r"\s+")).withColumn("numbers", F.transform("f", unsigned))
    field = lambda i: F.get("f", F.lit(i))
    number = lambda i: F.get("numbers", F.lit(i))
    columns = {n: number(i) if n in _NUMBERS else F.substring(field(i), 1, 1) if n.endswith("strand") else field(i) for i, n in enumerate(HEADER_FIELDS, start=1)}
    headers = rows.where("kind = 'header'").withColumns(columns).withColumn("chain_id", F.coalesce(field(12), F.lit("")))
    gap = lambda i: F.when(F.size("f") == 1, F.lit(0).cast("bigint")).otherwise(number(i))
    data = rows.where("kind = 'data' and opener.kind = 'header'").withColumns({"size": number(0), "dt": gap(1), "dq": gap(2)})
    out = []
    for part, fault in ((headers, _header_fault()), (data, _data_fault())):
        marked = part.withColumn("fault", fault)
        out.append(marked.select("*", F.col("fault.kind").alias("error"), F.col("fault.message").alias("message")).drop("fault", "f", "numbers", "opener", "kind"))
    return out[0], out[1]


def _first(cases: list[tuple[Column, str, Column]]) -> Column:
    """struct<kind, message> of the first case that holds, else null."""
    out = None
    for condition, kind, message in cases:
        value = F.struct(F.lit(kind).alias("kind"), message.alias("message"))
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out


def _text(i: int) -> Column:
    return F.get("f", F.lit(i))


def _header_fault() -> Column:
    n = F.size("f")
    cases = [
        (n < 12, "InvalidHeader", F.format_string("a chain header of %d fields, 12 are the least", n)),
        (_text(0) != "chain", "InvalidHeader", F.concat(F.lit("a chain header that begins with "), _text(0))),
    ]
    for side, group in (("source", HEADER_FIELDS[:6]), ("target", HEADER_FIELDS[6:])):
        for name in group:
            raw = _text(HEADER_FIELDS.index(name) + 1)
            if name in _NUMBERS:
                cases.append((F.col(name).isNull(), "InvalidNumber", F.concat(F.lit(f"no number as {name}: "), raw)))
            elif name.endswith("strand"):
                cases.append((~F.col(name).isin("+", "-"), "InvalidStrand", F.concat(F.lit(f"no strand as {name}: "), F.col(name))))
        s, e, size = F.col(f"{side}_start"), F.col(f"{side}_end"), F.col(f"{side}_size")
        cases.append((s > e, "InvalidCoordinates", F.format_string(f"{side} begins at %d, behind its end %d", s, e)))
        cases.append((e > size, "InvalidCoordinates", F.format_string(f"{side} ends at %d, beyond its sequence of %d", e, size)))
    return _first(cases)


def _data_fault() -> Column:
    n = F.size("f")
    return _first(
        [
            (~n.isin(1, 3), "InvalidDataLine", F.format_string("a line of %d numbers, one or three make a block", n)),
            (F.col("size").isNull(), "InvalidNumber", F.concat(F.lit("no number as size of a block: "), _text(0))),
            (F.col("size") == 0, "InvalidDataLine", F.lit("a block without a base")),
            (F.col("dt").isNull(), "InvalidNumber", F.concat(F.lit("no number as gap of the source: "), _text(1))),
            (F.col("dq").isNull(), "InvalidNumber", F.concat(F.lit("no number as gap of the target: "), _text(2))),
        ]
    )


def check(headers: DataFrame, data: DataFrame) -> None:
    """Raises ChainError for the first faulty line, if there is one."""
    faulty = [d.where(F.col("error").isNotNull()).select("path", "line_no", "error", "message", "line") for d in (headers, data)]
    bad = faulty[0].unionByName(faulty[1]).orderBy("path", "line_no").head()
    if bad is not None:
        raise ChainError(bad["message"], bad["line_no"], bad["error"], bad["line"])


@dataclass
class ChainFile:
    """headers, blocks and sizes (side, chrom, size; of repeated names the last) of parsed chains."""

    headers: DataFrame
    blocks: DataFrame
    sizes: DataFrame


def size_of(sizes: dict[str, int], name: str) -> int | None:
    """The size of a sequence by its name: as it is, else without chr before it, else with it."""
    return next((sizes[n] for n in (name, name.removeprefix("chr"), f"chr{name}") if n in sizes), None)


def load(lines: DataFrame, strict: bool = True) -> ChainFile:
    """The chains of lines. strict: the first faulty line raises; else faulty lines are left out."""
    headers, data = parse(lines)
    if strict:
        check(headers, data)
    headers = headers.where(F.col("error").isNull()).select("path", "chain_seq", "line_no", "chain_id", *HEADER_FIELDS)
    data = data.where(F.col("error").isNull()).select("path", "chain_seq", "line_no", F.col("line_no").alias("block_no"), "size", "dt", "dq")
    joined = data.join(headers.drop("line_no"), ["path", "chain_seq"])
    place = F.struct("path", "line_no")
    return ChainFile(headers, blocks(joined, ["path", "chain_seq"], place), sizes(headers, place))


def sizes(headers: DataFrame, order: Column) -> DataFrame:
    """(side, chrom, size) of headers (source_name, source_size, target_name, target_size): of a name's headers the last in order holds."""
    sides = [headers.select(F.lit(s).alias("side"), F.col(f"{s}_name").alias("chrom"), F.col(f"{s}_size").alias("size"), order.alias("place")) for s in ("source", "target")]
    return sides[0].unionByName(sides[1]).groupBy("side", "chrom").agg(F.max_by("size", "place").alias("size"))


def blocks(joined: DataFrame, chain: list[str], block_id: Column) -> DataFrame:
    """The aligned interval pairs of data lines joined to their headers: running offsets per chain, minus sides turned.

    joined needs block_no, size, dt, dq and the header fields; chain names the columns of a chain, block_id orders blocks.
    """
    earlier = Window.partitionBy(*chain).orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = joined
    for side, gap in (("source", "dt"), ("target", "dq")):
        rows = rows.withColumn(f"_{side}", F.col(f"{side}_start") + F.coalesce(F.sum(F.col("size") + F.coalesce(F.col(gap), F.lit(0))).over(earlier), F.lit(0)))
    out = [block_id.alias("block_id")]
    for side in ("source", "target"):
        at, minus = F.col(f"_{side}"), F.col(f"{side}_strand") == "-"
        start = F.when(minus, F.col(f"{side}_size") - at - F.col("size")).otherwise(at)
        out += [F.col(f"{side}_name").alias(f"{side}_chrom"), start.alias(f"{side}_start"), (start + F.col("size")).alias(f"{side}_end")]
    return rows.select(*out, "target_strand")


def blocks_from_tables(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """Blocks from a header table (chain_id, t_name, ... q_end) and a line table (chain_id, block_no, block_size, dt, dq)."""
    named = headers.select(
        "chain_id", F.col("t_name").alias("source_name"), F.col("t_size").alias("source_size"), F.col("t_strand").alias("source_strand"), F.col("t_start").alias("source_start"),
        F.col("q_name").alias("target_name"), F.col("q_size").alias("target_size"), F.col("q_strand").alias("target_strand"), F.col("q_start").alias("target_start"),
    )
    joined = lines.select("chain_id", "block_no", F.col("block_size").alias("size"), "dt", "dq").join(named, "chain_id")
    return blocks(joined, ["chain_id"], F.col("chain_id") * 10_000_000 + F.col("block_no"))
