"""Reference sequences as a table of chunks, and bases fetched by a join on the chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorspan.functions.chrom import trimmed
from anchorspan.sources import lines as text_lines

#: Bases in a chunk.
CHUNK = 1 << 14


def from_lines(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(name, chunk_no, seq) of FASTA lines. The name ends at the first blank; of repeated names the last sequence holds."""
    bare = trimmed(F.col("line"))
    head = F.col("line").startswith(">")
    marked = rows.withColumn("is_head", head).withColumn("name", F.when(head, F.regexp_extract(F.col("line"), r"^>\s*(\S*)", 1))).withColumn("instance", F.when(head, F.struct("file", "block", "at")))
    marked = marked.withColumn("seq", F.when(head, F.lit("")).otherwise(bare)).withColumn("size", F.length("seq").cast("bigint"))
    placed = text_lines.carried(marked, "is_head", "size", ["instance", "name"]).where("started and size > 0")
    latest = placed.groupBy(F.col("carried_name").alias("n")).agg(F.max("carried_instance").alias("newest"))
    kept = placed.join(latest, F.col("carried_name") == F.col("n")).where(F.col("carried_instance") == F.col("newest"))
    first, last = F.floor(F.col("before") / chunk), F.floor((F.col("before") + F.col("size") - 1) / chunk)
    parts = kept.select("carried_name", "before", "seq", F.explode(F.sequence(first, last)).alias("chunk_no"))
    begin = F.greatest(F.col("chunk_no") * chunk - F.col("before"), F.lit(0))
    piece = F.substring("seq", begin.cast("int") + 1, ((F.col("chunk_no") + 1) * chunk - F.col("before") - begin).cast("int"))
    pieces = parts.select(F.col("carried_name").alias("name"), "chunk_no", F.struct((F.col("before") + begin).alias("at"), piece.alias("piece")).alias("x"))
    return pieces.groupBy("name", "chunk_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["piece"]), "").alias("seq"))


def read(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    return from_lines(text_lines.read(spark, path), chunk)


def lengths(chunks: DataFrame) -> DataFrame:
    """(name, length) of each sequence."""
    return chunks.groupBy("name").agg(F.sum(F.length("seq")).cast("bigint").alias("length"))


def in_file_order(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """(length, name, file, block, at) of each sequence of FASTA lines and their chunks: where it stands in the file."""
    heads = rows.where(F.col("line").startswith(">")).groupBy(F.regexp_extract("line", r"^>\s*(\S*)", 1).alias("name")).agg(F.max(F.struct(*text_lines.ORDER)).alias("x"))
    return lengths(chunks).join(heads, "name").select("length", "name", *[F.col(f"x.{c}").alias(c) for c in text_lines.ORDER])


def other_name(name: Column) -> Column:
    """The name with its chr taken off, or put on."""
    return F.when(name.startswith("chr"), F.substring(name, 4, 1_000_000)).otherwise(F.concat(F.lit("chr"), name))


def with_bases(rows: DataFrame, chunks: DataFrame, rid: str, name: str, start: str, end: str, into: str, chunk: int = CHUNK) -> DataFrame:
    """rows with the upper-case bases [start, end) of a sequence as column ``into``; null if there are none.

    A name that is unknown is tried with its prefix toggled. The range is clipped at the sequence's end. rows are joined to
    chunks by (name, chunk), so a chromosome is spread over its chunks; rid must be unique.
    """
    known = chunks.select("name").distinct()
    asked = rows.select(F.col(name).alias("q")).where(F.col(name).isNotNull()).distinct()
    tries = asked.select("q", F.posexplode(F.array(F.col("q"), other_name(F.col("q")))).alias("rank", "name")).join(known, "name")
    named = tries.groupBy("q").agg(F.min_by("name", "rank").alias("seq_name"))
    spans = rows.where((F.col(start) >= 0) & (F.col(end) > F.col(start))).select(F.col(rid).alias("_rid"), F.col(name).alias("q"), F.col(start).alias("_s"), F.col(end).alias("_e"))
    wanted = spans.join(named, "q").withColumn("chunk_no", F.explode(F.sequence(F.floor(F.col("_s") / chunk), F.floor((F.col("_e") - 1) / chunk))))
    c = chunks.select(F.col("name").alias("seq_name"), "chunk_no", "seq")
    base = F.col("chunk_no") * chunk
    low = F.greatest(F.col("_s") - base, F.lit(0))
    part = F.substring("seq", low.cast("int") + 1, (F.least(F.col("_e") - base, F.lit(chunk)) - low).cast("int"))
    got = wanted.join(c, ["seq_name", "chunk_no"]).select("_rid", F.struct("chunk_no", part.alias("p")).alias("x")).where(F.length("x.p") > 0)
    bases = got.groupBy("_rid").agg(F.upper(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["p"]), "")).alias(into))
    return rows.join(bases, F.col(rid) == F.col("_rid"), "left").drop("_rid")
