"""Text lines with an order that holds over files and splits, and state carried over them.

A file may be cut into splits that different tasks read. Windows here run over the lines of one split; what goes on from
one split into the next is carried by a second window over one row per split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The columns that give a line its place.
ORDER = ["file", "block", "at"]


def read(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, at, line): lines of plain or .gz/.bz2 text, parted by \\n, without a closing \\r. Undecodable bytes become U+FFFD."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r\\z", "").alias("line")
    )


def from_rows(spark: SparkSession, lines: list[str]) -> DataFrame:
    """The same columns for lines in hand."""
    return spark.createDataFrame([("", 0, i, x) for i, x in enumerate(lines)], "file string, block bigint, at bigint, line string")


def carried(rows: DataFrame, begins: str, size: str, state: list[str]) -> DataFrame:
    """rows with the state of the group they belong to and ``before``, the sum of ``size`` since the group began.

    A group begins at each row where the boolean column ``begins`` is true, which also holds the group's ``state``
    columns; before the first one the state is null. Adds the columns before, started and the state as carried_<name>.
    """
    split = ["file", "block"]
    order = Window.partitionBy(*split).orderBy("at")
    marked = rows.withColumn("_g", F.sum(F.col(begins).cast("int")).over(order))
    group = Window.partitionBy(*split, "_g")
    local = marked.select("*", (F.sum(size).over(group.orderBy("at")) - F.col(size)).alias("_local"), F.max(F.when(F.col(begins), F.struct(*state))).over(group).alias("_own"))
    ends = marked.groupBy(*split).agg(F.max("_g").alias("last_g"), F.max_by(F.when(F.col(begins), F.struct(*state)), F.when(F.col(begins), F.col("at"))).alias("last"))
    tails = marked.groupBy(*split, "_g").agg(F.sum(size).alias("tail"))
    ends = ends.join(tails, [*split]).where(F.col("_g") == F.col("last_g"))
    by_file = Window.partitionBy("file").orderBy("block")
    ends = ends.withColumn("seg", F.sum((F.col("last_g") > 0).cast("int")).over(by_file))
    ends = ends.withColumn("upto", F.sum("tail").over(Window.partitionBy("file", "seg").orderBy("block"))).withColumn("known", F.last("last", ignorenulls=True).over(by_file))
    into = ends.select(*split, F.lag("upto", 1, 0).over(by_file).alias("_into"), F.lag("known").over(by_file).alias("_held"))
    joined = local.join(into, split)
    first = F.col("_g") == 0
    held = F.when(first, F.col("_held")).otherwise(F.col("_own"))
    out = joined.withColumn("before", F.col("_local") + F.when(first, F.coalesce("_into", F.lit(0))).otherwise(0)).withColumn("_state", held)
    return out.select(*rows.columns, "before", F.col("_state").isNotNull().alias("started"), *[F.col(f"_state.{s}").alias(f"carried_{s}") for s in state])
