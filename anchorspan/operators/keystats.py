"""Per-key results where a few keys hold most rows.

Value-frequency compression: rows are grouped by (key, value) before anything is grouped by key, so a hot key
reaches the shuffle as its distinct values with their frequencies, spread over all tasks by value. Exact counts,
distinct counts, modes and percentiles then follow from the weighted values. No task ever holds the rows of one key.

Defined results: a null key has no row in any result; null values count in ``n_rows`` and in nothing else; NaN
counts as a value greater than any other; an empty input gives empty results; columns beside those named are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a natural logarithm's unit, and parts of such a part, into which the values of a key are put.
LOG_PARTS, FINE_PARTS = 512, 1024
_LOG_LEAST, _TOP = 746, 1 << 40


def compress(df: DataFrame, keys: dict[str, Column], value: Column) -> DataFrame:
    """(key columns..., value, freq): one row per distinct key and value. Rows with a null key are left out."""
    named = df.select(*[c.alias(k) for k, c in keys.items()], value.alias("value"))
    return named.dropna(subset=list(keys)).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("freq"))


def counts() -> list[Column]:
    """Aggregates over compressed rows of a key: n_rows, n_values (not null), n_distinct, and top, a struct of -frequency and value of the mode.

    Values are distinct within a key, so the distinct count is a plain sum and every aggregate has a map-side half.
    """
    known = F.col("value").isNotNull()
    return [
        F.sum("freq").alias("n_rows"), F.sum(F.when(known, F.col("freq")).otherwise(0)).alias("n_values"), F.count("value").alias("n_distinct"),
        F.min(F.when(known, F.struct((-F.col("freq")).alias("f"), F.col("value").alias("v")))).alias("top"),
    ]


def key_counts(compressed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: n_rows, n_values (not null), n_distinct, mode (of ties the smallest value) and mode_freq."""
    per = compressed.groupBy(*keys).agg(*counts())
    return per.select(*keys, "n_rows", "n_values", "n_distinct", F.col("top.v").alias("mode"), (-F.col("top.f")).alias("mode_freq"))


def hot_keys(counts: DataFrame, table_keys: Sequence[str], share: float) -> DataFrame:
    """The rows of counts (as from key_counts) that hold at least ``share`` of the rows of their table.

    ``table_keys`` name the part of the key that tells tables apart. Totals are one row per table: a join on a side
    whose size is the number of tables, never a window over all keys.
    """
    totals = counts.groupBy(*table_keys).agg(F.sum("n_rows").alias("table_rows"))
    return counts.join(totals, list(table_keys)).where(F.col("n_rows") / F.col("table_rows") >= F.lit(share))


def bucket_of(value: Column) -> Column:
    """A whole number that grows with the value: by its logarithm, and evenly within a part of that.

    Buckets are about two millionths of their values wide, wherever the values lie, so neither a huge outlier nor a narrow range
    puts the values of a key into few of them. NaN has the last one; null has that of zero.
    """
    v = value.cast("double")
    size = F.abs(v)
    part = F.floor((F.log(size) + _LOG_LEAST) * LOG_PARTS)
    low, high = F.exp(part / LOG_PARTS - _LOG_LEAST), F.exp((part + 1) / LOG_PARTS - _LOG_LEAST)
    fine = F.when((high > low) & (high < float("inf")), F.least(F.lit(FINE_PARTS - 1), F.greatest(F.lit(0), F.floor((size - low) / (high - low) * FINE_PARTS)))).otherwise(0)
    inner = F.when(size == 0, 0).when(size == float("inf"), _TOP).otherwise(part * FINE_PARTS + fine + 1)
    return F.coalesce(F.when(F.isnan(v), _TOP + 1).when(v < 0, -inner).otherwise(inner), F.lit(0)).cast("bigint")


def ranked(compressed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """compressed with ``upto``, the weight of the key's values up to and with this one, and ``n``, that of all; both null for a null value.

    Values are cut into buckets; a window sums within a bucket, another one over the buckets of a key (their sums have a map-side
    half), and both meet by (key, bucket), as which the rows lie already. A key's rows are spread over its buckets throughout.
    """
    keys = list(keys)
    known = F.col("value").isNotNull()
    rows = compressed.select(*keys, "value", "freq", bucket_of(F.col("value")).alias("bucket"), F.when(known, F.col("freq")).otherwise(0).alias("weight"))
    sums = rows.groupBy(*keys, "bucket").agg(F.sum("weight").alias("bucket_weight"))
    order = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.select(*keys, "bucket", (F.sum("bucket_weight").over(order) - F.col("bucket_weight")).alias("before"), F.sum("bucket_weight").over(Window.partitionBy(*keys)).alias("n"))
    within = Window.partitionBy(*keys, "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select(*keys, "bucket", "value", "freq", F.sum("weight").over(within).alias("inside"))
    met = rows.join(sums, [*keys, "bucket"])
    return met.select(*keys, "value", "freq", F.when(known, F.col("before") + F.col("inside")).alias("upto"), F.when(known, F.col("n")).alias("n"))


def percentile(p: float) -> Column:
    """An aggregate over ranked() rows of a key: the exact discrete percentile, the value at rank ceil(p * n) (1 at least)."""
    return F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * F.col("n"))), F.col("value")))


def percentiles(compressed: DataFrame, keys: Sequence[str], ps: Sequence[float]) -> DataFrame:
    """(keys..., p, percentile): the exact discrete percentiles of every key that has a value. Values must be numbers; NaN is taken as the largest."""
    keys = list(keys)
    at = ranked(compressed, keys).where(F.col("value").isNotNull()).groupBy(*keys).agg(*[percentile(p).alias(f"p{i}") for i, p in enumerate(ps)])
    return at.select(*keys, F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), F.col(f"p{i}").alias("percentile")) for i, p in enumerate(ps)])).alias("x")).select(*keys, "x.*")


def covered_parts(df: DataFrame, keys: dict[str, Column], start: Column, end: Column, bin_width: int = 1 << 20) -> DataFrame:
    """(keys..., covered): bases that the intervals [start, end) of a key cover, one row per bin; their sum is that of the key.

    Intervals are clipped to the bins they touch and compressed to the furthest end of each (key, bin, start), so neither the
    rows of a hot key nor the copies of a hot interval meet in one task; a bin then has at most bin_width of them.
    Intervals with a null key or end, or with end <= start, cover nothing.
    """
    names = list(keys)
    rows = df.select(*[c.alias(k) for k, c in keys.items()], start.cast("bigint").alias("s"), end.cast("bigint").alias("e"))
    rows = rows.dropna(subset=names).where(F.col("e") > F.col("s"))
    rows = rows.select(*names, "s", "e", F.explode(F.sequence(F.floor(F.col("s") / F.lit(bin_width)), F.floor((F.col("e") - 1) / F.lit(bin_width)))).alias("bin"))
    low, high = F.greatest(F.col("s"), F.col("bin") * bin_width), F.least(F.col("e"), (F.col("bin") + 1) * bin_width)
    furthest = rows.select(*names, "bin", low.alias("s"), high.alias("e")).groupBy(*names, "bin", "s").agg(F.max("e").alias("e"))
    earlier = F.max("e").over(Window.partitionBy(*names, "bin").orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
    new = furthest.select(*names, "bin", F.greatest(F.lit(0), F.col("e") - F.greatest("s", F.coalesce(earlier, F.col("s")))).alias("covered"))
    return new.groupBy(*names, "bin").agg(F.sum("covered").alias("covered")).drop("bin")


def covered_bases(df: DataFrame, keys: dict[str, Column], start: Column, end: Column, bin_width: int = 1 << 20) -> DataFrame:
    """(keys..., covered): bases of the union of the intervals [start, end) of a key that covers any."""
    return covered_parts(df, keys, start, end, bin_width).groupBy(*keys).agg(F.sum("covered").alias("covered"))
