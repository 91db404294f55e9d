"""Differences between two copies of a table.

Content-defined chunking: of each copy, cut to its newest row per key, only key, key hash and row hash go on to the chunker, where
rows of equal keys meet in order of the key. A chunk ends where a rolling hash of the last keys meets a condition, so
equal content is cut alike however many rows went missing before it. A chunk has a fingerprint of all its rows; chunks whose
fingerprint the other copy has are done (the anti-join of fingerprints is a set test, as both lie together), and only
for the keys of the rest are the fields fetched and compared, one by one, by JVM-side expressions.

Defined results: rows with a null key are left out (nothing can be matched to them); of several rows of a key the one
with the latest order value holds, ties broken by the largest field values; null equals null and differs from any
value; an empty copy makes every key of the other one missing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorspan.session import ship

#: A chunk ends where the rolling hash is 0 modulo this; chunks have about so many rows.
CHUNK_ROWS = 64
#: Keys that the rolling hash spans.
ROLL = 4
#: Rows of a partition whose chunks are compared at once; a limit of memory, no limit of the result.
BLOCK_ROWS = 100_000


def newest(df: DataFrame, key: Column, fields: dict[str, Column], order: Column) -> DataFrame:
    """(key, fields...): per key the row with the largest order value. A map-side half takes copies of a hot key together."""
    packed = F.struct(order.alias("o"), *[c.alias(f) for f, c in fields.items()])
    rows = df.select(key.alias("key"), packed.alias("x")).where(F.col("key").isNotNull())
    return rows.groupBy("key").agg(F.max("x").alias("x")).select("key", *[F.col(f"x.{f}").alias(f) for f in fields])


def chunk_ids(keys: np.ndarray, chunk_rows: int = CHUNK_ROWS, roll: int = ROLL) -> np.ndarray:
    """The chunk number of each row: a chunk ends after a row at which the rolling sum of mixed key hashes is 0 modulo chunk_rows."""
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    rolled = np.zeros(len(keys), dtype=np.uint64)
    for back in range(min(roll, len(keys))):
        rolled[back:] += mixed[: len(keys) - back] * np.uint64(2 * back + 1)
    ends = (rolled >> np.uint64(7)) % np.uint64(chunk_rows) == 0
    return np.concatenate(([0], np.cumsum(ends)[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)


def fingerprints(keys: np.ndarray, rows: np.ndarray, chunk_rows: int = CHUNK_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """The chunk number of each row, and of each chunk a fingerprint of its row hashes and their order. Rows are sorted by key."""
    ids = chunk_ids(keys, chunk_rows)
    firsts = np.flatnonzero(np.diff(ids, prepend=-1))
    rows = rows.astype(np.uint64)
    place = (2 * (np.arange(len(ids)) - firsts[ids]) + 3).astype(np.uint64)
    out = np.empty(len(firsts), dtype=[("a", np.uint64), ("b", np.uint64), ("n", np.int64)])
    out["a"] = np.add.reduceat(rows * place, firsts)
    out["b"] = np.add.reduceat((rows ^ (rows >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) * place, firsts)
    out["n"] = np.diff(firsts, append=len(ids))
    return ids, out


def unmatched(side: np.ndarray, keys: np.ndarray, rows: np.ndarray, chunk_rows: int = CHUNK_ROWS) -> np.ndarray:
    """Mask of the rows whose chunk's fingerprint the other side lacks. side is 0 or 1; the rows of each are sorted by key."""
    out = np.ones(len(side), dtype=bool)
    places = [np.flatnonzero(side == k) for k in (0, 1)]
    if all(len(p) for p in places):
        (ids_a, a), (ids_b, b) = (fingerprints(keys[p], rows[p], chunk_rows) for p in places)
        out[places[0]], out[places[1]] = ~np.isin(a, b)[ids_a], ~np.isin(b, a)[ids_b]
    return out


def open_keys(left: DataFrame, right: DataFrame, fields: Sequence[str], *, partitions: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(key): the keys of all chunks without a counterpart, each once. A key that it lacks has equal rows on both sides."""
    ship(left.sparkSession)

    def side(df: DataFrame, mark: int) -> DataFrame:
        row = [F.col("key"), *[c for f in fields for c in (F.col(f).isNull(), F.coalesce(F.col(f).cast("string"), F.lit("")))]]
        return df.where(F.col("key").isNotNull()).select("key", F.lit(mark).cast("byte").alias("side"), F.xxhash64(*row).alias("row_hash"))

    both = side(left, 0).unionByName(side(right, 1))
    placed = both.repartition(partitions, "key") if partitions else both.repartition("key")
    ordered = placed.sortWithinPartitions("key", "side").select("key", "side", F.xxhash64("key").alias("key_hash"), "row_hash")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def found(block: pa.Table) -> pa.RecordBatch:
            number = [block.column(c).to_numpy() for c in ("side", "key_hash", "row_hash")]
            open_rows = np.flatnonzero(unmatched(*number, chunk_rows))
            keys = block.column("key").combine_chunks().take(pa.array(open_rows))
            if len(keys) > 1:  # a key has two rows at most, one after the other
                keys = keys.filter(pa.array(np.append(True, pa.compute.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False))))
            return pa.RecordBatch.from_arrays([keys], names=["key"])

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= BLOCK_ROWS:
                block = pa.Table.from_batches(held)
                last = block.column("key")[-1]
                cut = count - sum(block.column("key")[k] == last for k in (-1, -2) if count >= -k)
                yield found(block.slice(0, cut))
                held, count = block.slice(cut).to_batches(), count - cut
        if count:
            yield found(pa.Table.from_batches(held))

    return ordered.mapInArrow(scan, "key string")


def diff(
    left: DataFrame, right: DataFrame, fields: Sequence[str], tolerance: dict[str, int] | None = None, *, partitions: int | None = None, missing: tuple[str, str] = ("missing_in_left", "missing_in_right"), chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """(key string, diff_kind string, left_value string, right_value string) of two tables (key, fields...) with unique keys.

    diff_kind is missing[0] for a key only in right, missing[1] for a key only in left, else the differing field.
    Fields in ``tolerance`` are numbers that differ if they are more than so far apart.
    """
    tolerance, fields = tolerance or {}, list(fields)
    sides = [df.where(F.col("key").isNotNull()).select("key", F.struct(*[F.col(f).cast("bigint" if f in tolerance else "string").alias(f) for f in fields]).alias(x)) for df, x in ((left, "l"), (right, "r"))]
    rows = open_keys(left, right, fields, partitions=partitions, chunk_rows=chunk_rows)
    for s in sides:
        rows = rows.join(s, "key", "left")
    none = F.lit(None).cast("string")

    def entry(kind: str, a: Column = none, b: Column = none) -> Column:
        return F.struct(F.lit(kind).alias("diff_kind"), a.alias("left_value"), b.alias("right_value"))

    differing = []
    for f in fields:
        a, b = F.col(f"l.{f}"), F.col(f"r.{f}")
        same = a.eqNullSafe(b)
        if f in tolerance:
            same |= F.coalesce(F.abs(a - b) <= tolerance[f], F.lit(False))
        differing.append(F.when(~same, entry(f, a.cast("string"), b.cast("string"))))
    kinds = F.when(F.col("l").isNull(), F.array(entry(missing[0]))).when(F.col("r").isNull(), F.array(entry(missing[1]))).otherwise(F.filter(F.array(*differing), lambda x: x.isNotNull()))
    return rows.select("key", F.explode(kinds).alias("x")).select("key", "x.*")
