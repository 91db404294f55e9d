"""The lift: records against alignment blocks, and the coordinates of what they share on the target.

Two physical forms with one result. Where the blocks are few enough to be sent to every worker (their rows are counted),
segments() computes an array of segments for each record in a vectorised lookup: binary search in sorted block arrays,
no shuffle, and only four columns leave the JVM. Beyond that bound lift_join() joins by position bins, which keeps hot
chromosomes spread, and with_segments() gathers its rows per record.

A segment is struct<seq, s_start, s_end, t_chrom, t_start, t_end, t_strand>; segments of a record are in order of the
source start and end of their blocks, then of the blocks' place in the chain file. A null array says that the
chromosome is unknown, an empty one that nothing overlaps; a null or turned interval has an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorspan.functions import chrom as names
from anchorspan.operators.intervals import BIN, interval_join
from anchorspan.session import BROADCAST_ROWS, ship

#: Blocks that are sent to every worker at most (about 60 bytes each).
MAX_SENT = 500_000
#: Entries of a level that one of the next level covers; and so many blocks are tried one by one.
FAN_BITS = 3
FAN, FEW = 1 << FAN_BITS, 32
SEGMENT = "struct<seq:int,s_start:bigint,s_end:bigint,t_chrom:string,t_start:bigint,t_end:bigint,t_strand:string>"


def candidates(name: str) -> list[str]:
    """Spellings under which a name is looked for once neither itself nor its alias is known, in order."""
    return [name.replace("chr", ""), name.replace("Chr", ""), name.replace("CHR", ""), "chr" + name, "Chr" + name]


def alias(name: str) -> str:
    return name.lower().removeprefix("chr")


class Resolver:
    """Finds the chain's name of a chromosome: itself, else by its alias, else by other spellings.

    Of several chain names with one alias the smallest is taken.
    """

    def __init__(self, known: Iterable[str]):
        self.known = set(known)
        self.by_alias: dict[str, str] = {}
        for name in sorted(self.known):
            self.by_alias.setdefault(alias(name), name)

    def __call__(self, name: str | None) -> str | None:
        if name is None or name in self.known:
            return name
        return self.by_alias.get(alias(name)) or next((c for c in candidates(name) if c in self.known), None)


def prefixed(name: str) -> bool:
    return len(name) > 3 and name[:3].lower() == "chr"


def styled(name: str, style: str) -> str:
    bare = name[3:] if prefixed(name) else name
    return {"a": name, "s": bare, "l": "chr" + bare}[style]


class BlockIndex:
    """Blocks as sorted arrays, per chromosome. Picklable; lives once in a worker."""

    def __init__(self, rows: pa.Table):
        rows = rows.flatten()  # a block_id of several parts becomes several columns
        order = rows.sort_by([(c, "ascending") for c in ["source_chrom", "source_start", "source_end", *[c for c in rows.column_names if c.split(".")[0] == "block_id"]]])
        number = lambda c: order.column(c).to_numpy()
        self.start, self.end, self.t_start, self.t_end = (number(c) for c in ("source_start", "source_end", "target_start", "target_end"))
        self.minus = np.array(order.column("target_strand").to_pylist(), dtype=object) == "-"
        chroms = np.array(order.column("source_chrom").to_pylist(), dtype=object)
        targets = order.column("target_chrom").to_pylist()
        self.targets = sorted(set(targets))
        place = {t: i for i, t in enumerate(self.targets)}
        self.target = np.array([place[t] for t in targets], dtype=np.int64)
        first = np.flatnonzero(np.append(True, chroms[1:] != chroms[:-1])) if len(chroms) else np.zeros(0, dtype=np.int64)
        bounds = [*first.tolist(), len(chroms)]
        self.span = {chroms[a]: (a, b) for a, b in zip(bounds, bounds[1:], strict=False)}
        self.reach = self.end.copy()
        for a, b in self.span.values():
            self.reach[a:b] = np.maximum.accumulate(self.end[a:b])
        self.peaks = [self.end]  # each level holds the largest end of FAN entries of the level below
        while len(self.peaks[-1]) > FAN:
            self.peaks.append(np.maximum.reduceat(self.peaks[-1], np.arange(0, len(self.peaks[-1]), FAN)))
        self.resolve = Resolver(self.span)

    def overlaps(self, chrom: list[str | None], start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known, query, block): whether each chromosome is known, and the overlapping pairs in order of query and block."""
        known = np.zeros(len(chrom), dtype=bool)
        code: dict[str | None, int] = {}
        codes = np.fromiter((code.setdefault(c, len(code)) for c in chrom), dtype=np.int64, count=len(chrom))
        low, high = np.zeros(len(chrom), dtype=np.int64), np.zeros(len(chrom), dtype=np.int64)
        for name, k in code.items():
            found = self.resolve(name)
            if found is None:
                continue
            rows = np.flatnonzero(codes == k)
            known[rows] = True
            a, b = self.span[found]
            low[rows] = a + np.searchsorted(self.reach[a:b], start[rows], side="right")
            high[rows] = a + np.searchsorted(self.start[a:b], end[rows], side="left")
        count = np.where(end >= start, np.maximum(0, high - low), 0)
        few = np.where(count <= FEW, count, 0)
        query = np.repeat(np.arange(len(chrom)), few)
        block = np.arange(len(query)) - np.repeat(np.cumsum(few) - few, few) + low[query]
        hit = self.end[block] > start[query]
        query, block = query[hit], block[hit]
        if (wide := np.flatnonzero(count > FEW)).size:
            more = self._descend(wide, low, high, start)
            query, block = np.concatenate((query, more[0])), np.concatenate((block, more[1]))
            order = np.lexsort((block, query))
            query, block = query[order], block[order]
        return known, query, block

    def _descend(self, query: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, block) of the blocks from low to high whose end lies beyond start.

        Goes down the levels of largest ends and leaves out every part without such a block, so the work grows with what is
        found and not with what lies between, however the blocks are nested.
        """
        shift = FAN_BITS * (len(self.peaks) - 1)
        first, count = low[query] >> shift, ((high[query] - 1) >> shift) - (low[query] >> shift) + 1
        node = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - first, count)
        query = np.repeat(query, count)
        for level in range(len(self.peaks) - 1, -1, -1):
            reaches = self.peaks[level][node] > start[query]
            query, node = query[reaches], node[reaches]
            if level:
                shift -= FAN_BITS
                query, node = np.repeat(query, FAN), (node[:, None] * FAN + np.arange(FAN)).ravel()
                inside = (node >= low[query] >> shift) & (node <= (high[query] - 1) >> shift)
                query, node = query[inside], node[inside]
        return query, node

    def segments(self, chrom: list[str | None], start: np.ndarray, end: np.ndarray, minus: np.ndarray, style: str) -> pa.ListArray:
        known, query, block = self.overlaps(chrom, start, end)
        s_start, s_end = np.maximum(start[query], self.start[block]), np.minimum(end[query], self.end[block])
        size, turned = s_end - s_start, self.minus[block]
        offset = s_start - self.start[block]
        t_start = np.where(turned, self.t_end[block] - offset - size, self.t_start[block] + offset)
        count = np.bincount(query, minlength=len(chrom))
        seq = np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
        if style == "a":  # with or without prefix, as the record has it: each target name in both forms
            forms = [t[3:] if prefixed(t) else t for t in self.targets] + [t if prefixed(t) else "chr" + t for t in self.targets]
            habit = np.fromiter((c is not None and prefixed(c) for c in chrom), dtype=bool, count=len(chrom))
            pick = self.target[block] + habit[query] * len(self.targets)
        else:
            forms, pick = [styled(t, style) for t in self.targets], self.target[block]
        fields = {
            "seq": pa.array(seq.astype(np.int32)), "s_start": pa.array(s_start), "s_end": pa.array(s_end), "t_chrom": pa.array(forms, type=pa.string()).take(pa.array(pick)),
            "t_start": pa.array(t_start), "t_end": pa.array(t_start + size), "t_strand": pa.array(["+", "-"]).take(pa.array((minus[query] != turned).astype(np.int8))),
        }
        values = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
        offsets = pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32), mask=np.append(~known, False))
        return pa.ListArray.from_arrays(offsets, values)


class Lifter:
    """Blocks and naming style, with the choice of the physical form made once from their counted size.

    blocks: DataFrame (block_id, source_chrom, source_start, source_end, target_chrom, target_start, target_end, target_strand).
    compat_mode is kept and has no effect on any result.
    """

    def __init__(self, blocks: DataFrame, style: str = "a", *, max_sent: int = MAX_SENT, width: int = BIN, compat_mode: str = "improved"):
        self.blocks, self.style, self.width, self.compat_mode = blocks, names.parse_style(style), width, compat_mode
        self.spark: SparkSession = blocks.sparkSession
        self.sent, self._names = None, None
        ship(self.spark)
        rows = blocks.limit(max(0, max_sent) + 1).toArrow()  # counted and taken in one job
        if rows.num_rows <= max_sent:
            self.index = BlockIndex(rows)
            self.sent = self.spark.sparkContext.broadcast(self.index)

    def segments(self, chrom: Column, start: Column, end: Column, strand: Column) -> Column:
        """array<SEGMENT> of each record; only where the blocks are sent to the workers."""
        if self.sent is None:
            raise ValueError("too many blocks for this form; use with_segments()")
        sent, style = self.sent, self.style

        @F.arrow_udf(f"array<{SEGMENT}>")
        def lift(c: pa.Array, s: pa.Array, e: pa.Array, d: pa.Array) -> pa.Array:
            missing = np.logical_or(s.is_null().to_numpy(zero_copy_only=False), e.is_null().to_numpy(zero_copy_only=False))
            starts, ends = (x.fill_null(0).to_numpy(zero_copy_only=False) for x in (s, e))
            minus = np.array(pa.compute.equal(d, "-").fill_null(False).to_numpy(zero_copy_only=False))
            return sent.value.segments(c.to_pylist(), np.where(missing, 1, starts), np.where(missing, 0, ends), minus, style)

        return lift(chrom, start.cast("bigint"), end.cast("bigint"), strand.cast("string"))

    def with_span_segments(self, records: DataFrame, rid: str, chrom: Column, spans: Column, strand: Column, name: str) -> DataFrame:
        """records with a column array<array<SEGMENT>>: the segments of each of its spans (array<struct<s, e>>); null for null spans."""
        if self.sent is not None:
            sent, style = self.sent, self.style

            @F.arrow_udf(f"array<array<{SEGMENT}>>")
            def lift(c: pa.Array, x: pa.Array, d: pa.Array) -> pa.Array:
                size = pa.compute.list_value_length(x).fill_null(0).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(x)), size)
                flat = x.flatten()
                s, e = (flat.field(k).fill_null(0).to_numpy(zero_copy_only=False) for k in ("s", "e"))
                minus = np.array(pa.compute.equal(d, "-").fill_null(False).to_numpy(zero_copy_only=False))
                inner = sent.value.segments(c.take(pa.array(row)).to_pylist(), s, e, minus[row], style)
                offsets = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32), mask=np.append(x.is_null().to_numpy(zero_copy_only=False), False))
                return pa.ListArray.from_arrays(offsets, inner)

            return records.withColumn(name, lift(chrom, spans, strand.cast("string")))
        keyed = records.select(rid, chrom.alias("_c"), strand.alias("_d"), F.posexplode(spans).alias("_i", "_x")).withColumn("_part", F.struct(rid, "_i"))
        lifted = self.with_segments(keyed, "_part", F.col("_c"), F.col("_x.s"), F.col("_x.e"), F.col("_d"), "_g")
        gathered = lifted.groupBy(rid).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", F.col("_g").isNull().alias("none"), F.coalesce("_g", F.array().cast(f"array<{SEGMENT}>")).alias("g")))), lambda x: F.when(~x["none"], x["g"])).alias(name))
        return records.join(gathered, rid, "left")

    def with_segments(self, records: DataFrame, rid: str, chrom: Column, start: Column, end: Column, strand: Column, name: str = "segments") -> DataFrame:
        """records with a column of their segments. rid: a column that is unique, needed by the join form alone."""
        if self.sent is not None:
            return records.withColumn(name, self.segments(chrom, start, end, strand))
        keyed = records.select(rid, chrom.alias("q_chrom"), start.cast("bigint").alias("q_start"), end.cast("bigint").alias("q_end"), strand.cast("string").alias("q_strand"))
        names_known = self._names = self._names or ChainNames(self.blocks)
        rows = lift_join(keyed, self.blocks, self.style, self.width, known=names_known)
        order = ["s_start0", "s_end0", "block_id"]
        parts = ["s_start", "s_end", "t_chrom", "t_start", "t_end", "t_strand"]
        sorted_rows = F.array_sort(F.collect_list(F.struct(*order, *parts)))
        packed = F.transform(sorted_rows, lambda x, i: F.struct(i.cast("int").alias("seq"), *[x[p].alias(p) for p in parts]))
        gathered = rows.groupBy(rid).agg(packed.alias("_found"))
        joined = names_known.resolve(records.withColumn("_name", chrom), "_name", "_known").join(gathered, rid, "left")
        none = F.array().cast(f"array<{SEGMENT}>")
        return joined.withColumn(name, F.when(F.col("_known").isNotNull(), F.coalesce("_found", none))).drop("_found", "_name", "_known")


class ChainNames:
    """The source names of blocks, by which record names are resolved.

    The names are counted over the blocks alone: where they are few, as of assemblies, they go to the workers and no record
    is moved; beyond that the distinct names of the records are resolved by joins.
    """

    def __init__(self, blocks: DataFrame):
        self.blocks = blocks
        known = blocks.select("source_chrom").distinct().limit(BROADCAST_ROWS + 1).toArrow().column(0).to_pylist()
        self.sent = blocks.sparkSession.sparkContext.broadcast(Resolver(known)) if len(known) <= BROADCAST_ROWS else None

    def resolve(self, records: DataFrame, name: str, into: str) -> DataFrame:
        """records with the chain's name of the column ``name``; null for none."""
        if self.sent is None:
            mapping = resolved_names(records, self.blocks, name).select(F.col("q_chrom").alias("_q"), F.col("source_chrom").alias(into))
            return records.join(mapping, F.col(name) == F.col("_q"), "left").drop("_q")
        sent = self.sent

        @F.arrow_udf("string")
        def found(c: pa.Array) -> pa.Array:
            coded = c.dictionary_encode()
            return pa.array([sent.value(x) if sent.value(x) in sent.value.known else None for x in coded.dictionary.to_pylist()], type=pa.string()).take(coded.indices)

        return records.withColumn(into, found(F.col(name)))


def combined_strand(a: Column, b: Column) -> Column:
    """The strand of a record on one side of an alignment that has another strand: + if they agree. A missing strand is +."""
    return F.when(F.coalesce(a == "-", F.lit(False)) != F.coalesce(b == "-", F.lit(False)), "-").otherwise("+")


def resolved_names(records: DataFrame, blocks: DataFrame, name: str = "q_chrom") -> DataFrame:
    """(q_chrom, source_chrom): the chain's name of every record chromosome that has one. One row per distinct name."""
    asked = records.select(F.col(name).alias("q_chrom")).distinct()
    known = blocks.select("source_chrom").distinct()
    q = F.col("q_chrom")
    tries = [q, F.lit(None).cast("string"), *[F.replace(q, F.lit(x), F.lit("")) for x in ("chr", "Chr", "CHR")], F.concat(F.lit("chr"), q), F.concat(F.lit("Chr"), q)]
    exact = asked.select("q_chrom", F.posexplode(F.array(*tries)).alias("rank", "source_chrom")).join(known, "source_chrom")
    aliased = known.groupBy(names.alias_key(F.col("source_chrom")).alias("a")).agg(F.min("source_chrom").alias("source_chrom"))
    by_alias = asked.withColumn("a", names.alias_key(q)).join(aliased, "a").select("q_chrom", F.lit(1).alias("rank"), "source_chrom")
    return exact.select("q_chrom", "rank", "source_chrom").unionByName(by_alias).groupBy("q_chrom").agg(F.min_by("source_chrom", "rank").alias("source_chrom"))


def lift_join(records: DataFrame, blocks: DataFrame, style: str = "a", width: int = BIN, small_blocks: bool | None = False, known: ChainNames | None = None) -> DataFrame:
    """One row per record and overlapping block, by the binned join: the columns of records, s_start0, s_end0, block_id
    (the block, for order), s_start, s_end, t_chrom, t_start, t_end, t_strand.

    records needs q_chrom, q_start, q_end, q_strand.
    """
    placed = (known or ChainNames(blocks)).resolve(records, "q_chrom", "_s").where(F.col("_s").isNotNull())
    pairs = interval_join(placed, blocks, ["_s", "q_start", "q_end"], ["source_chrom", "source_start", "source_end"], width=width, small_right=small_blocks)
    return pairs.select(*records.columns, *projected(style)).where("s_end >= s_start")


def projected(style: str) -> list[Column]:
    """The target coordinates of a joined record and block."""
    s, e = F.greatest("q_start", "source_start"), F.least("q_end", "source_end")
    turned = F.col("target_strand") == "-"
    start = F.when(turned, F.col("target_end") - (s - F.col("source_start")) - (e - s)).otherwise(F.col("target_start") + s - F.col("source_start"))
    target = names.follow_habit(F.col("target_chrom"), F.col("q_chrom")) if style == "a" else names.apply_style(F.col("target_chrom"), style)
    return [
        F.col("source_start").alias("s_start0"), F.col("source_end").alias("s_end0"), "block_id", s.alias("s_start"), e.alias("s_end"), target.alias("t_chrom"),
        start.alias("t_start"), (start + e - s).alias("t_end"), combined_strand(F.col("q_strand"), F.col("target_strand")).alias("t_strand"),
    ]
