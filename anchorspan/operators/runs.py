"""Runs of consecutive points with the same value: one record per run with its start, end and number of points.

The points of an entity are cut into chunks by position; a chunk is sorted within a task, its run starts are gathered
into a sorted array and its points are given to runs by binary search in it. Only what may go on over a chunk's border
(its first run, as long as no certain break has come, and its last one) is handed to a second pass, a stream over
a few rows per chunk. A hot entity is therefore spread over its chunks, and a chunk holds at most as many points as
it has positions.

A point continues the run if its value and the value of the run's FIRST point differ by less than ``tolerance`` and
its start is not greater than the largest end of the run so far.

Defined results: points with a null entity part, start or end are left out; a null or NaN value ends the run and joins
none; copies of a point (same id and start) count once; points of one start are taken in order of their id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anchorspan.session import ship

#: Positions in a chunk. A chunk is held in memory by one task, so this bounds its rows.
CHUNK = 1 << 20
FINAL, HEAD, BREAK, TAIL = 0, 1, 2, 3
_MIN = np.iinfo(np.int64).min
RUN_COLUMNS = ["entity", "chunk", "ord", "kind", "value", "run_start", "run_end", "n_points"]


def _fold(value: np.ndarray, start: np.ndarray, end: np.ndarray, tolerance: float) -> list[int]:
    """The places at which runs begin, by the rule itself, one point after the other."""
    begins, first, reach = [], 0.0, _MIN
    for i, (v, s, e) in enumerate(zip(value.tolist(), start.tolist(), end.tolist(), strict=True)):
        if begins and abs(v - first) < tolerance and s <= reach:
            reach = max(reach, e)
        else:
            begins.append(i)
            first, reach = v, e
    return begins


def chunk_runs(points: pd.DataFrame, tolerance: float) -> pd.DataFrame:
    """The runs of whole chunks. points: sorted by entity (a number), chunk, start, id; a marker row gives, as its end, how far earlier chunks reach."""
    entity, chunk = points["entity"].to_numpy(), points["chunk"].to_numpy()
    start, end, value = points["start"].to_numpy(), points["end"].to_numpy(), points["value"].to_numpy(dtype=np.float64, na_value=np.nan)
    marker = points["marker"].to_numpy(dtype=bool)
    new_chunk = np.ones(len(points), dtype=bool)
    new_chunk[1:] = (entity[1:] != entity[:-1]) | (chunk[1:] != chunk[:-1])
    group = np.cumsum(new_chunk) - 1
    # How far everything before a point reaches, earlier chunks included.
    reach = pd.Series(end).groupby(group).cummax().to_numpy()
    before = np.full(len(points), _MIN)
    before[1:] = np.where(new_chunk[1:], _MIN, reach[:-1])
    real = ~marker
    entity, chunk, start, end, value, before, group = (x[real] for x in (entity, chunk, start, end, value, before, group))
    n = len(start)
    if not n:
        return pd.DataFrame(columns=RUN_COLUMNS)
    first = np.ones(n, dtype=bool)
    first[1:] = group[1:] != group[:-1]
    null = np.isnan(value)
    with np.errstate(invalid="ignore"):
        jump = np.ones(n, dtype=bool)
        jump[1:] = ~(np.abs(value[1:] - value[:-1]) < 3 * tolerance)  # the run's first value is within tolerance of the last point's
    gap = start > before
    sure = np.where(first, gap, jump | gap) | null  # certainly the begin of something new, whatever came before
    segment_begin = sure | first
    seg = np.cumsum(segment_begin) - 1
    seg_first = np.flatnonzero(segment_begin)
    # Within a segment: an exact shortcut where all values are equal, else the fold.
    seg_reach = pd.Series(end).groupby(seg).cummax().to_numpy()
    inner_gap = np.zeros(n, dtype=bool)
    inner_gap[1:] = start[1:] > seg_reach[:-1]
    base = value[seg_first][seg]
    begin = segment_begin | (inner_gap & ~null)
    uneven = np.unique(seg[(value != base) & ~null])
    for k in uneven:
        lo, hi = seg_first[k], seg_first[k + 1] if k + 1 < len(seg_first) else n
        begin[lo:hi] = False
        begin[lo + np.array(_fold(value[lo:hi], start[lo:hi], end[lo:hi], tolerance))] = True
    # The head of a chunk: its first segment, if it is not sure to begin anew. It is cut into pieces of equal values
    # without a gap, which no later decision can part. (A gap in a stretch of equal values lies beyond all its ends.)
    in_head = np.isin(seg, np.unique(seg[first & ~sure]))
    if in_head.any():
        stretch_begin = segment_begin.copy()
        stretch_begin[1:] |= value[1:] != value[:-1]
        stretch_reach = pd.Series(end).groupby(np.cumsum(stretch_begin)).cummax().to_numpy()
        piece_begin = stretch_begin.copy()
        piece_begin[1:] |= start[1:] > stretch_reach[:-1]
        begin = np.where(in_head, piece_begin, begin)
    # Run starts as a sorted array; every point finds its run by binary search.
    run_first = np.flatnonzero(begin)
    run = np.searchsorted(run_first, np.arange(n), side="right") - 1
    frame = pd.DataFrame(
        {
            "entity": entity[run_first], "chunk": chunk[run_first], "value": value[run_first], "run_start": start[run_first],
            "run_end": np.maximum.reduceat(end, run_first), "n_points": np.bincount(run), "group": group[run_first], "head": in_head[run_first], "null": null[run_first],
        }
    )
    last = np.append(frame["group"].to_numpy()[1:] != frame["group"].to_numpy()[:-1], True)
    kind = np.where(frame["head"], HEAD, np.where(last, np.where(frame["null"], BREAK, TAIL), FINAL))
    kind = np.where((kind == FINAL) & frame["null"], -1, kind)
    frame["kind"], frame["ord"] = kind, np.arange(len(frame))
    return frame[frame["kind"] >= 0][RUN_COLUMNS]


def stitch(rows: pd.DataFrame, names: list[str], state: list | None, tolerance: float) -> tuple[list[list], list | None]:
    """Joins border rows in order of entity, chunk, ord. state: [entity, value, run_start, run_end, n_points], the open run."""
    done = []
    entities = zip(*(rows[k].tolist() for k in names), strict=True)
    for entity, kind, value, start, end, n in zip(entities, *(rows[c].tolist() for c in ("kind", "value", "run_start", "run_end", "n_points")), strict=True):
        if state is not None and kind == HEAD and state[0] == entity and abs(value - state[1]) < tolerance and start <= state[3]:
            state[3], state[4] = max(state[3], end), state[4] + n
            continue
        if state is not None:
            done.append(state)
        state = None if kind == BREAK else [entity, value, start, end, n]
    return done, state


def collapse_runs(
    df: DataFrame, entity: dict[str, Column], point_id: Column, start: Column, end: Column, value: Column, *, tolerance: float = 1e-10, chunk: int = CHUNK, min_points: int = 1
) -> DataFrame:
    """(entity columns..., run_start, run_end, n_points, run_value) of every run of at least min_points points.

    run_value is the value of the first point; the duration is run_end - run_start. Two shuffles: the points by
    (entity, chunk), and the runs, of which a few rows per chunk go by entity and all others stay spread by chunk.
    """
    ship(df.sparkSession)
    names = list(entity)
    rows = df.select(*[c.alias(k) for k, c in entity.items()], point_id.cast("bigint").alias("id"), start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), value.cast("double").alias("value"))
    rows = rows.dropna(subset=[*names, "start", "end", "id"])
    rows = rows.select(*names, F.floor(F.col("start") / F.lit(chunk)).alias("chunk"), F.lit(False).alias("marker"), "id", "start", "end", "value")
    reach = rows.groupBy(*names, "chunk").agg(F.max("end").alias("end"))
    earlier = F.max("end").over(Window.partitionBy(*names).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    markers = reach.select(*names, "chunk", F.lit(True).alias("marker"), F.lit(0).cast("bigint").alias("id"), (F.col("chunk") * chunk).alias("start"), earlier.alias("end"), F.lit(None).cast("double").alias("value"))
    markers = markers.where(F.col("end") >= F.col("start"))
    placed = rows.unionByName(markers).repartition(*names, "chunk").sortWithinPartitions(*names, "chunk", F.col("marker").desc(), "start", "id")

    def differs(block: pd.DataFrame, columns: list[str]) -> np.ndarray:
        """Whether a row differs from the one before it in any of the columns."""
        out = np.zeros(len(block), dtype=bool)
        out[:1] = True
        for c in columns:
            x = block[c].to_numpy()
            out[1:] |= x[1:] != x[:-1]
        return out

    def runs(block: pd.DataFrame) -> pd.DataFrame:
        block = block[differs(block, [*names, "marker", "start", "id"])]
        code = np.cumsum(differs(block, names)) - 1
        firsts = block[names].iloc[np.flatnonzero(np.diff(code, prepend=-1))].reset_index(drop=True)
        out = chunk_runs(block.assign(entity=code), tolerance)
        out = out[(out["kind"] != FINAL) | (out["n_points"] >= min_points)]
        named = firsts.take(out["entity"].to_numpy(dtype=np.int64)).reset_index(drop=True)
        return pd.concat([named, out.drop(columns="entity").reset_index(drop=True)], axis=1)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size < 50_000:
                continue
            block = pd.concat(held, ignore_index=True)
            begins = np.flatnonzero(differs(block, [*names, "chunk"]))
            if begins[-1]:
                yield runs(block.iloc[: begins[-1]])
                block = block.iloc[begins[-1] :]
            held, size = [block], 0  # the end of this chunk is looked for after as many rows again
        if held:
            yield runs(pd.concat(held, ignore_index=True))

    kinds = {f.name: f.dataType for f in rows.schema}
    keys = [T.StructField(k, kinds[k]) for k in names]
    run = [T.StructField("value", T.DoubleType()), *[T.StructField(c, T.LongType()) for c in ("run_start", "run_end", "n_points")]]
    found = placed.mapInPandas(find, T.StructType([*keys, T.StructField("chunk", T.LongType()), T.StructField("ord", T.LongType()), T.StructField("kind", T.IntegerType()), *run]))
    place = F.when(F.col("kind") == FINAL, F.col("chunk")).otherwise(-1)
    gathered = found.withColumn("place", place).repartition(*names, "place").sortWithinPartitions(*names, "place", "chunk", "ord")
    columns = [*names, "value", "run_start", "run_end", "n_points"]

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for batch in batches:
            yield batch.loc[batch["kind"] == FINAL, columns]
            done, state = stitch(batch[batch["kind"] != FINAL], names, state, tolerance)
            if done:
                yield pd.DataFrame([[*x[0], *x[1:]] for x in done], columns=columns)
        if state is not None:
            yield pd.DataFrame([[*state[0], *state[1:]]], columns=columns)

    closed = gathered.mapInPandas(close, T.StructType([*keys, *run]))
    return closed.where(F.col("n_points") >= min_points).select(*names, "run_start", "run_end", "n_points", F.col("value").alias("run_value"))
