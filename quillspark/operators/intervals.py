"""Union of speech intervals and greedy planning of decoder chunks."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLACK = 1e-6
MOST_CHUNKS = 1_000_000


def union_intervals(speech: DataFrame, *keys: str, start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Merged regions of each key; intervals that touch merge.

    A region begins where an interval starts behind the end of all earlier ones: a running maximum and a
    running count over one sort of the key's intervals.
    """
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(end).over(before)
    marked = speech.withColumn("__new", (reach.isNull() | (F.col(start) > reach)).cast("int"))
    numbered = marked.withColumn("region", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "region").agg(F.min(start).alias(start), F.max(end).alias(end))


def check_plan(max_chunk_s: float, pad_s: float, max_chunks: int) -> float:
    """The longest core of a chunk."""
    if max_chunk_s < 0 or pad_s < 0 or isinstance(max_chunks, bool) or not 1 <= max_chunks <= MOST_CHUNKS:
        raise ValueError(f"max_chunk_s and pad_s must not be negative, max_chunks between 1 and {MOST_CHUNKS}")
    core = max_chunk_s - 2 * pad_s
    if core <= 0:
        raise ValueError("the padding leaves no room in a chunk")
    return core


def invalid_interval(start: Column, end: Column) -> Column:
    """Whether an interval lacks a bound, begins before zero, or doesn't end behind its start."""
    finite = [x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) for x in (start, end)]
    return ~F.coalesce(finite[0] & finite[1] & (start >= 0) & (end > start), F.lit(False))


def _unions(spans: Iterable[tuple[float, float]]) -> Iterator[tuple[float, float]]:
    """Regions of intervals in order of start."""
    region: tuple[float, float] | None = None
    for lo, hi in spans:
        if region and lo <= region[1]:
            region = region[0], max(region[1], hi)
        else:
            if region:
                yield region
            region = lo, hi
    if region:
        yield region


def _packs(regions: Iterable[tuple[float, float]], core: float) -> Iterator[tuple[float, float, bool]]:
    """(start, end, forced) of chunks: the break before a region is decided by the chunk that is open there."""
    begin: float | None = None
    last = 0.0
    for lo, hi in regions:
        if begin is not None and (hi - lo > core or hi - begin > core):
            yield begin, last, False
            begin = None
        if hi - lo > core:
            parts = math.ceil((hi - lo) / core)
            width = (hi - lo) / parts
            edges = itertools.chain((lo + k * width for k in range(parts)), [hi])
            yield from ((a, b, True) for a, b in itertools.pairwise(edges))
        else:
            begin, last = lo if begin is None else begin, hi
    if begin is not None:
        yield begin, last, False


def plan_chunks(
    speech: DataFrame,
    *keys: str,
    max_chunk_s: float = 28.0,
    pad_s: float = 0.0,
    duration: str | None = None,
    max_chunks: int = 100_000,
    start: str = "start_s",
    end: str = "end_s",
) -> DataFrame:
    """(keys, chunk, start, end, forced_split): speech packed greedily into chunks of at most max_chunk_s.

    Touching intervals are one region.  A region longer than the core (max_chunk_s less both pads) is cut into equal
    forced pieces; others join the open chunk while it stays within the core.  Pads are clamped to the recording,
    whose length the column `duration` may give.  Speech without 0 <= start < end, or beyond its recording, is an error.

    Greedy packing is sequential: rows are dealt by recording, sorted, and each task streams over its recordings
    holding one region and one chunk, so neither a long recording nor many of them need memory.
    """
    core = check_plan(max_chunk_s, pad_s, max_chunks)
    lo, hi = F.col(start).cast("double"), F.col(end).cast("double")
    checked = F.when(invalid_interval(lo, hi), F.raise_error(F.lit("speech needs 0 <= start < end")))
    if duration:
        checked = checked.when(hi > F.col(duration) + SLACK, F.raise_error(F.lit("speech ends beyond the recording")))
    limit = F.col(duration).cast("double") if duration else F.lit(None).cast("double")
    given = speech.select(*keys, lo.alias("__lo"), checked.otherwise(hi).alias("__hi"), limit.alias("__limit"))
    ordered = given.repartition(*keys).sortWithinPartitions(*keys, "__lo", "__hi")
    schema = given.select(*keys).schema.add("chunk", "integer").add(start, "double").add(end, "double").add("forced_split", "boolean")
    width = len(keys)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def padded(key: tuple, own: Iterator[tuple]) -> Iterator[tuple]:
        first = next(own)
        longest = first[width + 2]
        spans = ((r[width], r[width + 1]) for r in itertools.chain([first], own))
        for number, (a, b, forced) in enumerate(_packs(_unions(spans), core)):
            if number >= max_chunks:
                raise ValueError("more chunks than max_chunks")
            a, b = max(0.0, a - pad_s), b + pad_s
            b = b if longest is None else min(b, longest)
            if not 0 < b - a <= max_chunk_s + SLACK:
                raise ValueError("a chunk is empty or too long")
            yield *key, number, a, b, forced

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def seen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds[:] = batch.schema.types[:width]
                yield batch

        grouped = itertools.groupby(rows(seen()), key=lambda r: r[:width])
        made = itertools.chain.from_iterable(padded(key, own) for key, own in grouped)
        while part := list(itertools.islice(made, 10_000)):
            types = [*kinds, pa.int32(), pa.float64(), pa.float64(), pa.bool_()]
            columns = [pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return ordered.mapInArrow(run, schema)


def real_time_factor(elapsed: Column, duration: Column) -> Column:
    """Seconds of processing for a second of audio."""
    return F.when(duration > 0, elapsed / duration).otherwise(F.raise_error(F.lit("duration must be positive")))
