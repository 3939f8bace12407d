"""Overlapping and gapped intervals: continuous periods and the gaps between them (problem 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.scratch import materialise, shared_dir

_OUT = "kind string, entity {kind}, start_us bigint, end_us bigint"
_SUMMARY = "part int, first {kind}, last {kind}, last_start bigint, last_end bigint"
#: An island that is still open: (entity, start, end).
Open = tuple[str, int, int]


class _Scan:
    """Sorted intervals, batch by batch: closes islands and lists gaps, with one open island as its only state."""

    def __init__(self, carry: Open | None):
        self.open = carry

    def feed(self, entity: pa.Array, start: np.ndarray, end: np.ndarray):
        """-> closed islands (entity, start, end) and gaps (entity, start, end)."""
        if self.open:
            entity = pa.concat_arrays([pa.array([self.open[0]], entity.type), entity])
            start, end = np.append(self.open[1], start), np.append(self.open[2], end)
        n = len(start)
        code = np.asarray(entity.dictionary_encode().indices)
        head = np.append(True, code[1:] != code[:-1])
        rank = np.empty(n, np.int64)
        order = np.argsort(end, kind="stable")
        rank[order] = np.arange(n)
        # the furthest end so far of the row's entity: rank within entity, made to outrank all earlier entities
        reach = end[order][np.maximum.accumulate(np.cumsum(head) * n + rank) % n]
        fresh = head.copy()
        fresh[1:] |= start[1:] > reach[:-1]
        label = start[np.maximum.accumulate(np.where(fresh, np.arange(n), 0))]
        closed = np.flatnonzero(fresh[1:])
        gap = closed[~head[closed + 1]]
        self.open = (entity[n - 1].as_py(), int(label[-1]), int(reach[-1]))
        return (entity.take(pa.array(closed)), label[closed], reach[closed]), (entity.take(pa.array(gap)), reach[gap], start[gap + 1])


def _columns(batch: pa.RecordBatch):
    return batch.column(0).cast(pa.string()), np.asarray(batch.column(1)), np.asarray(batch.column(2))


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per partition: its first entity, and the open island its last entity ends with."""
    scan, first = _Scan(None), None
    for batch in batches:
        if batch.num_rows:
            entity, start, end = _columns(batch)
            first = first if first is not None else entity[0].as_py()
            scan.feed(entity, start, end)
    if scan.open:
        row = [TaskContext.get().partitionId(), first, *scan.open]
        yield pa.RecordBatch.from_arrays(
            [pa.array([row[0]], pa.int32()), pa.array([first]), pa.array([row[2]]), pa.array([row[3]], pa.int64()), pa.array([row[4]], pa.int64())],
            names=["part", "first", "last", "last_start", "last_end"],
        )


def carried(summaries: list[tuple[int, str, str, int, int]]) -> dict[int, Open]:
    """The island open before each partition, by a prefix combination of the summaries in partition order.

    If a partition holds nothing but the entity carried into it, its last island either starts beyond the carried
    end and stays, or is swallowed by the carried island, which then reaches the further of both ends.
    """
    out: dict[int, Open] = {}
    now: Open | None = None
    for part, first, last, start, end in sorted(summaries):
        if now:
            out[part] = now
        if now and first == last == now[0] and start <= now[2]:
            now = (last, now[1], max(now[2], end))
        else:
            now = (last, start, end)
    return out


def merged_periods(intervals: DataFrame, entity: str, start: str, end: str, partitions: int | None = None) -> DataFrame:
    """(kind, ``entity``, start_us, end_us): 'period' for each maximal run of overlapping or touching intervals of an
    entity, 'gap' for each span between two successive ones.

    Rows with null in any of the three columns, or with end <= start, are left out; repeated rows change nothing; no
    valid row gives no result. The intervals are range-sorted by entity and start over all partitions, so a hot
    entity spreads over many of them; a first pass leaves one summary per partition, their prefix combination gives
    the island open before each, and the second pass rescans with it. Only the summaries (a row per partition) reach
    the driver.
    """
    spark = intervals.sparkSession
    kind = "string"
    valid = intervals.select(
        F.col(entity).cast("string").alias("e"), F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("t")
    ).where(F.col("e").isNotNull() & (F.col("t") > F.col("s")))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    # The range bounds are sampled: a checkpoint makes both passes see the same partitions.
    # They are sampled from a written table, so that what leads to the intervals runs once.
    held = materialise(valid, "intervals").repartitionByRange(n, "e", "s", "t").sortWithinPartitions("e", "s", "t").checkpoint()
    rows = [tuple(r) for r in held.mapInArrow(_summarise, _SUMMARY.format(kind=kind)).collect()]
    carry, final = carried(rows), max((r[0] for r in rows), default=-1)

    def rescan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        scan, any_row = _Scan(carry.get(part)), False

        def rows_of(name: str, found) -> pa.RecordBatch:
            e, s, t = found
            return pa.RecordBatch.from_arrays(
                [pa.array([name] * len(s), pa.string()), e, pa.array(s, pa.int64()), pa.array(t, pa.int64())], names=["kind", "entity", "start_us", "end_us"]
            )

        for batch in batches:
            if batch.num_rows:
                any_row = True
                periods, gaps = scan.feed(*_columns(batch))
                yield rows_of("period", periods)
                yield rows_of("gap", gaps)
        if any_row and part == final:
            e, s, t = scan.open
            yield rows_of("period", (pa.array([e], pa.string()), np.array([s]), np.array([t])))

    return held.mapInArrow(rescan, _OUT.format(kind=kind)).withColumnRenamed("entity", entity)
