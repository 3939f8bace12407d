"""Irregular readings onto a regular grid, with missing periods filled and marked (problem 5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Series imputed at once: as many as fit into matrices of so many numbers, and no more than this.
_NUMBERS, _SERIES = 6_000_000, 256
#: Weight of staying where it is, for gaps that the trajectories leave undetermined.
_STAY = 1e-6


def ssa_round(x: np.ndarray, lengths: np.ndarray, size: int, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """One round of singular-spectrum smoothing of series ``x`` (zero beyond their ``lengths``): embed as Hankel
    trajectories of ``size``, keep the ``rank`` leading singular directions, average the anti-diagonals.

    -> (the averages, the weights that gave them). With the directions held, an average is a weighted sum of the slots
    less than ``size`` away; ``weights[s, i, d + size - 1]`` is that of slot ``i + d`` in slot ``i``.
    """
    n, width = x.shape
    columns = width - size + 1
    starts = np.arange(columns)[None, :] <= (lengths - size)[:, None]
    h = np.lib.stride_tricks.sliding_window_view(x, size, axis=1).transpose(0, 2, 1) * starts[:, None, :]
    _, vectors = np.linalg.eigh(h @ h.transpose(0, 2, 1))
    lead = vectors[:, :, -rank:]
    keep = lead @ lead.transpose(0, 2, 1)
    low = keep @ h
    total, count, weights = np.zeros_like(x), np.zeros_like(x), np.zeros((n, width, 2 * size - 1))
    for k in range(size):
        total[:, k : k + columns] += low[:, k, :]
        count[:, k : k + columns] += starts
        weights[:, k : k + columns, size - 1 - k : 2 * size - 1 - k] += starts[:, :, None] * keep[:, k, None, :]
    count = np.maximum(count, 1)
    return total / count, weights / count[:, :, None]


def ssa_fill(values: np.ndarray, lengths: np.ndarray, window: int, rank: int, tol: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Iterative singular-spectrum imputation of several series at once: (the filled series, whether each converged).

    ``values`` is (series, slots), NaN where a slot is missing and beyond each series' ``lengths``. Every series is
    centred and its gaps start from linear interpolation. A round is ``ssa_round``; the plain iteration would put its
    averages into the gaps and creep towards the point where they no longer change. While the singular directions are
    held that point solves a linear system, so each round goes there at once and takes the directions anew, until no
    gap moves by more than ``tol`` of the series' spread; then the averages reproduce the gaps. A series that
    hasn't settled after ``most`` rounds keeps its last state and is told apart. Known values never change. The
    columns beyond a series' end are zero, which adds nothing to its trajectory moments, so a result doesn't depend
    on which series share the batch. A series too short to embed keeps its interpolation, which counts as converged.
    """
    out = values.copy()
    n_series, width = out.shape
    slots = np.arange(width)
    inside = slots[None, :] < lengths[:, None]
    missing = np.isnan(out) & inside
    mean, spread, converged = np.zeros(n_series), np.ones(n_series), np.ones(n_series, bool)
    for i in range(n_series):
        known = inside[i] & ~missing[i]
        mean[i] = out[i, known].mean()
        spread[i] = max(out[i, known].std(), 1e-12)
        out[i] -= mean[i]
        if missing[i].any():
            out[i, missing[i]] = np.interp(slots[missing[i]], slots[known], out[i, known])
    out[~inside] = 0.0
    embed = np.minimum(window, lengths // 2)
    for size in np.unique(embed[(embed >= 2) & missing.any(axis=1)]).tolist():
        live = np.flatnonzero((embed == size) & missing.any(axis=1))
        converged[live] = False
        for done in range(most):
            x, gaps = out[live], missing[live]
            fresh, weights = ssa_round(x, lengths[live], size, min(rank, size - 1))
            # the gaps of each series side by side, padded with slots that stand for nothing
            many = gaps.sum(axis=1)
            at = np.argsort(~gaps, axis=1, kind="stable")[:, : many.max()]
            real = np.arange(many.max())[None, :] < many[:, None]
            apart = at[:, None, :] - at[:, :, None]
            near = (np.abs(apart) < size) & real[:, None, :] & real[:, :, None]
            rows = np.take_along_axis(weights, at[:, :, None], axis=1)
            system = (1 + _STAY) * np.eye(many.max()) - np.take_along_axis(rows, np.clip(apart + size - 1, 0, 2 * size - 2), axis=2) * near
            rest = np.where(real, np.take_along_axis(fresh - x, at, axis=1), 0.0)
            move = np.linalg.solve(system, rest[:, :, None])[:, :, 0]
            if done >= most // 2:  # directions that take turns
                move /= 2
            np.put_along_axis(x, at, np.take_along_axis(x, at, axis=1) + move, axis=1)
            out[live] = x
            still = np.abs(move).max(axis=1) > tol * spread[live]
            converged[live[~still]] = True
            live = live[still]
            if not len(live):
                break
    return np.where(inside, out + mean[:, None], np.nan), converged


def _series_filler(window: int, rank: int, tol: float, most: int, step: int):
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            first = np.asarray(batch.column("first"))
            lengths = ((np.asarray(batch.column("last")) - first) // step + 1).astype(np.int64)
            lists = batch.column("seen")
            owner = np.repeat(np.arange(n), np.diff(np.asarray(lists.offsets)))
            flat = lists.flatten()
            at = (np.asarray(flat.field("slot_start")) - first[owner]) // step
            seen = {c: np.asarray(flat.field(c)) for c in ("price", "size", "n")}
            start = np.concatenate([[0], np.cumsum(lengths)])
            row = np.repeat(np.arange(n), lengths)
            pos = np.arange(start[-1]) - start[row]
            held = start[owner] + at
            price, size, count = np.full(start[-1], np.nan), np.zeros(start[-1]), np.zeros(start[-1], np.int64)
            price[held], size[held], count[held] = seen["price"], seen["size"], seen["n"]
            gappy = np.flatnonzero(np.bincount(owner, minlength=n) < lengths)
            settled = np.ones(n, bool)
            gappy = gappy[np.argsort(lengths[gappy], kind="stable")]
            while len(gappy):
                many = min(_SERIES, max(1, _NUMBERS // int(lengths[gappy[: _SERIES]][-1]) ** 2))
                part, gappy = gappy[:many], gappy[many:]
                grid = np.full((len(part), int(lengths[part].max())), np.nan)
                for k, i in enumerate(part):
                    grid[k, : lengths[i]] = price[start[i] : start[i + 1]]
                done, settled[part] = ssa_fill(grid, lengths[part], window, rank, tol, most)
                for k, i in enumerate(part):
                    price[start[i] : start[i + 1]] = done[k, : lengths[i]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("series").take(pa.array(row)), pa.array(first[row] + pos * step), pa.array(price), pa.array(size), pa.array(count), pa.array(count == 0), pa.array(settled[row])],
                names=["series", "slot_start", "price", "size", "n", "filled", "converged"],
            )

    return fill


def regular_series(
    readings: DataFrame, series: str, micros: str, price: str, size: str, day: Column | None = None,
    step: int = 300, window: int = 12, rank: int = 3, tol: float = 1e-6, most: int = 200,
) -> DataFrame:
    """One row per ``series``, day and ``step``-second slot between the day's first and last slot with a reading:
    (series, slot_start epoch seconds, price, size, n, filled, converged).

    ``price`` is the size-weighted mean of the slot's readings, or the singular-spectrum imputation where there is
    none; then ``filled`` is true, ``n`` 0 and ``size`` 0. ``converged`` is false for all slots of a day whose
    imputation hasn't settled to ``tol`` of its spread after ``most`` rounds. ``day`` (of the slot start in column ``slot_start``)
    splits a series; it defaults to the New York date. Readings without series, instant, positive price or positive
    size don't count. Repeated readings count as often as they occur, in the weights only. Empty input gives no
    rows. The first shuffle carries one row per slot and map task, so a hot series is reduced before it moves; a
    group of the second one is a day's slots, at most 25 hours of them.
    """
    if step < 60 or 86_400 % step:
        raise ValueError("step must divide a day and be 60 s or more: a day's slots make one matrix")
    slots = (
        readings.where(F.col(series).isNotNull() & F.col(micros).isNotNull() & (F.col(price) > 0) & (F.col(size) > 0) & ~F.isnan(price) & ~F.isnan(size))
        .select(
            F.col(series).alias("series"),
            (F.floor(F.col(micros) / F.lit(step * 1_000_000)) * step).alias("slot_start"),
            F.col(price).alias("__p"),
            F.col(size).alias("__s"),
        )
        .groupBy("series", "slot_start")
        .agg((F.sum(F.col("__p") * F.col("__s")) / F.sum("__s")).alias("price"), F.sum("__s").alias("size"), F.count("*").alias("n"))
    )
    if day is None:
        local = F.from_utc_timestamp(F.timestamp_seconds("slot_start"), "America/New_York")
        day = F.floor(F.unix_seconds(local) / 86_400)
    packed = (
        slots.withColumn("__day", day)
        .groupBy("series", "__day")
        .agg(
            F.min("slot_start").alias("first"),
            F.max("slot_start").alias("last"),
            F.collect_list(F.struct("slot_start", "price", "size", "n")).alias("seen"),
        )
        .select("series", "first", "last", "seen")
    )
    kind = readings.schema[series].dataType.simpleString()
    return packed.mapInArrow(
        _series_filler(window, rank, tol, most, step),
        f"series {kind}, slot_start bigint, price double, size double, n bigint, filled boolean, converged boolean",
    )
