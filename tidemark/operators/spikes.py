"""Implausible readings: spikes, stuck values and impossible values, per source (problem 7).

A source's readings make a matrix of daily profiles: a row per day, for each time of day the highest and the lowest
level seen there. Robust principal components separate its low-rank normal behaviour from a sparse rest; the exact rule is
computed for the readings of the cells that stand out of the normal, and for no others. Runs of equals are tested apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import materialise
from tidemark.sources.tables import broadcast_if_small

#: Readings away from the level for at most this many readings are a spike.
BACK_WITHIN = 3
#: Readings at either end of a partition that are finished together with its neighbours.
_EDGE = 2 * BACK_WITHIN
#: Suspect cells are broadcast up to this many (some megabytes): the cells' rows they meet hold all levels.
_SMALL_SUSPECTS = 100_000
#: Bits of a step by which steps are counted in the scan, and in every round after it (of 64 in all).
_FIRST_BITS, _ROUND_BITS = 19, 15


def away_and_back(x: np.ndarray, series: np.ndarray) -> np.ndarray:
    """How far each reading lies away from its neighbours if the level is back within three readings, else 0.

    ``x`` are logarithms in order, ``series`` their series' codes. For every stretch of one to three readings with a
    reading before and after it in the same series: the least distance of any of its members from both, if all lie
    on the same side of both. A lasting change of level is near one of the two, so it counts as nothing.
    """
    n = len(x)
    out = np.zeros(n)
    for m in range(1, BACK_WITHIN + 1):
        if n < m + 2:
            break
        left, right = x[: n - m - 1], x[m + 1 :]
        low, high = np.full(n - m - 1, np.inf), np.full(n - m - 1, -np.inf)
        for k in range(m):
            member = x[1 + k : n - m + k]
            np.minimum(low, member, out=low)
            np.maximum(high, member, out=high)
        above = low - np.maximum(left, right)
        below = np.minimum(left, right) - high
        reach = np.where(series[: n - m - 1] == series[m + 1 :], np.maximum(np.maximum(above, below), 0.0), 0.0)
        for k in range(m):
            np.maximum(out[1 + k : n - m + k], reach, out=out[1 + k : n - m + k])
    return out


def halo(x: np.ndarray, series: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The highest and lowest level among each reading and its three neighbours on either side in the same series:
    whatever ``away_and_back`` compares a reading with."""
    high, low = x.copy(), x.copy()
    for k in range(1, min(BACK_WITHIN, len(x) - 1) + 1):
        same = series[k:] == series[:-k]
        for here, there in ((slice(k, None), slice(None, -k)), (slice(None, -k), slice(k, None))):
            np.maximum(high[here], np.where(same, x[there], -np.inf), out=high[here])
            np.minimum(low[here], np.where(same, x[there], np.inf), out=low[here])
    return high, low


_LOCAL = (
    "kind string, series string, row_id bigint, day int, cell_row int, cell_col int, bits bigint, run bigint, edge boolean, part int, "
    "pos bigint, value double, level double, by_day boolean, high double, low double, ids array<bigint>, levels array<double>, lead int, n bigint"
)
_FIELDS = [x.split() for x in _LOCAL.split(", ")]
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
_ARROW |= {f"array<{t}>": pa.list_(_ARROW[t]) for t in ("bigint", "double")}


def _rows(kind: str, size: int, /, **columns) -> pa.RecordBatch:
    """``size`` rows of ``_LOCAL``: 'reading', 'cell' or 'step'; columns that aren't given are null."""
    held = [pa.array([kind] * size) if c == "kind" else columns[c] if c in columns else pa.nulls(size, _ARROW[t]) for c, t in _FIELDS]
    held = [h if isinstance(h, pa.Array) else pa.array(h, _ARROW[t]) for h, (_, t) in zip(held, _FIELDS)]
    return pa.RecordBatch.from_arrays(held, names=[c for c, _ in _FIELDS])


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins."""
    fresh = np.ones(len(columns[0]), bool)
    fresh[1:] = False
    for c in columns:
        fresh[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(fresh)


def _around(code: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From where to where the readings ``a`` to ``b`` reach with the neighbours that ``away_and_back`` compares them with."""
    low, high = a.copy(), b.copy()
    for k in range(1, BACK_WITHIN + 1):
        low -= (a >= k) & (code[np.maximum(a - k, 0)] == code[a])
        high += (b - 1 + k < len(code)) & (code[np.minimum(b - 1 + k, len(code) - 1)] == code[b - 1])
    return low, high


class _Scan:
    """One range partition of sorted readings, batch by batch. What it keeps is the last readings, of which six wait
    for those to come, the label of the open run, and how often each step occurs in the series at hand.

    Gives a row per reading (step from the reading before, label of the run of equals it belongs to), per cell (highest and
    lowest level in and beside it, its readings and their levels with those of ``lead`` neighbours before and some after) and
    per size of step (how often). A cell that goes on in the next batch gives several rows.
    The partition's first and last readings are edges and keep their values, to be finished with their neighbours.
    """

    def __init__(self, part: int):
        self.part, self.held, self.first, self.done, self.label = part, None, 0, 0, 0
        self.steps: dict[int, int] = {}
        self.series: str | None = None

    def _flush_steps(self) -> Iterator[pa.RecordBatch]:
        if self.steps:
            n = len(self.steps)
            yield _rows("step", n, series=pa.array([self.series] * n), bits=list(self.steps), n=list(self.steps.values()))
            self.steps = {}

    def feed(self, batch: pa.Table | None) -> Iterator[pa.RecordBatch]:
        """Take in a batch; None ends the partition."""
        t = self.held if batch is None else batch if self.held is None else pa.concat_tables([self.held, batch])
        if t is None:
            return
        t = t.combine_chunks()
        n, last = t.num_rows, batch is None
        names = t.column("series").combine_chunks().dictionary_encode()
        code = np.asarray(names.indices)
        value, day, by_day, level = (np.asarray(t.column(c)) for c in ("value", "day", "by_day", "level"))
        ready = n if last else max(n - _EDGE, self.first)
        at = self.done + np.arange(self.first, ready)  # places in the partition
        out = slice(self.first, ready)
        same = np.append(False, code[1:] == code[:-1])
        fresh = ~(same & np.append(False, (value[1:] == value[:-1]) & (~by_day[1:] | (day[1:] == day[:-1]))))
        alone = fresh & np.append(fresh[1:], True)
        begins = np.maximum.accumulate(np.where(fresh[out], at, -1))
        label = np.where(begins < 0, self.label, begins)
        bits = np.append(0.0, np.abs(np.diff(level))).view(np.int64)
        high, low = halo(level, code)
        here = t.slice(self.first, ready - self.first)
        if ready > self.first:
            self.label = int(label[-1])
            edge = (at < _EDGE) | (last & (at >= self.done + n - _EDGE))
            yield _rows(
                "reading", len(at), **{c: here.column(c).combine_chunks() for c in ("series", "row_id", "day", "cell_row", "cell_col")},
                bits=pa.array(bits[out], mask=~same[out]),
                run=pa.array((np.int64(self.part) << 40) + label, mask=alone[out] & ~edge), edge=edge, part=np.full(len(at), self.part, np.int32), pos=at,
                value=pa.array(value[out], mask=~edge), level=pa.array(level[out], mask=~edge), by_day=by_day[out],
            )
            row, col = np.asarray(here.column("cell_row")), np.asarray(here.column("cell_col"))
            starts = _starts(code[out], row, col)
            bounds = np.append(starts, len(at))
            begin, end = _around(code, self.first + bounds[:-1], self.first + bounds[1:])
            offsets = np.append(0, np.cumsum(end - begin))
            around = np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], end - begin)
            yield _rows(
                "cell", len(starts), series=here.column("series").combine_chunks().take(pa.array(starts)), cell_row=row[starts], cell_col=col[starts],
                high=np.maximum.reduceat(high[out], starts), low=np.minimum.reduceat(low[out], starts),
                ids=pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), here.column("row_id").combine_chunks().cast(pa.int64())),
                levels=pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(level[around])), lead=self.first + starts - begin,
            )
            starts = _starts(code[out])
            for a, b in zip(starts, np.append(starts[1:], len(at))):
                name = names.dictionary[int(code[out][a])].as_py()
                if name != self.series:
                    yield from self._flush_steps()
                    self.series = name
                found, times = np.unique(bits[out][a:b][same[out][a:b]] >> (64 - _FIRST_BITS), return_counts=True)
                for k, m in zip(found.tolist(), times.tolist()):
                    self.steps[k] = self.steps.get(k, 0) + m
        if last:
            yield from self._flush_steps()
            return
        keep = max(0, ready - BACK_WITHIN)
        self.held, self.first, self.done = t.slice(keep), ready - keep, self.done + keep


def _local_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_Scan`` over one partition."""
    scan = _Scan(TaskContext.get().partitionId())
    for batch in batches:
        if batch.num_rows:
            yield from scan.feed(pa.Table.from_batches([batch]))
    yield from scan.feed(None)


_LOOKED_AT = "series string, row_id bigint, score double, dev double"


def _exact_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``away_and_back`` of the readings of cells (series, ids, levels, lead, score), a row per reading."""
    for b in batches:
        if not b.num_rows:
            continue
        ids, levels = b.column("ids"), b.column("levels")
        held, sizes = (np.asarray(x.value_lengths()) for x in (ids, levels))
        cell = np.repeat(np.arange(len(held)), held)
        dev = away_and_back(np.asarray(levels.flatten()), np.repeat(np.arange(len(sizes)), sizes))
        at = np.arange(len(cell)) + np.repeat(np.cumsum(sizes) - sizes + np.asarray(b.column("lead")) - (np.cumsum(held) - held), held)
        of = pa.array(cell)
        yield pa.RecordBatch.from_arrays([b.column("series").take(of), ids.flatten(), b.column("score").take(of), pa.array(dev[at])], names=["series", "row_id", "score", "dev"])


def looked_at(cells: DataFrame, suspects: DataFrame) -> DataFrame:
    """(series, row_id, score, dev) of the readings of suspect cells, ``dev`` how far each lies away by ``away_and_back``.

    ``cells`` are the cells' rows of ``local_features``. A reading at the end of a partition comes twice, the second time
    with its neighbours in the next one: the further of its distances counts."""
    near = cells.where("ids is not null").join(suspects, ["series", "cell_row", "cell_col"])
    return near.select("series", "ids", "levels", "lead", "score").mapInArrow(_exact_pass, _LOOKED_AT)


def _finish_edges(edges: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame, dict[int, int]]:
    """The partitions' edge readings with their steps across partitions, the levels and neighbours they add to cells, the
    steps across partitions, and which run labels are the continuation of which run."""
    if edges.empty:
        return edges, edges, edges, {}
    edges = edges.sort_values(["part", "pos"], ignore_index=True)
    part, pos = edges["part"].to_numpy(), edges["pos"].to_numpy()
    joined = np.append(False, (part[1:] != part[:-1]) | (np.diff(pos) == 1))
    value, level, day, by_day, run = (edges[c].to_numpy() for c in ("value", "level", "day", "by_day", "run"))
    code = pd.factorize(edges["series"])[0]
    same = np.append(False, code[1:] == code[:-1]) & joined
    across = same & np.append(False, part[1:] != part[:-1])
    high, low = level.copy(), level.copy()
    begin, end = np.arange(len(edges)), np.arange(1, len(edges) + 1)
    for a in np.split(np.arange(len(edges)), np.flatnonzero(~joined)):
        if len(a):
            high[a], low[a] = halo(level[a], code[a])
            begin[a], end[a] = (a[0] + x for x in _around(code[a], a - a[0], a - a[0] + 1))
    step = np.abs(np.diff(level, prepend=level[0])).view(np.int64)
    bits = [int(step[i]) if across[i] else None if pd.isna(b) else int(b) for i, b in enumerate(edges["bits"])]
    roots: dict[int, int] = {}
    for i in np.flatnonzero(across):
        if value[i] == value[i - 1] and (not by_day[i] or day[i] == day[i - 1]):
            roots[int(run[i])] = roots.get(int(run[i - 1]), int(run[i - 1]))
    cells = edges[["series", "cell_row", "cell_col"]].assign(high=high, low=low, lead=np.arange(len(edges)) - begin)
    cells["ids"], cells["levels"] = [[int(i)] for i in edges["row_id"]], [level[a:b].tolist() for a, b in zip(begin, end)]
    steps = pd.DataFrame({"series": edges["series"].to_numpy()[across], "bits": step[across] >> (64 - _FIRST_BITS), "n": 1})
    return edges.assign(bits=pd.array(bits, dtype=object)), cells, steps, roots


def robust_low_rank(m: np.ndarray, tol: float = 1e-4, most: int = 60) -> np.ndarray:
    """The low-rank part of ``m`` by principal component pursuit: least nuclear norm of the low-rank part plus
    ``1/sqrt(longer side)`` times the absolute sum of the sparse rest (inexact augmented Lagrangian)."""
    norm = np.linalg.norm(m)
    if not norm:
        return m.copy()
    lam = 1 / np.sqrt(max(m.shape))
    top = np.linalg.norm(m, 2)
    y = m / max(top, np.abs(m).max() / lam)
    mu, sparse = 1.25 / top, np.zeros_like(m)
    low = sparse
    for _ in range(most):
        u, s, v = np.linalg.svd(m - sparse + y / mu, full_matrices=False)
        low = (u * np.maximum(s - 1 / mu, 0)) @ v
        rest = m - low + y / mu
        sparse = np.sign(rest) * np.maximum(np.abs(rest) - lam / mu, 0)
        gap = m - low - sparse
        y, mu = y + mu * gap, min(mu * 1.5, 1e7 / top)
        if np.linalg.norm(gap) < tol * norm:
            break
    return low


def normal_levels(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The normal level of every cell of a source's profiles (days x times of day, NaN where nothing was read): halfway
    between the low-rank parts of the highest and the lowest levels, taken as one matrix. Empty cells are filled from
    their neighbours in time."""
    seen = np.isfinite(high - low).ravel()
    if not seen.any():
        return np.zeros_like(high)
    places, k = np.arange(seen.size), high.shape[1]
    filled = np.hstack([np.interp(places, places[seen], x.ravel()[seen]).reshape(x.shape) for x in (high, low)])
    level = np.median(filled)
    part = robust_low_rank(filled - level) + level
    return (part[:, :k] + part[:, k:]) / 2


def suspect_cells(cells: pd.DataFrame, normal=normal_levels) -> pd.DataFrame:
    """Cells of one source's profiles that stand out of its normal behaviour, and by how many typical steps.

    A cell is let off only if all levels in and beside it lie within half the exact rule's limit of its normal level:
    then no two of them are further apart than the limit, so the rule could find nothing in it. Where the low-rank part
    should have taken a spike for normal, the readings around the spike stand out instead.
    """
    rows, at_row = np.unique(cells["cell_row"].to_numpy(), return_inverse=True)
    cols, at_col = np.unique(cells["cell_col"].to_numpy(), return_inverse=True)
    high, low = np.full((len(rows), len(cols)), np.nan), np.full((len(rows), len(cols)), np.nan)
    high[at_row, at_col], low[at_row, at_col] = cells["high"].to_numpy(), cells["low"].to_numpy()
    level = normal(high, low)
    sparse = np.fmax(high - level, level - low)[at_row, at_col]
    typical, limit = cells["typical"].iloc[0], cells["limit"].iloc[0]
    out = cells[["series", "cell_row", "cell_col"]].assign(score=sparse / max(typical, 1e-12))
    return out[sparse > typical * limit / 2 - 1e-12 * np.abs(level[at_row, at_col])]


def _double(bits: Column) -> Column:
    """The non-negative double of these bits."""
    whole = F.lit(1 << 52)
    return F.when(bits == 0, F.lit(0.0)).otherwise((F.pmod(bits, whole) / whole + 1) * F.pow(F.lit(2.0), F.shiftright(bits, 52) - 1023))


def typical_steps(steps: DataFrame, counts: DataFrame) -> DataFrame:
    """(series, typical): the exact median of each series' steps, the mean of the two middle ones if there are two.

    ``steps`` holds (series, bits) of every step, ``counts`` (series, bits, n) how often its leading bits occur. The
    middle is found from leading bits to the last, a few bits a round: each round only counts, so a hot source never
    gathers in one task, and only the first one reads all steps.
    """

    def middle(c: DataFrame) -> DataFrame:
        """Of (series, which, place, bits, n) the one ``bits`` that ``place`` falls into, with the place within it."""
        w = Window.partitionBy("series", "which").orderBy("bits")
        c = c.withColumn("upto", F.sum("n").over(w))
        inside = (F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("n"))
        return c.where(inside).select("series", "which", (F.col("place") - F.col("upto") + F.col("n")).alias("place"), F.col("bits").alias("lead"))

    counts = counts.groupBy("series", "bits").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("series"))
    places = F.explode(F.array(F.struct(F.lit(0).alias("which"), F.floor((F.col("total") - 1) / 2).alias("place")), F.struct(F.lit(1).alias("which"), F.floor(F.col("total") / 2).alias("place"))))
    found = middle(counts.withColumn("total", total).select("series", "bits", "n", places.alias("p")).select("series", "bits", "n", "p.which", "p.place"))
    known = _FIRST_BITS
    found = materialise(found, "middle")
    wanted = found.select("series", F.col("lead").alias("w")).distinct()
    steps = steps.join(wanted, (steps["series"] == wanted["series"]) & (F.shiftright("bits", 64 - known) == F.col("w")), "left_semi")
    steps = materialise(steps, "steps")
    while known < 64:
        more = min(known + _ROUND_BITS, 64)
        lead = F.shiftright("bits", 64 - known)
        refined = steps.withColumn("lead", lead).join(found, ["series", "lead"]).groupBy("series", "which", "place", F.shiftright("bits", 64 - more).alias("bits"))
        found, known = middle(refined.agg(F.count("*").alias("n"))), more
    return found.groupBy("series").agg(F.avg(_double(F.col("lead"))).alias("typical"))


def local_features(readings: DataFrame, written: bool = False) -> tuple[DataFrame, DataFrame]:
    """What ``_Scan`` tells of the range-sorted whole, and the run labels that continue over partition boundaries.

    ``readings``: (series, ord, row_id, value, level, day, cell_row, cell_col, by_day). Range-sorting by series and
    order spreads a hot source over partitions; twelve readings per partition go to the driver to be finished
    across partitions. The range bounds are sampled from a written table; ``written`` says that ``readings`` is little
    more than a scan of one.
    """
    spark = readings.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = readings if written else materialise(readings, "readings")
    ranged = held.repartitionByRange(n, "series", "ord", "row_id").sortWithinPartitions("series", "ord", "row_id")
    local = materialise(ranged.mapInArrow(_local_pass, _LOCAL), "local")
    fixed, cells, steps, roots = _finish_edges(local.where("kind = 'reading' and edge").toPandas())
    rest = local.where("not coalesce(edge, false)")
    for kind, added in (("reading", fixed), ("cell", cells), ("step", steps)):
        if len(added):
            added = added.assign(**{c: None for c, _ in _FIELDS if c not in added} | {"kind": kind})[local.columns]
            rest = rest.unionByName(spark.createDataFrame(added.astype(object).where(added.notna(), None), local.schema))
    merged = spark.createDataFrame(list(roots.items()), "run bigint, root bigint")
    return rest, F.broadcast(merged)  # a row per partition boundary at most


def implausible(readings: DataFrame, limits: dict[str, float], run_of: dict[str, tuple[str, int]], written: bool = False) -> DataFrame:
    """Spikes and stuck values among ``readings``, as (series, row_id, score); ``score`` is how many typical steps the
    reading's cell stands out of its source's normal profile, null for readings that are only stuck.

    ``readings`` as in ``local_features``, with ``series`` = ``table|field|source``. ``limits`` gives by ``table|field``
    how many of its source's typical steps a spike lies away; ``run_of`` whether a run of equals is measured in
    ``sessions`` or ``readings`` and how long a stuck one is. The typical step of a source is the exact median of its
    absolute log steps. Robust principal components set cells apart; the exact rule is computed for their readings alone. Repeated readings count as readings; sources of one or two readings have no spikes; no input gives
    no rows.
    """
    local, merged = local_features(readings, written)
    of = {k: local.where(F.col("kind") == k) for k in ("reading", "cell", "step")}
    kind = F.substring_index("series", "|", 2)

    def by_kind(values: dict) -> Column:
        return F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)])[kind]

    typical = materialise(typical_steps(of["reading"].where("bits is not null").select("series", "bits"), of["step"].select("series", "bits", "n")), "typical")
    cells = (
        of["cell"].groupBy("series", "cell_row", "cell_col").agg(F.max("high").alias("high"), F.min("low").alias("low"))
        .join(typical, "series").withColumn("limit", by_kind(limits))
    )
    suspects = cells.groupBy("series").applyInPandas(lambda pdf: suspect_cells(pdf), "series string, cell_row int, cell_col int, score double")
    suspects = broadcast_if_small(materialise(suspects, "suspects"), _SMALL_SUSPECTS)
    spikes = (
        looked_at(of["cell"], suspects).where("dev > 0").join(typical, "series")
        .where(F.col("dev") > by_kind(limits) * F.col("typical"))
        .select("series", "row_id", "score")
    )
    in_runs = (
        of["reading"].where("run is not null")
        .join(merged, "run", "left")
        .select("series", "row_id", "day", F.coalesce("root", "run").alias("run"))
    )
    stuck = (
        in_runs.groupBy("run", "series").agg(F.count("*").alias("readings"), F.count_distinct("day").alias("sessions"))
        .where(
            F.when(by_kind({k: v[0] for k, v in run_of.items()}) == "sessions", F.col("sessions")).otherwise(F.col("readings"))
            >= by_kind({k: v[1] for k, v in run_of.items()})
        )
    )
    held_back = in_runs.join(stuck.select("run"), "run", "left_semi").select("series", "row_id", F.lit(None).cast("double").alias("score"))
    return spikes.unionByName(held_back).groupBy("series", "row_id").agg(F.max("score").alias("score"))
