"""Path-dependent kernels: one ordered series at a time, in NumPy.

Each runs as a grouped function over the rows of one key in order; a key is one series (a pair in a fold), whose length
is that of its calendar, not of the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_series(df: DataFrame, keys: list[str], order: list[str], kernel: Callable[[pd.DataFrame], pd.DataFrame], adds: str) -> DataFrame:
    """``df`` with the columns a kernel adds to each series in order; null keys are series of their own."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return kernel(pdf.sort_values(order, kind="stable", ignore_index=True))

    return df.groupBy(*keys).applyInPandas(run, f"{schema}, {adds}")


def positions(z: np.ndarray, entry: float, exit_: float, stop: float | None = None, start: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Position and exit code per bar: enter long below -entry, short above entry; a long leaves at z >= -exit, a
    short at z <= exit (code 1), either beyond the stop (code 2, looked at first); no new entry on the bar of an exit;
    missing z holds."""
    held, code = np.zeros(len(z), np.int64), np.zeros(len(z), np.int64)
    now = start
    for i, v in enumerate(z):
        if not np.isnan(v):
            if now:
                if stop is not None and ((now > 0 and v <= -stop) or (now < 0 and v >= stop)):
                    now, code[i] = 0, 2
                elif (now > 0 and v >= -exit_) or (now < 0 and v <= exit_):
                    now, code[i] = 0, 1
            elif v < -entry:
                now = 1
            elif v > entry:
                now = -1
        held[i] = now
    return held, code


def replay(
    z: np.ndarray, entry: float, exit_: float, corr: np.ndarray | None = None, floor: float = -1.0, spread: np.ndarray | None = None,
    mean: np.ndarray | None = None, dev: np.ndarray | None = None, moved: float | None = None, confirm: bool = False,
) -> tuple[np.ndarray, np.ndarray]:
    """Positions replayed with exits of their own, and the exit code per bar: 1 the rule of ``positions``, 2 the rolling
    correlation ``corr`` has fallen below ``floor``, 3 the rolling ``mean`` of the spread has moved against the position by
    more than ``moved`` deviations since the entry.

    After code 2 there is no entry until the plain signal has been flat; code 3 doesn't block. With ``confirm`` an entry
    waits until abs(z) is below the one before it. The plain signal is that of ``positions`` and runs on by itself."""
    signal, _ = positions(z, entry, exit_)
    held, code = np.zeros(len(z), np.int64), np.zeros(len(z), np.int64)
    now, blocked, at, last = 0, False, np.nan, np.nan
    for i, v in enumerate(z):
        if signal[i] == 0:
            blocked = False
        if now:
            drift = np.nan if moved is None or mean is None else (mean[i] - at) * now
            if corr is not None and corr[i] < floor:
                now, code[i], blocked = 0, 2, signal[i] != 0
            elif moved is not None and dev is not None and drift < -moved * dev[i]:
                now, code[i] = 0, 3
            elif signal[i] != now:
                now, code[i] = 0, 1
        elif signal[i] and not blocked and not np.isnan(v) and (not confirm or abs(v) < last):
            now, at = int(signal[i]), np.nan if spread is None else spread[i]
        if not np.isnan(v):
            last = abs(v)
        held[i] = now
    return held, code


def kalman(a: np.ndarray, b: np.ndarray, delta: float, noise: float, gate: float | None = None, clamp: tuple[float, float] | None = None, start: tuple[float, float] = (0.0, 1.0)):
    """Two-state filter of a = alpha + beta * b: (spread before the update, alpha, beta) per bar.

    Joseph-form update in plain numbers, which for two states is far quicker than small arrays; state noise ``delta * noise``. With ``gate``, an innovation beyond that many deviations is
    not learnt from; ``clamp`` bounds beta. Missing values give a missing spread and leave the state alone.
    """
    if noise <= 0:
        raise ValueError("noise must be positive")
    alpha, beta = map(float, start)
    p00, p01, p11, q = noise, 0.0, noise, delta * noise
    spread, alphas, betas = [math.nan] * len(a), [alpha] * len(a), [beta] * len(a)
    limit = math.inf if gate is None else gate * gate
    low, high = clamp or (-math.inf, math.inf)
    for i, (y, x) in enumerate(zip(np.asarray(a, float).tolist(), np.asarray(b, float).tolist())):
        p00 += q
        p11 += q
        if y == y and x == x:
            miss = y - alpha - beta * x
            g0, g1 = p00 + p01 * x, p01 + p11 * x
            s = g0 + g1 * x + noise
            spread[i] = miss
            if miss * miss <= limit * s:
                k0, k1 = g0 / s, g1 / s
                alpha += k0 * miss
                beta = min(max(beta + k1 * miss, low), high)
                # (I - k h') P (I - k h')' + k noise k', with h = (1, x)
                m00, m01, m10, m11 = 1 - k0, -k0 * x, -k1, 1 - k1 * x
                a00, a01, a10, a11 = m00 * p00 + m01 * p01, m00 * p01 + m01 * p11, m10 * p00 + m11 * p01, m10 * p01 + m11 * p11
                p00 = a00 * m00 + a01 * m01 + k0 * k0 * noise
                p01 = a00 * m10 + a01 * m11 + k0 * k1 * noise
                p11 = a10 * m10 + a11 * m11 + k1 * k1 * noise
        alphas[i], betas[i] = alpha, beta
    return np.array(spread), np.array(alphas), np.array(betas)


def rebalances(beta: np.ndarray, held: np.ndarray, band: float) -> np.ndarray:
    """Bars on which beta has left the band around its reference while a position is held; the reference moves there."""
    out, ref = np.zeros(len(beta), bool), np.nan
    for i in range(len(beta)):
        if not held[i] or np.isnan(beta[i]):
            ref = np.nan if not held[i] else ref
        elif np.isnan(ref):
            ref = beta[i]
        elif abs(beta[i] - ref) > band * abs(ref):
            out[i], ref = True, beta[i]
    return out


def median_squared_distance(x: np.ndarray, block: int = 64, bins: int = 65_536) -> float:
    """The median of the squared distances of all pairs of rows, in memory of ``block`` rows against all: distances are
    counted in bins, and only those of the bins that hold the middle are kept."""
    n = len(x)
    places = [(n * (n - 1) // 2 - 1) // 2, n * (n - 1) // 2 // 2]

    def distances():
        for i in range(0, n, block):
            d = ((x[i : i + block, None, :] - x[None, i:, :]) ** 2).sum(-1)
            yield d[np.triu(np.ones(d.shape, bool), 1)]

    most = max((d.max() for d in distances() if len(d)), default=0.0)
    if not most:
        return 0.0
    bin_of = lambda d: np.minimum((d * (bins / most)).astype(np.int64), bins - 1)
    count = sum(np.bincount(bin_of(d), minlength=bins) for d in distances())
    upto = np.cumsum(count)
    first, last = np.searchsorted(upto, places, side="right")
    held = np.sort(np.concatenate([d[(k >= first) & (k <= last)] for d in distances() for k in [bin_of(d)]]))
    return float(held[[q - (upto[first] - count[first]) for q in places]].mean())


def change_points(x: np.ndarray, penalty: float, least: int = 1, gamma: float | None = None) -> list[int]:
    """Optimal segmentation with a Gaussian kernel cost and a penalty per change point, with pruning: the first bars of
    all segments but the first. ``gamma`` defaults to one over the median squared distance. The kernel is summed up bar
    by bar for all starts at once, so memory grows with the bars, not with their square."""
    x = np.asarray(x, float).reshape(len(x), -1)
    n = len(x)
    if gamma is None:
        gamma = 1 / max(median_squared_distance(x) if n > 1 else 1.0, 1e-12)
    block, own = np.zeros(n), np.exp(-1e-2)  # block[a]: kernel sum over [a, end) x [a, end); own: of a bar with itself

    def take_in(bar: int) -> None:
        row = np.exp(-np.clip(gamma * ((x[:bar] - x[bar]) ** 2).sum(-1), 1e-2, 1e2))
        block[:bar] += 2 * row[::-1].cumsum()[::-1] + own
        block[bar] = own

    def cost(a: int, b: int) -> float:
        return own * (b - a) - block[a] / (b - a)

    best, back, alive = np.full(n + 1, np.inf), np.zeros(n + 1, int), [0]
    best[0] = -penalty
    for bar in range(min(least - 1, n)):
        take_in(bar)
    for end in range(least, n + 1):
        take_in(end - 1)
        usable = [s for s in alive if end - s >= least]
        costs = [best[s] + cost(s, end) + penalty for s in usable]
        at = int(np.argmin(costs))
        best[end], back[end] = costs[at], usable[at]
        alive = [s for s, c in zip(usable, costs) if c <= best[end] + penalty] + [s for s in alive if end - s < least] + [end]
    out, at = [], n
    while back[at]:
        at = back[at]
        out.append(at)
    return out[::-1]


def products(vectors: DataFrame) -> np.ndarray:
    """The sum of ``v v'`` over the rows of ``vectors`` (v), all of one length; the driver receives the sum alone."""
    schema = "i int, row array<double>"

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                x = np.stack(b["v"].to_numpy())
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "row": list(total)})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "row": [np.sum(np.stack(pdf["row"].to_numpy()), axis=0)]})

    got = vectors.mapInPandas(part, schema).groupBy("i").applyInPandas(whole, schema).toArrow().sort_by("i").combine_chunks()
    return np.asarray(got["row"].combine_chunks().flatten()).reshape(got.num_rows, -1 if got.num_rows else 0)


def principal_residuals(covariance: np.ndarray, k: int) -> np.ndarray:
    """Loadings (k x n) of the leading principal components of a covariance matrix, signs fixed by the largest entry."""
    _, vectors = np.linalg.eigh(covariance)
    lead = vectors[:, ::-1][:, :k].T
    return lead * np.sign(lead[np.arange(k), np.abs(lead).argmax(axis=1)])[:, None]


def with_positions(df: DataFrame, keys: list[str], order: list[str], z: str, entry: float, exit_: float, stop: float | None = None) -> DataFrame:
    """Adds ``position`` and ``exit_code`` (see ``positions``)."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        held, code = positions(pdf[z].to_numpy(float, na_value=np.nan), entry, exit_, stop)
        return pdf.assign(position=held, exit_code=code)

    return per_series(df, keys, order, kernel, "position bigint, exit_code bigint")


def with_kalman(df: DataFrame, keys: list[str], order: list[str], a: str, b: str, delta: float, noise: float, **options) -> DataFrame:
    """Adds ``spread``, ``alpha`` and ``beta`` of the filter (see ``kalman``)."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        s, al, be = kalman(pdf[a].to_numpy(float, na_value=np.nan), pdf[b].to_numpy(float, na_value=np.nan), delta, noise, **options)
        return pdf.assign(spread=s, alpha=al, beta=be)

    return per_series(df, keys, order, kernel, "spread double, alpha double, beta double")


def trades(df: DataFrame, keys: list[str], order: list[str], position: str = "position") -> DataFrame:
    """Adds ``trade``, the running number of the trade a bar belongs to (null while flat)."""
    from tidemark.operators.windows import over

    w = over(keys, order)
    p = F.coalesce(F.col(position), F.lit(0))
    entered = ((p != 0) & (p != F.coalesce(F.lag(p).over(w), F.lit(0)))).cast("int")
    return df.withColumn("__e", entered).withColumn("trade", F.when(p != 0, F.sum("__e").over(w))).drop("__e")
