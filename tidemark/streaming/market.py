"""Streaming operators on ticks, bars and events: Structured Streaming with watermarks and keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.kernels import positions


def minute_bars(ticks: DataFrame, late: str = "2 minutes", width: str = "1 minute") -> DataFrame:
    """Bars per ticker and tumbling window from (ticker, ts, price, size, seq); open and close by (ts, seq).

    Ticks without positive price and size don't count. A late tick joins its own window as long as the watermark
    hasn't passed it, instead of opening a stale bar; after that it is dropped, which is what ``late`` bounds.
    """
    at = F.struct("ts", "seq")
    good = ticks.where("price > 0 and size > 0").withWatermark("ts", late)
    bars = good.groupBy("ticker", F.window("ts", width)).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("size").alias("volume"), (F.sum(F.col("price") * F.col("size")) / F.sum("size")).alias("vwap"), F.count("*").alias("n"),
    )
    return bars.select("ticker", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume", "vwap", "n")


def bar_mismatches(built: DataFrame, official: DataFrame, bps: float = 5.0, late: str = "10 minutes") -> DataFrame:
    """Built and official bars of the same ticker and time whose closes differ by more than ``bps``: a stream-stream
    join, both sides watermarked."""
    a = built.select(F.col("ticker").alias("t"), F.col("ts").alias("at"), F.col("close").alias("built")).withWatermark("at", late)
    b = official.select("ticker", "ts", F.col("close").alias("official")).withWatermark("ts", late)
    j = b.join(a, (F.col("ticker") == F.col("t")) & (F.col("ts") == F.col("at")))
    off = F.abs(F.col("built") / F.col("official") - 1) * 10_000
    return j.select("ticker", "ts", "built", "official", off.alias("off_bps")).where(F.col("off_bps") > bps)


def _streak(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, length: int) -> Iterator[pd.DataFrame]:
    run = state.get[0] if state.exists else 0
    rows = pd.concat(list(batches)).sort_values("ts", ignore_index=True)
    found = []
    for ts, bad in zip(rows["ts"], rows["bad"]):
        run = run + 1 if bad else 0
        if run == length:
            found.append(ts)
    state.update((run,))
    yield pd.DataFrame({"ticker": [key[0]] * len(found), "ts": found})


def streaks(flags: DataFrame, length: int = 3) -> DataFrame:
    """(ticker, ts) whenever ``bad`` has held ``length`` times in a row; the run survives micro-batches."""
    return flags.groupBy("ticker").applyInPandasWithState(
        partial(_streak, length=length), "ticker string, ts timestamp", "run int", "append", GroupStateTimeout.NoTimeout
    )


def _silence(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, quiet_ms: int) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        yield pd.DataFrame({"ticker": [key[0]], "last_ts": pd.to_datetime([state.get[0]], unit="ms")})
        state.remove()
        return
    last = state.get[0] if state.exists else 0
    for pdf in batches:
        last = max(last, int(pdf["ms"].max()))
    state.update((last,))
    state.setTimeoutTimestamp(max(last + quiet_ms, state.getCurrentWatermarkMs() + 1))


def silent_tickers(ticks: DataFrame, quiet: str = "90 seconds", late: str = "10 seconds") -> DataFrame:
    """(ticker, last_ts) of tickers that have been silent for ``quiet`` of event time."""
    ms = int(pd.Timedelta(quiet).total_seconds() * 1000)
    marked = ticks.select("ticker", "ts", F.unix_millis("ts").alias("ms")).withWatermark("ts", late)
    return marked.groupBy("ticker").applyInPandasWithState(
        partial(_silence, quiet_ms=ms), "ticker string, last_ts timestamp", "last bigint", "append", GroupStateTimeout.EventTimeTimeout
    )


_SIGNAL = "ticker string, ts timestamp, z double, position bigint"


def _signal(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, window: int, least: int, entry: float, exit_: float) -> Iterator[pd.DataFrame]:
    """Rolling buffer and position of one series, carried over micro-batches."""
    packed, held = state.get if state.exists else (b"", 0)
    buffer = list(np.frombuffer(packed))
    rows = pd.concat(list(batches)).sort_values("ts", ignore_index=True)
    zs = []
    for v in rows["value"].to_numpy(float, na_value=np.nan):
        buffer = [*buffer, v][-window:]
        known = np.array(buffer)[~np.isnan(buffer)]
        ok = len(known) >= least and len(known) > 1 and not np.isnan(v)
        zs.append((v - known.mean()) / max(known.std(ddof=1), 1e-10) if ok else np.nan)
    pos, _ = positions(np.array(zs), entry, exit_, start=held)
    state.update((np.array(buffer).tobytes(), int(pos[-1])))
    yield pd.DataFrame({"ticker": key[0], "ts": rows["ts"], "z": zs, "position": pos})


def signals(series: DataFrame, window: int = 24, least: int = 12, entry: float = 1.5, exit_: float = 0.2) -> DataFrame:
    """Z-score and position per (ticker, ts, value) as rows arrive in order; equals the batch operators over the whole."""
    return series.groupBy("ticker").applyInPandasWithState(
        partial(_signal, window=window, least=least, entry=entry, exit_=exit_), _SIGNAL, "buffer binary, position bigint", "append", GroupStateTimeout.NoTimeout
    )


#: A status only ever moves on in this order.
STATUS_RANK = {"new": 0, "accepted": 1, "partially_filled": 2, "canceled": 3, "rejected": 3, "expired": 3, "filled": 4}


def status_rank(c: str) -> Column:
    """The rank of a status; what isn't listed ranks lowest."""
    pairs = [F.lit(x) for k, v in STATUS_RANK.items() for x in (k, v)]
    return F.coalesce(F.create_map(*pairs)[F.lower(F.col(c))], F.lit(-1))


def latest_states(events: DataFrame, key: str, status: str, at: str) -> DataFrame:
    """The state of each key after its events in any order: highest status, then latest time. No backward moves."""
    best = F.max_by(F.struct(*[F.col(f"`{c}`") for c in events.columns]), F.struct(status_rank(status), F.col(at)))
    return events.groupBy(key).agg(best.alias("r")).select("r.*")


def once_within(events: DataFrame, keys: list[str], at: str, within: str = "300 seconds") -> DataFrame:
    """Events of the same keys once within a span of event time; resending one changes nothing."""
    return events.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)
