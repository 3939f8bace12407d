"""Streams give what the batch operators give; file sources and sinks."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import windows as W
from tidemark.operators.asof import asof_backward
from tidemark.operators.kernels import with_positions
from tidemark.sources import files
from tidemark.sources.files import Snapshots
from tidemark.streaming import market as S

T0 = datetime(2024, 1, 2, 9, 30)


def run(df, tmp_path, mode="append"):
    out = str(tmp_path / "out")
    q = df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def stream(spark, rows, schema, tmp_path, parts=3):
    path = str(tmp_path / "in")
    for k in range(parts):
        spark.createDataFrame(rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_minute_bars_equal_batch(spark, tmp_path):
    rows = [("AB"[i % 2], T0 + timedelta(seconds=7 * i), 100.0 + i % 13, float(i % 5), i) for i in range(300)]
    rows.append(("A", T0 + timedelta(hours=3), 1.0, 1.0, 999))
    schema = "ticker string, ts timestamp, price double, size double, seq int"
    got = {(r["ticker"], r["ts"]): tuple(r)[2:] for r in run(S.minute_bars(stream(spark, rows, schema, tmp_path)), tmp_path).collect()}
    at = F.struct("ts", "seq")
    b = spark.createDataFrame(rows[:-1], schema).where("size > 0").groupBy("ticker", F.date_trunc("minute", "ts").alias("m")).agg(F.min_by("price", at), F.max("price"), F.min("price"), F.max_by("price", at), F.sum("size"))
    assert {k: v[:5] for k, v in got.items()} == {(r["ticker"], r["m"]): tuple(r)[2:] for r in b.collect()}


def test_signals_equal_batch(spark, tmp_path):
    rows = [(t, T0 + timedelta(minutes=i), float((i * 37 + k) % 23) if i % 9 else None) for i in range(120) for k, t in enumerate("AB")]
    schema = "ticker string, ts timestamp, value double"
    got = sorted(map(tuple, run(S.signals(stream(spark, rows, schema, tmp_path), 10, 5, 1.0, 0.2), tmp_path).select("ticker", "ts", "position").collect()))
    z = W.zscore(F.col("value"), W.over(["ticker"], ["ts"], (-9, 0)), 5)
    b = with_positions(spark.createDataFrame(rows, schema).withColumn("z", z), ["ticker"], ["ts"], "z", 1.0, 0.2)
    assert got == sorted(map(tuple, b.select("ticker", "ts", "position").collect()))


def test_streaks_and_silence(spark, tmp_path):
    rows = [("A", T0 + timedelta(seconds=i), i in (2, 3, 4, 5, 8)) for i in range(10)]
    got = run(S.streaks(stream(spark, rows, "ticker string, ts timestamp, bad boolean", tmp_path)), tmp_path).collect()
    assert [tuple(r) for r in got] == [("A", T0 + timedelta(seconds=4))]
    more = tmp_path / "silence"
    more.mkdir()
    rows = [("A", T0), ("B", T0 + timedelta(seconds=30)), ("B", T0 + timedelta(seconds=100)), ("B", T0 + timedelta(seconds=130)), ("B", T0 + timedelta(seconds=140)), ("B", T0 + timedelta(seconds=150))]
    got = run(S.silent_tickers(stream(spark, rows, "ticker string, ts timestamp", more)), more).collect()
    assert [tuple(r) for r in got] == [("A", T0)]


def test_alerts_once(spark, tmp_path):
    rows = [("x", T0), ("x", T0 + timedelta(seconds=10)), ("y", T0 + timedelta(seconds=20))]
    got = run(S.once_within(stream(spark, rows, "k string, at timestamp", tmp_path), ["k"], "at"), tmp_path).collect()
    assert sorted(r["k"] for r in got) == ["x", "y"]


def test_bar_mismatches(spark):
    bars = "ticker string, ts timestamp, close double"
    a, b = spark.createDataFrame([("A", T0, 100.0), ("B", T0, 100.0)], bars), spark.createDataFrame([("A", T0, 100.2), ("B", T0, 100.0)], bars)
    assert [r["ticker"] for r in S.bar_mismatches(a, b).collect()] == ["A"]


def test_no_backward_transitions(spark):
    rows = [("o1", "filled", 1), ("o1", "accepted", 2), ("o2", "new", 1), ("o2", "odd", 5), ("o2", "accepted", 3)]
    got = S.latest_states(spark.createDataFrame(rows, "id string, status string, at int"), "id", "status", "at").collect()
    assert sorted(map(tuple, got)) == [("o1", "filled", 1), ("o2", "accepted", 3)]


def test_snapshots(spark):
    t = Snapshots(spark, "k string, v int, at int", ["k"], ["at"])
    assert t.read().count() == 0
    t.upsert(spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 1)], "k string, v int, at int"))
    t.upsert(spark.createDataFrame([("a", 0, 0), ("b", 5, 9), ("c", 1, 1)], "k string, v int, at int"))
    t.upsert(spark.createDataFrame([("a", 9, 9), ("d", 9, 9)], "k string, v int, at int"), only_new=True)
    assert sorted(map(tuple, t.read().collect())) == [("a", 2, 2), ("b", 5, 9), ("c", 1, 1), ("d", 9, 9)]


def test_dated_csv(spark, tmp_path):
    for name, body in {"AAA_2024-01-02.csv": "1,2", "AAA_2024-01-03.csv": "3,4", "B_B_2024-01-03.csv": "5,6"}.items():
        (tmp_path / name).write_text("a,b\n" + body + "\n")
    got = files.dated_csv(spark, str(tmp_path), "a int, b int", start="2024-01-03").collect()
    assert sorted((r["ticker"], r["a"]) for r in got) == [("AAA", 3), ("B_B", 5)]
    assert sorted(r["ticker"] for r in files.tickers_of(spark, str(tmp_path)).collect()) == ["AAA", "B_B"]


def test_numbers_markers_logs_and_contracts(spark):
    df = spark.createDataFrame([("1,234.5",), ("Halted",), ("x",), (None,)], "t string")
    n, flag = files.numeric_with_markers("t")
    assert [tuple(r) for r in df.select(n, flag).collect()] == [(1234.5, False), (None, True), (None, False), (None, False)]
    lines = spark.createDataFrame([("2024-01-02 09:30 INFO fill ABC 5@9.9",), ("nonsense",), (None,), ("2024-01-02 09:31 WARN late",)], "value string")
    events = files.log_events(lines)
    assert [r["event"] for r in events.collect()] == ["fill", "late"]
    assert [r[0] for r in files.log_lines(events).collect()] == [lines.collect()[0][0], lines.collect()[3][0]]
    assert files.missing_columns(df, spark.createDataFrame([], "t string, u int").schema) == ["u"]
    assert spark.createDataFrame([(1_704_187_800_123_456_789,)], "n bigint").select(files.utc_nanoseconds("n")).head()[0] == datetime(2024, 1, 2, 9, 30, 0, 123456)
    walk = files.random_walk(spark, 2, 50)
    assert walk.collect() == files.random_walk(spark, 2, 50).collect() and walk.count() == 100


def test_write_by(spark, tmp_path):
    files.write_by(spark.createDataFrame([(1, "a"), (2, "b")], "fold int, v string"), str(tmp_path / "t"), ["fold"])
    assert spark.read.parquet(str(tmp_path / "t")).where("fold = 2").head()["v"] == "b"


@pytest.mark.parametrize("span", ["minute", "day"])
def test_asof(spark, span):
    r = [("a", T0 + timedelta(minutes=m), float(m)) for m in (0, 5, 5, 3000)] + [("a", None, 1.0), (None, T0, 1.0)]
    l = [("a", T0 + timedelta(minutes=m), m) for m in (-1, 0, 4, 5, 2999, 3001)] + [("b", T0, 9), (None, T0, 9), ("a", None, 9)]
    right, left = spark.createDataFrame(r, "k string, at timestamp, v double"), spark.createDataFrame(l, "k string, at timestamp, v0 int")
    got = [x["v"] for x in asof_backward(left, right, "k", "at", ["v"], span).orderBy(F.col("k").desc(), "at").collect()]
    assert got[:1] == [None] and got[1] is None and got[2:] [0] is None and got[3:8] == [0.0, 0.0, 5.0, 5.0, 3000.0]
    filled = asof_backward(left, right, "k", "at", ["v"], span, fallback={"v": 30.0})
    assert filled.where("v = 30").count() == 4 and filled.count() == 9
    assert asof_backward(left, right.limit(0), "k", "at", ["v"], span).where("v is not null").count() == 0
