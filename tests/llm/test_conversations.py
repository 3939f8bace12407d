"""Conversations through the stream against a plain reading of the rules."""

import random
import re
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from tidemark.llm.conversations import _HELD, NO_TIME, assemble, conversation_stream, judge, message_events, transcripts

SCHEMA = "message_id bigint, cascade_id string, title string, role string, tool_name string, content string, message_ts string, exported_ts timestamp, ns string"
T0 = datetime(2025, 1, 1)


def row(i, c, role, content, ts, late=0):
    return (i, c, None, role, None, content, ts, T0 + timedelta(days=late), "x")


def iso(s):
    return (T0 + timedelta(seconds=s)).isoformat() + "Z"


def brute(rows):
    names = {"user": "user human", "assistant": "assistant bot ai model", "tool": "tool function tool_result", "system": "system developer"}
    who = {w: k for k, v in names.items() for w in v.split()}
    by: dict = {}
    for r in rows:
        if r[1] is not None:
            by.setdefault(r[1].lower(), []).append(r)
    out = set()
    for c, rs in by.items():
        seen, bad = {}, False
        for r in rs:
            role, ok = who.get((r[3] or "").strip().lower()), re.fullmatch(r"2025-01-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z", r[6] or "")
            bad |= not role or not ok
            seen[r[6], r[5]] = role
        turns = [w for (t, x), w in sorted(seen.items(), key=lambda k: (k[0][0] or "", k[1] or "")) if w in ("user", "assistant") and re.sub(r"[\s​﻿ ]", "", x or "")]
        if bad or "user" not in turns or "assistant" not in turns or turns[0] == "assistant" or turns[-1] == "user" or "user user" in " ".join(turns):
            out.add(c)
    return out


@pytest.mark.parametrize("slices", [1, 3])
def test_against_the_rules(spark, slices):
    rng, rows = random.Random(7), []
    for c in range(60):
        turn, s = rng.choice(["user", "user", "user", "assistant"]), c
        for _ in range(rng.randrange(1, 7)):
            role = {"user": ["user", "Human", " USER"], "assistant": ["assistant", "bot", "AI", "model"]}[turn]
            s += rng.randrange(1, 90)
            cid = rng.choice([f"C{c}", f"c{c}"])
            rows.append(row(len(rows), cid, rng.choice(role) if rng.random() > 0.03 else rng.choice([None, "?", ""]), rng.choice(["hi", "yes", "long " * 2000]) if rng.random() > 0.1 else rng.choice(["", " ", "​", "﻿", None, "\t\n"]), iso(s) if rng.random() > 0.03 else rng.choice([None, "invalid date", "2025-13-41T99:00:00Z"]), rng.choice([0, 1, 80])))
            if rng.random() < 0.15:
                rows.append((len(rows), *rows[-1][1:7], T0 + timedelta(days=90), "x"))
            if rng.random() < 0.2:
                rows.append(row(len(rows), cid, "tool", "ok", iso(s)))
            if rng.random() < 0.85:
                turn = "assistant" if turn == "user" else "user"
    rows += [row(9000, None, "user", "x", iso(1)), row(9001, "only", "system", "x", iso(1))]
    rng.shuffle(rows)
    got = assemble(spark.createDataFrame(rows, SCHEMA), slices=slices, idle="2 days")
    faults = {r["cascade_id"]: r["fault"] for r in got.collect()}
    assert {c for c, f in faults.items() if f} == brute(rows)
    assert set(faults) == {r[1].lower() for r in rows if r[1]}


def test_late_message_mends_a_closed_conversation(spark):
    rows = [row(1, "A", "user", "q", iso(1)), row(2, "a", "assistant", "answer", iso(2), late=200), row(3, "b", "user", "q", iso(5)), row(4, "B", "bot", "a", iso(5.5))]
    df = spark.createDataFrame(rows, SCHEMA)
    v = assemble(df, slices=2, idle="5 days")
    assert v.where("fault is not null").count() == 0
    got = [tuple(r) for r in transcripts(df, v).orderBy("cascade_id", "position").collect()]
    assert got == [("a", 0, 1, "user", "q"), ("a", 1, 2, "assistant", "answer"), ("b", 0, 3, "user", "q"), ("b", 1, 4, "assistant", "a")]


def test_empty_export(spark):
    assert assemble(spark.createDataFrame([], SCHEMA), slices=1).count() == 0


_MESSAGE = np.dtype([("ns", "<i8"), ("hash", "<i8"), ("id", "<i8"), ("who", "i1"), ("visible", "?")])


def fault_of(m):
    """One conversation, its messages in order."""
    if (m["who"] < 0).any() or (m["ns"] == NO_TIME).any():
        return "broken"
    turns = m["who"][m["visible"] & (m["who"] <= 1)]
    if not (turns == 0).any() or not (turns == 1).any():
        return "empty"
    if turns[0] == 1:
        return "starts with the assistant"
    if turns[-1] == 0:
        return "no reply at the end"
    return "no reply between" if ((turns[1:] == 0) & (turns[:-1] == 0)).any() else None


def in_order(m):
    m = m[np.lexsort((m["id"], m["who"], m["hash"], m["ns"]))]
    twin = np.append(False, (m["ns"][1:] == m["ns"][:-1]) & (m["hash"][1:] == m["hash"][:-1]) & (m["who"][:-1] >= 0))
    m = m[~twin]
    return m[np.lexsort((m["id"], m["who"], m["ns"]))]


def together(conversations):
    rows = [(c, 0, *x.tolist()) for c, m in conversations.items() for x in m]
    random.Random(1).shuffle(rows)
    out = judge(pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_HELD)], schema=_HELD))
    return {r.cascade_id: (r.fault, r.ordered) for r in out.itertuples()}


def test_repeats_count_once_and_never_hide_a_broken_row():
    m = np.array([(5, 1, 10, 0, True), (5, 1, 9, 0, True), (7, 2, 8, 1, True)], _MESSAGE)
    assert together({"a": m})["a"] == (None, [9, 8])
    m["who"][0] = -1
    assert together({"a": m})["a"][0] == "broken"
    m["who"][0], m["ns"][1] = 0, NO_TIME
    assert together({"a": m})["a"][0] == "broken"


def test_many_at_once_as_one_by_one():
    rng = np.random.default_rng(4)
    made = {}
    for c in range(300):
        n = int(rng.integers(1, 7))
        m = np.zeros(n, _MESSAGE)
        m["ns"], m["hash"], m["id"] = rng.integers(0, 4, n), rng.integers(0, 2, n), rng.permutation(n) + 10 * c
        m["who"], m["visible"] = rng.choice([-1, 0, 1, 2], n, p=[0.04, 0.44, 0.44, 0.08]), rng.random(n) < 0.9
        made[f"c{c}"] = m
    got = together(made)
    assert got == {c: (fault_of(in_order(m)), in_order(m)["id"].tolist()) for c, m in made.items()}
    assert len({f for f, _ in got.values()}) == 6


def test_nothing_late_is_dropped(spark, tmp_path):
    """A message behind the watermark joins its open conversation; one whose conversation has closed comes out as late."""

    def say(i, c, role, days):
        return (i, c, None, role, None, "x", iso(i), T0 + timedelta(days=days), "x")

    source, sink, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    batches = [
        [say(1, "a", "user", 0), say(2, "b", "user", 0), say(3, "b", "bot", 0)],
        [say(4, "z", "user", 8)],  # the watermark is at day 8
        [say(5, "a", "bot", 7)],  # behind the watermark by a day, conversation open
        [say(6, "z", "bot", 14)],  # b, idle for ten days, closes
        [say(7, "b", "user", 1)],
    ]
    for rows in batches:
        events = message_events(spark.createDataFrame(rows, SCHEMA))
        events.coalesce(1).write.mode("append").parquet(source)
        out = conversation_stream(spark.readStream.schema(events.schema).parquet(source), idle="10 days", delay="1 minute", buckets=3)
        out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    got = {(r["cascade_id"], r["fault"], tuple(r["ordered"] or ()), r["late"]) for r in spark.read.parquet(sink).collect()}
    assert got == {("b", None, (2, 3), None), ("b", None, (), 7)}
    events.where("false").union(events.limit(1).withColumn("arrived", F.lit(T0 + timedelta(days=400)))).withColumn("cascade_id", F.lit(None).cast("string")).write.mode("append").parquet(source)
    out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    got = {(r["cascade_id"], tuple(r["ordered"] or ()), r["late"]) for r in spark.read.parquet(sink).collect()}
    assert got == {("b", (2, 3), None), ("b", (), 7), ("a", (1, 5), None), ("z", (4, 6), None)}
