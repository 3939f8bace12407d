"""Conversations from message rows, by keyed streaming state (problem 1).

State is kept per bucket of conversations: one call then takes in, closes and judges many of them as arrays, where a
call for each would cost milliseconds of Python. What is held is a message's time, speaker, visibility and content hash,
not the contents.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.instants import BLANKS, with_instant
from tidemark.sources.scratch import discard, fresh_path

# ---- fixed values -------------------------------------------------------------------------------------------
#: Everyday spellings of the four speakers, in lower case.
SPEAKERS = {
    "user": ["user", "human", "customer", "end_user", "prompter", "person"],
    "assistant": ["assistant", "bot", "ai", "model", "agent", "gpt", "chatbot", "assistant_message"],
    "tool": ["tool", "tool_result", "tool_call", "tool_use", "function", "function_call", "tool_response", "observation"],
    "system": ["system", "developer", "sys", "instruction"],
}
#: A content is visible if it has a character that is none of these: white space of any kind, BOM, zero width.
INVISIBLE = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}-\x{2064}\x{3000}\x{FEFF}\x{00AD}\x{180E}\x{061C}]"
# ---- end of fixed values ------------------------------------------------------------------------------------

_CODES = ["user", "assistant", "tool", "system"]
NO_TIME = np.iinfo(np.int64).min
#: What is held of a message until its conversation closes.
_HELD = pa.schema([("cascade_id", pa.string()), ("arrived_ms", pa.int64()), ("ns", pa.int64()), ("hash", pa.int64()), ("id", pa.int64()), ("who", pa.int8()), ("visible", pa.bool_())])
#: Conversations that have closed, and until when what still comes for them counts as late.
_CLOSED = pa.schema([("cascade_id", pa.string()), ("until_ms", pa.int64())])
_STATE = "held binary, closed binary"
#: A row is the verdict on a closed conversation, or, with ``late`` set, a message that came after its closing.
VERDICTS = "cascade_id string, closed_ms bigint, fault string, ordered array<bigint>, late bigint"
FAULTS = np.array(["broken", "empty", "starts with the assistant", "no reply at the end", "no reply between", None], object)


def speaker(role: str) -> Column:
    """The speaker a role names, null if it names none."""
    key = F.lower(F.btrim(F.col(role), F.lit(BLANKS)))
    out = F.lit(None).cast("string")
    for name, spelled in SPEAKERS.items():
        out = F.when(key.isin(*spelled), name).otherwise(out)
    return out


def judge(messages: pa.Table) -> pd.DataFrame:
    """(cascade_id, fault, ordered message ids) of all conversations that ``messages`` (``_HELD``) belong to.

    Messages go by time, then speaker (user first), then id. Rows of the same time and content count once, as the first
    by speaker and id, except that a row whose speaker can't be made out is never hidden behind a copy.
    """
    names = messages.column("cascade_id").combine_chunks().dictionary_encode()
    conversation = np.asarray(names.indices)
    ns, content, ids, who, visible = (messages.column(c).to_numpy() for c in ("ns", "hash", "id", "who", "visible"))
    order = np.lexsort((ids, who, content, ns, conversation))
    a, b = order[1:], order[:-1]
    twin = np.append(False, (conversation[a] == conversation[b]) & (ns[a] == ns[b]) & (content[a] == content[b]) & (who[b] >= 0))
    order = order[~twin]
    order = order[np.lexsort((ids[order], who[order], ns[order], conversation[order]))]
    conversation, ns, who, visible = conversation[order], ns[order], who[order], visible[order]
    n = len(names.dictionary)

    def any_of(flag: np.ndarray, of: np.ndarray = conversation) -> np.ndarray:
        return np.bincount(of[flag], minlength=n) > 0

    turn = visible & (who >= 0) & (who <= 1)
    talk, speaks = conversation[turn], who[turn]
    first, last = np.ones(len(talk), bool), np.ones(len(talk), bool)
    first[1:] = last[:-1] = talk[1:] != talk[:-1]
    again = ~first & (speaks == 0) & np.append(False, speaks[:-1] == 0)
    tests = [
        any_of((who < 0) | (ns == NO_TIME)), ~any_of(speaks == 0, talk) | ~any_of(speaks == 1, talk),
        any_of(first & (speaks == 1), talk), any_of(last & (speaks == 0), talk), any_of(again, talk),
    ]
    which = np.select(tests, range(len(tests)), len(tests))
    ends = np.searchsorted(conversation, np.arange(1, n + 1))
    return pd.DataFrame({"cascade_id": names.dictionary.to_pylist(), "fault": FAULTS[which], "ordered": [x.tolist() for x in np.split(ids[order], ends[:-1])] if n else []})


def _packed(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as out:
        out.write_table(t)
    return sink.getvalue().to_pybytes()


def _unpacked(held: bytes | None, schema: pa.Schema) -> pa.Table:
    return pa.ipc.open_stream(held).read_all() if held else schema.empty_table()


def _bucket(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, idle_ms: int, grace_ms: int) -> Iterator[pd.DataFrame]:
    """The state machine of one bucket: buffers messages, closes the conversations for which nothing has come for
    ``idle_ms`` of event time, and drops them from the state. For ``grace_ms`` their ids stay, so that a message that comes
    later still is told apart as late instead of making a conversation of its own."""
    now = state.getCurrentWatermarkMs()
    held, closed = (_unpacked(x, schema) for x, schema in zip(state.get if state.exists else (None, None), (_HELD, _CLOSED)))
    closed = closed.filter(pc.greater(closed.column("until_ms"), now))
    last = held.group_by("cascade_id").aggregate([("arrived_ms", "max")])
    over = last.filter(pc.less_equal(last.column("arrived_ms_max"), now - idle_ms)).column("cascade_id")
    if len(over):
        due = pc.is_in(held.column("cascade_id"), over.combine_chunks())
        yield judge(held.filter(due)).assign(closed_ms=now, late=None)
        held = held.filter(pc.invert(due))
        closed = pa.concat_tables([closed, pa.table([over, pa.array([now + grace_ms] * len(over))], schema=_CLOSED)])
    gone = closed.column("cascade_id").combine_chunks()
    for pdf in batches:
        fresh = pa.Table.from_pandas(pdf.loc[pdf["cascade_id"].notna(), _HELD.names], _HELD, preserve_index=False)
        late = pc.is_in(fresh.column("cascade_id"), gone)
        held = pa.concat_tables([held, fresh.filter(pc.invert(late))])
        behind = fresh.filter(late)
        if behind.num_rows:
            yield pd.DataFrame({"cascade_id": behind.column("cascade_id").to_pylist(), "closed_ms": now, "fault": None, "ordered": None, "late": behind.column("id").to_pylist()})
    if not held.num_rows and not closed.num_rows:
        if state.exists:
            state.remove()
        return
    state.update((_packed(held), _packed(closed)))
    last = held.group_by("cascade_id").aggregate([("arrived_ms", "max")]).column("arrived_ms_max")
    wake = [pc.min(last).as_py() + idle_ms] if len(last) else []
    wake += [pc.min(closed.column("until_ms")).as_py()] if closed.num_rows else []
    state.setTimeoutTimestamp(max(min(wake), now + 1))


def message_events(rows: DataFrame) -> DataFrame:
    """Message rows as slim events: what the verdict needs, without the contents themselves.

    ``ns`` is the time in nanoseconds since 1970 (UTC texts of any number of digits), ``NO_TIME`` if it names none;
    ``who`` the speaker's code, -1 if none. Rows without a cascade id belong to no conversation and are left out.
    """
    slim = rows.where("cascade_id is not null").select(
        F.lower(F.btrim(F.col("cascade_id"), F.lit(BLANKS))).alias("cascade_id"),
        F.col("message_id").cast("bigint").alias("id"),
        "role", "content", "message_ts", F.col("exported_ts").alias("arrived"),
        F.lit("UTC").alias("__utc"), F.lit("YMD").alias("__ymd"),
    )
    timed = with_instant(slim, "message_ts", "us", "__utc", "__ymd")
    finer = F.rpad(F.regexp_extract("message_ts", r"[.,]\d{6}(\d{1,3})", 1), 3, "0").cast("int")
    code = F.array_position(F.array(*[F.lit(c) for c in _CODES]), speaker("role")).cast("int") - 1
    return timed.select(
        "cascade_id", "id", "arrived",
        F.coalesce(F.col("us") * 1000 + finer, F.lit(NO_TIME)).alias("ns"),
        F.coalesce(F.xxhash64("content"), F.lit(0)).alias("hash"),
        F.coalesce(code, F.lit(-1)).cast("tinyint").alias("who"),
        F.coalesce(F.length(F.regexp_replace("content", INVISIBLE, "")) > 0, F.lit(False)).alias("visible"),
    )


def conversation_stream(events: DataFrame, idle: str = "30 days", delay: str = "1 hour", grace: str = "365 days", buckets: int = 1024) -> DataFrame:
    """The streaming operator: events of ``message_events`` with a watermark on ``arrived`` -> ``VERDICTS``.

    A conversation closes when the watermark has passed its last arrival by ``idle``; its messages then leave the state.
    The watermark runs on arrival, not on the messages' own times: these are part of what is judged, may be missing or
    decades off, and one wrong year would close everything. No row is dropped for being behind the watermark: the event time is
    carried by rows of its own, so a message however late is buffered while its conversation is open, and comes out with
    ``late`` set for ``grace`` after it has closed; later still it makes a new conversation. ``buckets`` is how many keys
    the state is kept under, fixed for the life of a checkpoint: choose it so that one holds some ten thousand messages.
    """
    idle_ms, grace_ms = (int(pd.Timedelta(x).total_seconds() * 1000) for x in (idle, grace))
    message = ~F.col("tick")
    both = events.withColumn("tick", F.explode(F.array(F.lit(False), F.lit(True)))).select(
        F.when(F.col("tick"), F.col("arrived")).alias("clock"),
        F.coalesce(F.pmod(F.xxhash64("cascade_id"), F.lit(buckets)), F.lit(0)).cast("int").alias("bucket"),
        F.when(message, F.coalesce(F.unix_millis("arrived"), F.lit(0))).alias("arrived_ms"),
        *[F.when(message, F.col(c)).alias(c) for c in ("cascade_id", "ns", "hash", "id", "who", "visible")],
    )
    return both.withWatermark("clock", delay).groupBy("bucket").applyInPandasWithState(
        partial(_bucket, idle_ms=idle_ms, grace_ms=grace_ms), VERDICTS, _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


#: Messages that a bucket of a bounded export holds, about.
_BUCKET_ROWS = 20_000


def assemble(rows: DataFrame, slices: int = 1, idle: str = "30 days", delay: str = "1 hour") -> DataFrame:
    """The final verdict on every conversation of a bounded export, by replaying it through the stream:
    (cascade_id, fault, ordered message ids).

    The export is laid down in ``slices`` by time of arrival, each is run through the stream with the same
    checkpoint (in the session's state store; for a state beyond the executors' memory that is RocksDB), and a closing
    mark then moves the watermark past every open conversation. With more than one slice a conversation can have
    messages that came after it closed: it is judged anew with them. ``slices`` thus changes how the state is built up,
    not the result. An empty export gives no rows.
    """
    spark = rows.sparkSession
    root = fresh_path(spark, "conversations")
    low, high, many = rows.agg(F.min(F.unix_millis("exported_ts")), F.max(F.unix_millis("exported_ts")), F.count("*")).head()
    low, high = low or 0, high or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), many // _BUCKET_ROWS)
    events = message_events(rows)
    schema = events.schema
    beyond = 2 * int((pd.Timedelta(idle) + pd.Timedelta(delay)).total_seconds() * 1000)
    mark = spark.range(1).select(
        *[F.timestamp_millis(F.lit(high + beyond)).alias(f.name) if f.name == "arrived" else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    )
    at = F.coalesce(F.unix_millis("arrived"), F.lit(low))
    for k in range(slices):
        a, b = (low + (high - low) * i // slices for i in (k, k + 1))
        after = F.lit(True) if k == 0 else at > a
        part = events.where(after & (F.lit(True) if k == slices - 1 else at <= b))
        part.write.mode("append").parquet(f"{root}/in")
        if k == slices - 1:
            mark.write.mode("append").parquet(f"{root}/in")
        out = conversation_stream(spark.readStream.schema(schema).parquet(f"{root}/in"), idle, delay, buckets=buckets)
        sink = out.writeStream.format("parquet").outputMode("append").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
        sink.trigger(availableNow=True).start().awaitTermination()
    given = spark.read.schema(VERDICTS).parquet(f"{root}/out")
    verdicts = given.where("late is null").select("cascade_id", "fault", "ordered")
    late = given.where("late is not null").select("cascade_id").distinct()
    if slices == 1 or late.isEmpty():
        discard(spark, f"{root}/in")
        discard(spark, f"{root}/checkpoint")
        return verdicts
    held = spark.read.schema(schema).parquet(f"{root}/in").join(late, "cascade_id", "left_semi").withColumn("arrived_ms", F.unix_millis("arrived"))
    anew = held.groupBy(F.pmod(F.xxhash64("cascade_id"), F.lit(buckets)).alias("bucket")).applyInPandas(
        lambda pdf: judge(pa.Table.from_pandas(pdf[_HELD.names], _HELD, preserve_index=False)), "cascade_id string, fault string, ordered array<bigint>"
    )
    return verdicts.join(late, "cascade_id", "left_anti").unionByName(anew)


def transcripts(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The sound conversations, rebuilt: (cascade_id, position, message_id, speaker, content), positions from 0."""
    places = verdicts.where("fault is null").select("cascade_id", F.posexplode("ordered").alias("position", "mid"))
    said = rows.select(F.col("message_id").alias("mid"), speaker("role").alias("speaker"), "content")
    return places.join(said, "mid").select("cascade_id", "position", F.col("mid").alias("message_id"), "speaker", "content")
