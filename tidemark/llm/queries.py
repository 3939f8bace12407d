"""The pN_ queries of the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.conversations import assemble, transcripts
from tidemark.llm.encode import encode_corpus
from tidemark.llm.leakage import leaked_items
from tidemark.llm.nearest import nearest_in_time
from tidemark.llm.residue import residue_kinds
from tidemark.operators.normalise_times import instants
from tidemark.plans.instants_sql import ORDERS, TICKS, instants_of
from tidemark.sources.tables import spread, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that are broken, empty or lack replies."""
    return assemble(table(spark, sf_dir, "conversations_export")).where("fault is not null").select("cascade_id")


def p1_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sound conversations, message by message."""
    rows = table(spark, sf_dir, "conversations_export")
    return transcripts(rows, assemble(rows))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest valid tick of each filled order, at most five seconds away."""
    feeds = table(spark, sf_dir, "feeds")
    ticks = spread(table(spark, sf_dir, "ticks").select("tick_id", "ticker", "ts", "feed", "price").where("price > 0 and not isnan(price)"))
    orders = table(spark, sf_dir, "live_orders").select("order_no", "ticker", "filled_ts", "feed").where("filled_ts is not null")
    return nearest_in_time(
        instants(orders, feeds, "filled_ts", "us"), instants(ticks, feeds, "ts", "us"),
        "ticker", "us", "us", "order_no", "tick_id", tolerance_us=5_000_000,
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and whole texts of all documents."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document by the byte-level vocabulary of 50,000."""
    return encode_corpus(documents(spark, sf_dir), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item or a good part of it, and which item."""
    return leaked_items(documents(spark, sf_dir), table(spark, sf_dir, "eval_items"), "doc_id", "text", "item_id", "passage")


def p10_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that show residue where content should be, and of what kind."""
    return residue_kinds(documents(spark, sf_dir), "doc_id", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that show residue where content should be."""
    return p10_kinds(spark, sf_dir).select("doc_id")


QUERIES = {
    "p1_found": p1_found, "p1_conversations": p1_conversations, "p2_found": p2_found, "p8_ids": p8_ids, "p9_found": p9_found,
    "p10_kinds": p10_kinds, "p10_found": p10_found,
}
_P1_SQL = r"""
WITH m AS (
  SELECT lower(trim(cascade_id)) AS c, message_id AS id, content, lower(trim(role)) AS r,
    CASE WHEN regexp_matches(message_ts, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.]\d+)?Z$') AND try_cast(substr(message_ts, 1, 19) AS TIMESTAMP) IS NOT NULL
      THEN substr(message_ts, 1, 19) || rpad(regexp_extract(message_ts, '[.](\d+)Z', 1), 9, '0') END AS t
  FROM conversations_export WHERE cascade_id IS NOT NULL),
s AS (SELECT *, CASE WHEN r IN ('user', 'human', 'customer', 'end_user', 'prompter', 'person') THEN 0 WHEN r IN ('assistant', 'bot', 'ai', 'model', 'agent', 'gpt', 'chatbot', 'assistant_message') THEN 1 WHEN r IN ('tool', 'tool_result', 'tool_call', 'tool_use', 'function', 'function_call', 'tool_response', 'observation') THEN 2 WHEN r IN ('system', 'developer', 'sys', 'instruction') THEN 3 END AS who,
  coalesce(length(regexp_replace(content, '[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}-\x{2064}\x{3000}\x{FEFF}\x{AD}\x{180E}\x{61C}]', '', 'g')), 0) > 0 AS visible FROM m),
once AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY c, t, content ORDER BY who, id) = 1),
turns AS (SELECT *, lag(who) OVER w AS before, row_number() OVER w AS k, count(*) OVER (PARTITION BY c) AS n FROM once WHERE visible AND who <= 1 WINDOW w AS (PARTITION BY c ORDER BY t, who, id)),
v AS (SELECT c, count(*) FILTER (WHERE who = 0) AS users, count(*) FILTER (WHERE who = 1) AS answers, bool_or(k = 1 AND who = 1) AS bad_start, bool_or(k = n AND who = 0) AS bad_end, bool_or(who = 0 AND before = 0) AS bad_pair FROM turns GROUP BY 1),
b AS (SELECT c, bool_or(who IS NULL OR t IS NULL) AS broken FROM s GROUP BY 1)
SELECT b.c AS cascade_id FROM b LEFT JOIN v ON v.c = b.c WHERE broken OR coalesce(users, 0) = 0 OR coalesce(answers, 0) = 0 OR bad_start OR bad_end OR bad_pair
"""
_P2_SQL = instants_of(TICKS, ORDERS) + """, r AS (SELECT t.ticker, i.us, min(t.tick_id) AS tick_id FROM inst i JOIN ticks t ON t.tick_id = i.row_id WHERE i.src_table = 'ticks' AND i.us IS NOT NULL AND price > 0 GROUP BY 1, 2),
l AS (SELECT o.order_no, o.ticker, i.us FROM inst i JOIN live_orders o ON o.order_no = i.row_id WHERE i.src_table = 'live_orders' AND i.us IS NOT NULL),
c AS (SELECT l.order_no, l.us - r.us AS gap, r.tick_id FROM l ASOF JOIN r ON r.ticker = l.ticker AND r.us <= l.us
  UNION ALL SELECT l.order_no, r.us - l.us, r.tick_id FROM l ASOF JOIN r ON r.ticker = l.ticker AND r.us >= l.us)
SELECT order_no, arg_min(tick_id, (gap, tick_id)) AS tick_id FROM c WHERE gap <= 5000000 GROUP BY 1
"""
SQL: dict[str, str] = {"p1_found": _P1_SQL, "p2_found": _P2_SQL}
