"""Instants in SQL: the independent reading of texts that the problems' SQL starts from."""

from __future__ import annotations

#: ``src`` must have (src_table, row_id, txt, feed); ``inst`` adds ``us``, microseconds since 1970 UTC, null if none.
INSTANTS = r"""
src_z AS (SELECT s.*, f.clock_zone AS zone, f.date_order AS ord, trim(txt, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS s
  FROM src s LEFT JOIN (SELECT DISTINCT feed, clock_zone, date_order FROM feeds) f ON f.feed = s.feed),
src_d AS (SELECT *, CASE
    WHEN regexp_matches(s, '^\d{4}-\d{2}-\d{2}[T ]') THEN substr(s, 1, 10)
    WHEN regexp_matches(s, '^\d{8}T\d{4}') THEN substr(s, 1, 4) || '-' || substr(s, 5, 2) || '-' || substr(s, 7, 2)
    WHEN regexp_matches(s, '^\d{4}/\d{1,2}/\d{1,2} ') THEN replace(split_part(s, ' ', 1), '/', '-')
    WHEN regexp_matches(s, '^\d{1,2}/\d{1,2}/\d{4} ') AND ord = 'MDY' THEN split_part(split_part(s, ' ', 1), '/', 3) || '-' || split_part(s, '/', 1) || '-' || split_part(s, '/', 2)
    WHEN regexp_matches(s, '^\d{1,2}/\d{1,2}/\d{4} ') AND ord = 'DMY' THEN split_part(split_part(s, ' ', 1), '/', 3) || '-' || split_part(s, '/', 2) || '-' || split_part(s, '/', 1)
    WHEN regexp_matches(s, '^\d{2}-[A-Z][a-z]{2}-\d{4} ') THEN strftime(try_strptime(substr(s, 1, 11), '%d-%b-%Y'), '%Y-%m-%d')
    WHEN regexp_matches(s, '^[A-Z][a-z]{2}, \d{2} [A-Z][a-z]{2} \d{4} ') THEN strftime(try_strptime(substr(s, 6, 11), '%d %b %Y'), '%Y-%m-%d') END AS d,
  CASE WHEN regexp_matches(s, '^\d{4}-\d{2}-\d{2}[T ]') THEN substr(s, 12)
    WHEN regexp_matches(s, '^\d{8}T\d{4}') THEN substr(s, 10, 2) || ':' || substr(s, 12, 2) || ':' || substr(s, 14)
    WHEN regexp_matches(s, '^[A-Z][a-z]{2}, ') THEN substr(s, 18)
    ELSE substr(s, instr(s, ' ') + 1) END AS rest FROM src_z),
src_c AS (SELECT *, regexp_extract(rest, '^(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?: ?([AP]M))?(?: ?(Z|[+-]\d{2}:?\d{2}|[A-Z]{3,4}))?(?:\[.*\])?$', ['h', 'mi', 's', 'f', 'half', 'z']) AS c FROM src_d),
src_l AS (SELECT *, c.z AS z, try_cast(d || ' ' || CASE c.half WHEN '' THEN c.h WHEN 'AM' THEN CAST(try_cast(c.h AS INT) % 12 AS VARCHAR) ELSE CAST(try_cast(c.h AS INT) % 12 + 12 AS VARCHAR) END
    || ':' || c.mi || ':' || CASE c.s WHEN '' THEN '00' ELSE c.s END || '.' || rpad(substr(c.f, 1, 6), 6, '0') AS TIMESTAMP) AS l,
  regexp_matches(s, '^\d{9,20}([.]\d+)?$') AS bare FROM src_c),
inst AS (SELECT src_table, row_id, txt, CASE
    WHEN bare THEN CASE WHEN length(split_part(s, '.', 1)) <= 11 THEN try_cast(split_part(s, '.', 1) || rpad(substr(split_part(s, '.', 2), 1, 6), 6, '0') AS BIGINT)
      WHEN length(s) <= 14 THEN try_cast(s || '000' AS BIGINT) WHEN length(s) <= 17 THEN try_cast(s AS BIGINT) ELSE try_cast(substr(s, 1, length(s) - 3) AS BIGINT) END
    WHEN l IS NULL OR c.h = '' THEN NULL
    WHEN z = '' THEN epoch_us(l AT TIME ZONE zone)
    WHEN z IN ('Z', 'UTC') OR z = 'GMT' THEN epoch_us(l)
    WHEN z[1] IN ('+', '-') THEN epoch_us(l) - (CASE z[1] WHEN '-' THEN -1 ELSE 1 END) * (try_cast(substr(z, 2, 2) AS BIGINT) * 60 + try_cast(right(z, 2) AS BIGINT)) * 60000000
    WHEN zone = 'America/New_York' AND z IN ('EST', 'EDT') THEN epoch_us(l) + CASE z WHEN 'EST' THEN 300 ELSE 240 END * 60000000::BIGINT
    WHEN zone = 'Europe/London' AND z = 'BST' THEN epoch_us(l) - 60 * 60000000::BIGINT
    WHEN zone = 'Asia/Tokyo' AND z = 'JST' THEN epoch_us(l) - 540 * 60000000::BIGINT END AS us FROM src_l)
"""
TICKS = "SELECT 'ticks' AS src_table, tick_id AS row_id, ts AS txt, feed FROM ticks"
ORDERS = "SELECT 'live_orders' AS src_table, order_no AS row_id, filled_ts AS txt, feed FROM live_orders"
ENTRIES = "SELECT 'positions' AS src_table, position_id AS row_id, entry_ts AS txt, feed FROM positions"
EXITS = "SELECT 'exits' AS src_table, position_id AS row_id, exit_ts AS txt, feed FROM positions"


def instants_of(*sources: str) -> str:
    """The opening of a query with ``inst`` over the given sources."""
    return "WITH src AS (" + " UNION ALL ".join(sources) + ")," + INSTANTS


#: Session dates of the bars: (bar_id, day).
SESSIONS = r"""
bar_d AS (SELECT b.bar_id, b.ts_date AS txt, trim(ts_date, ' ' || chr(9) || chr(10) || chr(13)) AS s, f.date_order AS ord FROM bars b LEFT JOIN (SELECT DISTINCT feed, date_order FROM feeds) f ON f.feed = b.feed),
sessions AS (SELECT bar_id, txt, CASE
    WHEN regexp_matches(s, '^\d{4}-\d{2}-\d{2}( 00:00:00)?$') THEN try_cast(substr(s, 1, 10) AS DATE)
    WHEN regexp_matches(s, '^\d{8}$') THEN CAST(try_strptime(s, '%Y%m%d') AS DATE)
    WHEN regexp_matches(s, '^\d{4}/\d{2}/\d{2}$') OR (ord = 'YMD' AND regexp_matches(s, '^\d{2}/\d{2}/\d{2}$')) THEN CAST(try_strptime(CASE length(s) WHEN 8 THEN '20' ELSE '' END || s, '%Y/%m/%d') AS DATE)
    WHEN regexp_matches(s, '^\d{2}/\d{2}/\d{4}$') THEN CAST(CASE ord WHEN 'MDY' THEN try_strptime(s, '%m/%d/%Y') WHEN 'DMY' THEN try_strptime(s, '%d/%m/%Y') END AS DATE)
    WHEN regexp_matches(s, '^\d{2}/\d{2}/\d{2}$') THEN CAST(CASE ord WHEN 'MDY' THEN try_strptime(substr(s, 1, 6) || '20' || right(s, 2), '%m/%d/%Y') WHEN 'DMY' THEN try_strptime(substr(s, 1, 6) || '20' || right(s, 2), '%d/%m/%Y') END AS DATE)
    WHEN regexp_matches(s, '^\d{2}-[A-Z][a-z]{2}-\d{4}$') THEN CAST(try_strptime(s, '%d-%b-%Y') AS DATE)
    WHEN regexp_matches(s, '^[A-Z][a-z]{2} \d{1,2}, \d{4}$') THEN CAST(try_strptime(s, '%b %d, %Y') AS DATE)
    WHEN regexp_matches(s, '^\d{10}$') THEN CAST(to_timestamp(try_cast(s AS BIGINT)) AT TIME ZONE 'America/New_York' AS DATE)
    WHEN regexp_matches(s, '^\d{13}$') THEN CAST(to_timestamp(try_cast(s AS BIGINT) / 1000) AT TIME ZONE 'America/New_York' AS DATE)
    WHEN regexp_matches(s, '^\d{4}-\d{2}-\d{2}T.*(Z|[+-]\d{2}:\d{2})$') THEN CAST(try_cast(s AS TIMESTAMPTZ) AT TIME ZONE 'America/New_York' AS DATE) END AS day FROM bar_d)
"""
P4 = instants_of(TICKS, ORDERS, ENTRIES) + "," + SESSIONS + r"""
SELECT src_table, row_id, us AS utc_us FROM inst WHERE us IS NOT NULL AND NOT regexp_full_match(txt, '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[.]\d{6}[+]00:00')
UNION ALL SELECT 'bars', bar_id, epoch_us(CAST(day AS TIMESTAMP)) FROM sessions WHERE day IS NOT NULL AND NOT regexp_full_match(txt, '\d{4}-\d{2}-\d{2}')
"""
P5 = instants_of(TICKS) + """, good AS (SELECT DISTINCT t.ticker, i.us // 300000000 * 300 AS slot FROM inst i JOIN ticks t ON t.tick_id = i.row_id WHERE us IS NOT NULL AND price > 0 AND size > 0 AND ticker IS NOT NULL),
days AS (SELECT ticker, CAST(to_timestamp(slot) AT TIME ZONE 'America/New_York' AS DATE) AS day, min(slot) AS a, max(slot) AS b FROM good GROUP BY 1, 2),
grid AS (SELECT ticker, unnest(generate_series(a, b, 300)) AS slot FROM days)
SELECT g.ticker, CAST(g.slot AS BIGINT) AS slot_start FROM grid g ANTI JOIN good ON good.ticker = g.ticker AND good.slot = g.slot
"""
P6 = instants_of(ENTRIES, EXITS) + """, r AS (SELECT upper(trim(p.pair_id)) AS k, a.us AS s, b.us AS e FROM positions p JOIN inst a ON a.src_table = 'positions' AND a.row_id = p.position_id JOIN inst b ON b.src_table = 'exits' AND b.row_id = p.position_id
  WHERE p.pair_id IS NOT NULL AND b.us > a.us),
m AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m),
p AS (SELECT k, island, min(s) AS s, max(e) AS e FROM i GROUP BY 1, 2)
SELECT 'period' AS kind, k AS pair_id, s AS start_us, e AS end_us FROM p
UNION ALL SELECT 'gap', k, before, s FROM (SELECT k, s, lag(e) OVER (PARTITION BY k ORDER BY island) AS before FROM p) WHERE before IS NOT NULL
"""
P7 = instants_of(TICKS) + "," + SESSIONS + """, v AS (
  SELECT 'ticks' AS src_table, tick_id AS row_id, 'price' AS field, ticker, us AS moment, CAST(to_timestamp(us / 1000000) AT TIME ZONE 'America/New_York' AS DATE) AS day, price AS v, 20 AS most FROM inst JOIN ticks ON tick_id = row_id WHERE us IS NOT NULL
  UNION ALL SELECT 'bars', b.bar_id, 'close', ticker, epoch_us(CAST(day AS TIMESTAMP)), day, close, 20 FROM bars b JOIN sessions s ON s.bar_id = b.bar_id WHERE day IS NOT NULL
  UNION ALL SELECT 'bars', b.bar_id, 'volume', ticker, epoch_us(CAST(day AS TIMESTAMP)), day, volume, 10 FROM bars b JOIN sessions s ON s.bar_id = b.bar_id WHERE day IS NOT NULL),
n AS (SELECT *, CASE WHEN field = 'volume' THEN v < 0 ELSE v <= 0 END AS impossible FROM v WHERE v IS NOT NULL AND NOT isnan(v) AND ticker IS NOT NULL),
x AS (SELECT *, CASE WHEN field = 'volume' THEN ln(v + 1) ELSE ln(v) END AS x FROM n WHERE NOT impossible),
w AS (SELECT *, abs(x - lag(x) OVER w) AS step, row_number() OVER w AS i, lag(x, 1) OVER w AS m1, lag(x, 2) OVER w AS m2, lag(x, 3) OVER w AS m3, lead(x, 1) OVER w AS p1, lead(x, 2) OVER w AS p2, lead(x, 3) OVER w AS p3,
  CASE WHEN v = lag(v) OVER w AND (src_table = 'bars' OR day = lag(day) OVER w) THEN 0 ELSE 1 END AS fresh FROM x WINDOW w AS (PARTITION BY src_table, field, ticker ORDER BY moment, row_id)),
t AS (SELECT src_table, field, ticker, median(step) AS typical FROM w GROUP BY 1, 2, 3),
d AS (SELECT w.src_table, w.row_id, w.field, typical * most AS far, greatest(
    greatest(x - greatest(m1, p1), least(m1, p1) - x),
    CASE WHEN m1 + p1 + p2 IS NOT NULL THEN greatest(least(x, p1) - greatest(m1, p2), least(m1, p2) - greatest(x, p1)) END,
    CASE WHEN m2 + m1 + p1 IS NOT NULL THEN greatest(least(x, m1) - greatest(m2, p1), least(m2, p1) - greatest(x, m1)) END,
    CASE WHEN m1 + p1 + p2 + p3 IS NOT NULL THEN greatest(least(x, p1, p2) - greatest(m1, p3), least(m1, p3) - greatest(x, p1, p2)) END,
    CASE WHEN m2 + m1 + p1 + p2 IS NOT NULL THEN greatest(least(x, m1, p1) - greatest(m2, p2), least(m2, p2) - greatest(x, m1, p1)) END,
    CASE WHEN m3 + m2 + m1 + p1 IS NOT NULL THEN greatest(least(x, m1, m2) - greatest(m3, p1), least(m3, p1) - greatest(x, m1, m2)) END) AS dev, m1, p1
  FROM w JOIN t ON t.src_table = w.src_table AND t.field = w.field AND t.ticker = w.ticker),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY src_table, field, ticker ORDER BY moment, row_id ROWS UNBOUNDED PRECEDING) AS run FROM w),
s AS (SELECT src_table, field, ticker, run FROM g GROUP BY 1, 2, 3, 4 HAVING CASE WHEN src_table = 'bars' THEN count(DISTINCT day) >= 5 ELSE count(*) >= 10 END)
SELECT src_table, row_id, field FROM n WHERE impossible
UNION SELECT src_table, row_id, field FROM d WHERE dev > far AND m1 IS NOT NULL AND p1 IS NOT NULL
UNION SELECT g.src_table, g.row_id, g.field FROM g JOIN s ON s.src_table = g.src_table AND s.field = g.field AND s.ticker = g.ticker AND s.run = g.run
"""
