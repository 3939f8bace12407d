"""Texts of points in time to one unambiguous instant.

The cascade is ordered and every pattern is anchored, so a text is read by exactly one rule or by none. A rule
only rewrites the text into ten fields; whether these fields are a real date and time is left to a strict cast, so
30 February or 25 o'clock name no instant. All of it is Catalyst expressions: no Python touches a row.
"""

from __future__ import annotations

import json
from datetime import datetime
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------------------------
#: Blanks that may surround a text.
BLANKS = " \t\n\r\f\x0b   　​﻿"
#: These mean UTC in any feed.
UNIVERSAL = ("Z", "UTC", "GMT", "UT")
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
_MONTH = (
    "(?i:(jan)(?:uary)?|(feb)(?:ruary)?|(mar)(?:ch)?|(apr)(?:il)?|(may)|(june?)|(july?)|(aug)(?:ust)?"
    "|(sept?)(?:ember)?|(oct)(?:ober)?|(nov)(?:ember)?|(dec)(?:ember)?)"
)
_ZONE = r"(?: ?(Z|z|[+-]\d{2}(?::?\d{2})?|[A-Z]{2,5}))?(?:\[([A-Za-z][A-Za-z0-9_+/-]*)\])?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?: ?([AaPp][Mm]))?"
_WEEKDAY = r"(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,? )?"
DAY_US = 86_400_000_000
#: Years whose winters and summers give a zone's abbreviations; where one has changed its meaning, the latest counts.
_YEARS = (1995, 2005, 2015, 2025, 2037)
# ---- end of fixed values ------------------------------------------------------------------------------------

_MONTH_GROUPS = 12


def _month_out(first: int) -> str:
    """The replacement text that holds whichever of the twelve month groups matched."""
    return "".join(f"${first + k}" for k in range(_MONTH_GROUPS))


def _rules(dates_only: bool) -> list[tuple[str, str]]:
    """(pattern, replacement) in order. The replacement is
    ``order|a|b|c|hour|minute|second|fraction|half|zone|region``; ``order`` says which of a, b, c is the year:
    ``Y`` year first, ``D`` day, month, year, ``?`` as the source's date order says, ``8`` eight digits in a row."""
    m = _MONTH_GROUPS
    out = [
        (rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[T ]{_CLOCK}{_ZONE}$", "Y|$1|$2|$3|$4|$5|$6|$7|$8|$9|$10"),
        (rf"^(\d{{1,4}})/(\d{{1,2}})/(\d{{1,4}})[T ]{_CLOCK}{_ZONE}$", "?|$1|$2|$3|$4|$5|$6|$7|$8|$9|$10"),
        (
            rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?{_ZONE}$",
            "Y|$1|$2|$3|$4|$5|$6|$7||$8|$9",
        ),
        (
            rf"^{_WEEKDAY}(\d{{1,2}})[- ]{_MONTH}[- ](\d{{4}}),? {_CLOCK}{_ZONE}$",
            "D|$1|" + _month_out(2) + "|" + "|".join(f"${k}" for k in range(2 + m, 10 + m)),
        ),
        (
            rf"^{_WEEKDAY}{_MONTH} (\d{{1,2}}),? (\d{{4}}),? {_CLOCK}{_ZONE}$",
            f"D|${1 + m}|" + _month_out(1) + f"|${2 + m}|" + "|".join(f"${k}" for k in range(3 + m, 10 + m)),
        ),
    ]
    if dates_only:
        rest = "|||||||"
        out += [
            (r"^(\d{4})-(\d{2})-(\d{2})$", f"Y|$1|$2|$3{rest}"),
            (r"^(\d{1,4})/(\d{1,2})/(\d{1,4})$", f"?|$1|$2|$3{rest}"),
            (r"^(\d{4})(\d{2})(\d{2})$", f"Y|$1|$2|$3{rest}"),
            (rf"^{_WEEKDAY}(\d{{1,2}})[- ]{_MONTH}[- ](\d{{4}})$", "D|$1|" + _month_out(2) + f"|${2 + m}{rest}"),
            (rf"^{_WEEKDAY}{_MONTH} (\d{{1,2}}),? (\d{{4}})$", f"D|${1 + m}|" + _month_out(1) + f"|${2 + m}{rest}"),
        ]
    return out


def _bare_number(t: Column) -> Column:
    """Microseconds since 1970 of a bare number in the unit its size tells: up to 11 digits seconds, up to 14
    milliseconds, up to 17 microseconds, up to 20 nanoseconds. Under nine digits it names no instant."""
    whole = F.regexp_extract(t, r"^(\d{9,20})(?:\.(\d+))?$", 1)
    part = F.regexp_extract(t, r"^(\d{9,20})(?:\.(\d+))?$", 2)
    n = F.length(whole)

    def scaled(digits: int) -> Column:
        return F.concat(whole, F.rpad(F.substring(part, 1, digits), digits, "0")).try_cast("bigint")

    return (
        F.when(n < 9, None)
        .when(n <= 11, scaled(6))
        .when(n <= 14, scaled(3))
        .when(n <= 17, whole.try_cast("bigint"))
        .otherwise(whole.substr(F.lit(1), n - 3).try_cast("bigint"))
    )


@lru_cache(1)
def zone_names() -> tuple[str, ...]:
    """The names of zones that this JVM has rules for."""
    session = SparkSession.active()
    try:
        jvm = session._jvm
        names = jvm.java.time.ZoneId.getAvailableZoneIds().toString()
        return tuple(sorted(names.strip("[]").split(", ")))
    except AttributeError:  # no JVM at hand
        return tuple(sorted(available_timezones()))


@lru_cache(1)
def abbreviations() -> str:
    """Every abbreviation with its minutes east of UTC by zone, from the zones' own rules, as JSON."""
    out: dict[str, dict[str, int]] = {}
    for name in sorted(available_timezones()):
        zone = ZoneInfo(name)
        for year in _YEARS:
            for month in (1, 7):
                at = datetime(year, month, 1, tzinfo=zone)
                if at.tzname() and at.tzname().isalpha():
                    out.setdefault(at.tzname(), {})[name] = int(at.utcoffset().total_seconds() // 60)
    return json.dumps(out)


def known_zone(name: str) -> Column:
    """The SQL expression ``name`` if it names a zone there are rules for, else null: no name may end the job."""
    return F.expr(f"CASE WHEN {name} IN ({', '.join(repr(z) for z in zone_names())}) THEN {name} END")


def _offset_minutes(zone: Column, clock: Column) -> Column:
    """Minutes east of UTC of a written zone; null if it is none of the source's, or beyond 18 hours or 59 minutes."""
    by_name = F.from_json(F.lit(abbreviations()), "map<string,map<string,int>>")
    digits = F.regexp_replace(F.substring(zone, 2, 5), ":", "")
    hours, rest = F.substring(digits, 1, 2).try_cast("int"), F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
    minutes = F.when((rest <= 59) & (hours * 60 + rest <= 18 * 60), hours * 60 + rest)
    return (
        F.when(F.upper(zone).isin(*UNIVERSAL), F.lit(0))
        .when(zone.startswith("+"), minutes)
        .when(zone.startswith("-"), -minutes)
        .otherwise(F.try_element_at(F.try_element_at(by_name, zone), clock))
    )


def _local_to_micros(local: Column, zone: Column, ambiguous: str, nonexistent: str) -> Column:
    """Wall-clock time (held as if it were UTC) of a named zone to microseconds since 1970.

    ``to_utc_timestamp`` takes the earlier instant of a repeated hour and moves a skipped hour on by the gap; the
    policies ``later`` and ``null`` are built on that.
    """
    at = F.to_utc_timestamp(local, zone)
    out = F.unix_micros(at)
    if ambiguous != "earlier" or nonexistent != "shift":
        hour = F.expr("interval 1 hour")
        if ambiguous != "earlier":
            again = F.from_utc_timestamp(at + hour, zone) == local
            out = F.when(again, F.unix_micros(at + hour) if ambiguous == "later" else None).otherwise(out)
        if nonexistent == "null":
            out = F.when(F.from_utc_timestamp(at, zone) == local, out)
    return out


def _fence(c: Column) -> Column:
    """``c``, kept by the optimizer as a computed column: pushed filters would copy its whole expression otherwise."""
    return F.when(F.spark_partition_id() >= 0, c)


def utc_date(micros: Column) -> Column:
    """The UTC date of microseconds since 1970, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(micros / F.lit(DAY_US)).cast("int"))


def local_date(micros: Column, zone: str) -> Column:
    """The date of microseconds since 1970 on the clock of ``zone``, whatever the session's time zone."""
    return utc_date(F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(micros), zone)))


def _check_policy(ambiguous: str, nonexistent: str) -> None:
    if ambiguous not in ("earlier", "later", "null") or nonexistent not in ("shift", "null"):
        raise ValueError("ambiguous: earlier, later or null; nonexistent: shift or null")


def _fields(df: DataFrame, text: str, dates: bool) -> DataFrame:
    """Adds ``__t`` (trimmed text), ``__fast`` and ``__p`` (the fields of the rule that matched)."""
    df = df.withColumn("__t", F.btrim(F.col(text), F.lit(BLANKS)))
    t = F.col("__t")
    fast = t.like("____-__-__") if dates else (F.length(t) == 32) & t.like("____-__-__T__:__:__.______+00:00")
    slow = F.when(~fast & t.rlike(r"^[0-9A-Za-z].*\d"), t)
    df = df.withColumn("__fast", F.coalesce(fast, F.lit(False))).withColumn("__s", _fence(slow))
    s, case = F.col("__s"), F.when(F.col("__s").isNull(), None)
    for pattern, out in _rules(dates):
        case = case.when(s.rlike(pattern), F.regexp_replace(s, pattern, out))
    return df.withColumn("__f", _fence(case)).withColumn("__p", _fence(F.split("__f", r"\|", 11)))


def _date_text(p: Column, order: Column) -> Column:
    """``YYYY-MM-DD`` of the fields; whether it is a date is the cast's business."""
    a, b, c = p[1], p[2], p[3]
    how = F.when(p[0] != "?", p[0]).when(F.length(a) == 4, "Y").when(order == "YMD", "Y").when(order == "DMY", "D").when(order == "MDY", "M")
    year = F.when(how == "Y", a).otherwise(c)
    month = F.when(how == "M", a).otherwise(b)
    day = F.when(how == "Y", c).when(how == "D", a).otherwise(b)
    named = ((F.position(F.initcap(F.substring(month, 1, 3)), F.lit(MONTHS)) + 2) / 3).cast("int").cast("string")
    year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).when(F.length(year) == 4, year)
    return F.when(
        how.isNotNull(),
        F.concat_ws("-", year, F.lpad(F.when(month.rlike("^[A-Za-z]"), named).otherwise(month), 2, "0"), F.lpad(day, 2, "0")),
    )


def _with_clock(df: DataFrame, zone: str, order: str) -> DataFrame:
    """Adds ``__local``: the wall-clock time of the fields, held as if it were UTC; null if there is no such time."""
    p, hour = F.col("__p"), F.col("__p")[4].try_cast("int")
    half = F.upper(p[8])
    h24 = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "PM", 12).otherwise(0))
    clock = F.concat(
        F.lpad(h24.cast("string"), 2, "0"), F.lit(":"), p[5], F.lit(":"),
        F.when(p[6] == "", F.lit("00")).otherwise(p[6]), F.lit("."), F.rpad(F.substring(p[7], 1, 6), 6, "0"),
    )
    text = F.concat(_date_text(p, F.col(order)), F.lit(" "), clock, F.lit("Z"))
    return df.withColumn("__local", _fence(F.when(F.col("__f").isNotNull(), text.try_cast("timestamp"))))


def with_instant(
    df: DataFrame, text: str, out: str, zone: str, order: str, canonical: str | None = None,
    ambiguous: str = "earlier", nonexistent: str = "shift",
) -> DataFrame:
    """Adds ``out``: the instant of column ``text`` in microseconds since 1970 UTC, null if it names none.

    ``zone`` and ``order`` name columns with the row's default zone and its order of all-digit dates with slashes;
    null there, or a zone without rules, makes texts that need them name no instant; so does an unknown region, an
    abbreviation that is none of the row's zone, an offset beyond 18 hours or of 60 minutes and more. A zone or offset in the text counts before the default,
    an offset before a bracketed region. ``canonical``, if given, is a flag column: the text is already exactly
    ``YYYY-MM-DDTHH:MM:SS.ffffff+00:00``. Columns of these names are replaced. Null, empty and blank texts give null. ``ambiguous`` decides a local time
    that occurs twice (``earlier``, ``later``, ``null``), ``nonexistent`` one that is skipped (``shift``, ``null``).
    """
    _check_policy(ambiguous, nonexistent)
    keep = [c for c in df.columns if c.lower() not in (out.lower(), (canonical or out).lower())]
    df = _with_clock(_fields(df, text, dates=False), zone, order)
    p, clock, region = F.col("__p"), known_zone(f"`{zone}`"), known_zone("__p[10]")
    local = F.col("__local")
    value = (
        F.when(F.col("__fast"), F.unix_micros(F.col("__t").try_cast("timestamp")))
        .when(F.col("__s").isNull(), None)
        .when(F.col("__f").isNull(), _bare_number(F.col("__s")))
        .when((p[9] == "") & (p[10] == ""), _local_to_micros(local, clock, ambiguous, nonexistent))
        .when(p[9] == "", _local_to_micros(local, region, ambiguous, nonexistent))
        .otherwise(F.unix_micros(local) - _offset_minutes(p[9], F.col(zone)).cast("bigint") * 60_000_000)
    )
    extra = [] if canonical is None else [(F.col("__fast") & F.col(out).isNotNull() & (F.length(text) == 32)).alias(canonical)]
    return df.withColumn(out, _fence(value)).select(*[F.col(f"`{c}`") for c in keep], out, *extra)


def with_session_date(
    df: DataFrame, text: str, out: str, zone: str, order: str, canonical: str | None = None,
    session_zone: str = "America/New_York",
) -> DataFrame:
    """Adds ``out``: the session date (DATE) of column ``text``.

    A bare date, or one with a bare midnight, is the date itself; a text with a zone, and a bare number of seconds or
    finer, is the date of its instant in ``session_zone``; any other clock is the source's. Eight digits in a row are
    YYYYMMDD and two-digit years are 20YY. Everything else, null included, is null.
    """
    keep = [c for c in df.columns if c.lower() not in (out.lower(), (canonical or out).lower())]
    df = _with_clock(_fields(df, text, dates=True), zone, order)
    p, local, clock, region = F.col("__p"), F.col("__local"), known_zone(f"`{zone}`"), known_zone("__p[10]")

    def of(micros: Column) -> Column:
        return local_date(micros, session_zone)

    bare = (p[9] == "") & (p[10] == "")
    value = (
        F.when(F.col("__fast"), F.col("__t").try_cast("date"))
        .when(F.col("__s").isNull(), None)
        .when(F.col("__f").isNull(), of(_bare_number(F.col("__s"))))
        .when(p[4] == "", _date_text(p, F.col(order)).try_cast("date"))
        .when(bare & (F.pmod(F.unix_micros(local), F.lit(DAY_US)) == 0), utc_date(F.unix_micros(local)))
        .when(bare, of(_local_to_micros(local, clock, "earlier", "shift")))
        .when(p[9] == "", of(_local_to_micros(local, region, "earlier", "shift")))
        .otherwise(of(F.unix_micros(local) - _offset_minutes(p[9], F.col(zone)).cast("bigint") * 60_000_000))
    )
    extra = [] if canonical is None else [(F.col("__fast") & F.col(out).isNotNull() & (F.length(text) == 10)).alias(canonical)]
    return df.withColumn(out, _fence(value)).select(*[F.col(f"`{c}`") for c in keep], out, *extra)
