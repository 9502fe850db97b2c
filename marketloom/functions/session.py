"""Eastern-time session columns from integer nanoseconds.

All arithmetic is on whole microseconds (the engine's time resolution) and
integers, so no session boundary moves through floating point.  Zone rules,
both daylight-saving switches included, come from the engine's zone database.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZONE = "America/New_York"
#: Liquidity sessions, and phases of the regular day (fixed values).
ASIA, LONDON, NEW_YORK = 0, 1, 2
ETH, OPEN, MORNING, LUNCH, AFTERNOON, CLOSE = range(6)
SESSION_LABELS = {ASIA: "asia", LONDON: "london", NEW_YORK: "new_york"}


def local_time(ts: Column) -> Column:
    """Wall-clock time in the exchange's zone of a nanosecond column."""
    micros = F.call_function("div", ts - F.pmod(ts, F.lit(1000)), F.lit(1000))
    return F.from_utc_timestamp(F.timestamp_micros(micros), ZONE)


def _minutes(ts: Column) -> Column:
    local = local_time(ts)
    return F.hour(local) * 60 + F.minute(local)


def liquidity_session(ts: Column) -> Column:
    """0 from 18:00 to 03:00, 1 to 09:30, 2 to 18:00 (null: null)."""
    m = _minutes(ts)
    return F.when((m >= 18 * 60) | (m < 3 * 60), ASIA).when(m < 9 * 60 + 30, LONDON).when(m.isNotNull(), NEW_YORK).cast("tinyint")


def session_label(session: Column) -> Column:
    out = F.when(session.isNotNull(), F.lit("unknown"))
    for value, name in SESSION_LABELS.items():
        out = F.when(session == value, F.lit(name)).otherwise(out)
    return out


def session_phase(ts: Column) -> Column:
    """Phase of the regular day, 09:30 to 16:00; 0 outside it."""
    m = _minutes(ts)
    steps = ((9 * 60 + 30, ETH), (10 * 60, OPEN), (11 * 60 + 30, MORNING), (13 * 60, LUNCH), (15 * 60, AFTERNOON), (16 * 60, CLOSE))
    out = F.when(m.isNotNull(), F.lit(ETH))
    for until, value in reversed(steps):
        out = F.when(m < until, F.lit(value)).otherwise(out)
    return out.cast("tinyint")


def minutes_since_open(ts: Column) -> Column:
    """Minutes since 09:30; null outside 09:30 to 16:00."""
    m = _minutes(ts)
    return F.when((m >= 9 * 60 + 30) & (m < 16 * 60), m - (9 * 60 + 30))


def trade_date(ts: Column) -> Column:
    """ISO date that rolls to the next day at 18:00."""
    local = local_time(ts)
    return F.date_format(F.date_add(F.to_date(local), F.when(F.hour(local) >= 18, 1).otherwise(0)), "yyyy-MM-dd")


def session_bounds(ts: Column) -> tuple[Column, Column]:
    """Half-open [start, end) of the containing liquidity session, in nanoseconds."""
    local = local_time(ts)
    m = F.hour(local) * 60 + F.minute(local)
    day = F.to_date(local)
    first = F.when(m < 3 * 60, F.date_sub(day, 1)).otherwise(day)
    begin = F.when((m >= 18 * 60) | (m < 3 * 60), F.lit(18 * 60)).when(m < 9 * 60 + 30, F.lit(3 * 60)).otherwise(F.lit(9 * 60 + 30))
    last = F.when(m >= 18 * 60, F.date_add(day, 1)).otherwise(day)
    stop = F.when((m >= 18 * 60) | (m < 3 * 60), F.lit(3 * 60)).when(m < 9 * 60 + 30, F.lit(9 * 60 + 30)).otherwise(F.lit(18 * 60))

    def at(date: Column, minutes: Column) -> Column:
        wall = F.timestamp_seconds(F.unix_date(date).cast("bigint") * 86400 + minutes.cast("bigint") * 60)
        return F.unix_micros(F.to_utc_timestamp(wall, ZONE)) * 1000

    return at(first, begin), at(last, stop)


def add_session_columns(df: DataFrame, ts: str = "event_ts") -> DataFrame:
    return df.withColumns({"session_phase": session_phase(F.col(ts)), "minutes_since_open": minutes_since_open(F.col(ts)), "session_date": trade_date(F.col(ts))})


def clipped_zone(ts: Column, first: Column, last: Column) -> tuple[Column, Column]:
    """session_bounds within the data's own first and last time."""
    start, end = session_bounds(ts)
    return F.greatest(start, first), F.least(end, last)
