"""Schedules, retry delays, ages and prices as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RETRY_BASE_HOURS, RETRY_MOST_HOURS, RETRY_STREAK_CAP = 1, 24, 6


def _first_after(days: Column, after: Column, hour: int, minute: int, zone: str) -> Column:
    """The first of the days' local hour:minute strictly after a UTC time.

    A time that the clock skips moves forward by the gap; of a repeated one the first counts.
    """
    at = F.expr(f"interval '{hour}:{minute}' hour to minute")
    return F.array_min(F.filter(F.transform(days, lambda d: F.to_utc_timestamp(d.cast("timestamp") + at, zone)), lambda t: t > after))


def _near(after: Column, zone: str, first: int, last: int) -> Column:
    """Local days around a UTC time; the day before catches a time that a gap moved past midnight."""
    local = F.to_date(F.from_utc_timestamp(after, zone))
    return F.transform(F.sequence(F.lit(first), F.lit(last)), lambda d: F.date_add(local, d))


def next_daily(after: Column, hour: int, minute: int, zone: str) -> Column:
    """The first local hour:minute strictly after a UTC time."""
    return _first_after(_near(after, zone, -1, 2), after, hour, minute, zone)


def next_weekly(after: Column, weekday: int, hour: int, minute: int, zone: str) -> Column:
    """The same on one weekday, 0 for Monday."""
    return _first_after(F.filter(_near(after, zone, -1, 8), lambda d: F.weekday(d) == weekday), after, hour, minute, zone)


def next_monthly(after: Column, day: int, hour: int, minute: int, zone: str) -> Column:
    """The same on one day of each month, or the month's last day where it is shorter."""
    start = F.trunc(F.date_sub(F.to_date(F.from_utc_timestamp(after, zone)), 1), "month")
    months = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.add_months(start, k))
    return _first_after(F.transform(months, lambda m: F.least(F.date_add(m, day - 1), F.last_day(m))), after, hour, minute, zone)


def slot_or_retry(status: Column, finished: Column, regular: Column, streak: Column) -> Column:
    """When a job runs next: a failed one is retried if that is before its regular slot, or it has none."""
    retry = finished + F.make_dt_interval(hours=retry_hours(streak).cast("int"))
    return F.when((status == "failed") & (regular.isNull() | (retry < regular)), retry).otherwise(regular)


def retry_hours(streak: Column) -> Column:
    """Hours until the next try after a streak of failures: doubled each time, to a limit."""
    return F.least(F.lit(RETRY_BASE_HOURS) * F.pow(F.lit(2), F.least(streak, F.lit(RETRY_STREAK_CAP)) - 1).cast("long"), F.lit(RETRY_MOST_HOURS).cast("long"))


def call_wait(attempt: Column, requested: Column, initial: float = 1.0, factor: float = 2.0, most: float = 60.0, jitter: Column | None = None) -> Column:
    """Seconds before a call is tried again; null where the server asks for more than the limit.

    jitter, from 0 to 1, lengthens the wait by up to a tenth.
    """
    wait = F.greatest(F.lit(initial) * F.pow(F.lit(factor), attempt - 1), F.coalesce(requested, F.lit(0.0)))
    wait = wait if jitter is None else wait * (1 + jitter / 10)
    return F.when(requested > most, None).otherwise(F.least(F.lit(most), wait))


def retry_after(header: Column, now: Column) -> Column:
    """Seconds that a Retry-After header asks for: a number, or an HTTP date (0 if past); else null."""
    bare = F.trim(header)
    date = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(bare, r"^[A-Za-z]+,\s*", ""), r"\s+(GMT|UTC)$", " +0000"), F.lit("d MMM yyyy HH:mm:ss Z"))
    seconds = F.greatest(F.unix_micros(date) - F.unix_micros(now.cast("timestamp")), F.lit(0)) / 1e6
    return F.when(bare.rlike(r"^[0-9]+(\.[0-9]+)?$"), bare.try_cast("double")).when(date.isNotNull(), seconds)


def local_day(moment: Column, zone: Column | str) -> Column:
    """The date of a UTC time in a zone."""
    return F.to_date(F.from_utc_timestamp(moment, zone))


def clamp_age(published: Column, now: Column, max_age_days: int) -> tuple[Column, Column]:
    """Whether an item is young enough (undated ones are), and its date, not later than now."""
    return published.isNull() | (published >= now - F.make_dt_interval(days=F.lit(max_age_days))), F.least(published, now)


def cost_usd(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Price of summed tokens per million, rounded half up to six places once; null without a price."""
    exact = tokens_in.cast("decimal(18,0)") * price_in + tokens_out.cast("decimal(18,0)") * price_out
    return F.round(exact / F.lit(1_000_000).cast("decimal(7,0)"), 6).cast("decimal(18,6)")


def half_up(score: Column, places: int = 2) -> Column:
    """A score as it is stored: rounded half up on its decimal digits, not on the binary fraction."""
    return F.round(score.cast("string").cast("decimal(38,18)"), places).cast(f"decimal(10,{places})")
