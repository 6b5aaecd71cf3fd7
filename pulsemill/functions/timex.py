"""Date and time functions. The present is always an argument, as_of."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import PERIODS


def period_name(ts: Column) -> Column:
    h = F.hour(ts)
    return F.when(h < PERIODS[0][0], PERIODS[0][1]).when(h < PERIODS[1][0], PERIODS[1][1]).when(h < PERIODS[2][0], PERIODS[2][1]).otherwise(PERIODS[3][1])


def period_label(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd"), F.lit("_"), period_name(ts))


def hours_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b) / F.lit(3.6e9)


def ts_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def iso_text(ts: Column) -> Column:
    """ISO 8601, with microseconds where there are any."""
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)))


def date_range(q: Column, as_of: Column) -> tuple[Column, Column]:
    """(start, end) that a query names, on the date as_of: explicit dates first, then relative spans; null if none."""
    found = F.regexp_extract_all(q, F.lit(r"(\d{4}[\-/年]\d{1,2}[\-/月]\d{1,2})"), F.lit(1))
    dates = F.filter(F.transform(found, lambda d: F.try_to_date(F.regexp_replace(d, "[/年月]", "-"), "yyyy-M-d")), lambda d: d.isNotNull())
    monday = F.trunc(as_of, "week")
    n = F.regexp_extract(q, r"(?:近|最近|过去)(\d+)天", 1).try_cast("int")
    days = F.when(n.isNotNull(), F.greatest(F.lit(1), F.least(n, F.lit(365)))).when(q.rlike("(近|最近)一周"), 7).when(q.rlike("(近|最近)两周"), 14).when(q.rlike("(近|最近)一个月"), 30)
    word = lambda w: F.contains(q, F.lit(w))
    one = F.when(word("今天"), 0).when(word("昨天") | word("昨日"), 1).when(word("前天"), 2)
    start = F.when(one.isNotNull(), F.date_sub(as_of, one)).when(days.isNotNull(), F.date_sub(as_of, days - 1)).when(word("本周"), monday).when(word("上周"), F.date_sub(monday, 7))
    end = F.when(one.isNotNull(), F.date_sub(as_of, one)).when(days.isNotNull() | word("本周"), as_of).when(word("上周"), F.date_sub(monday, 1))
    some = F.size(dates) > 0
    return F.when(some, F.array_min(dates)).otherwise(start), F.when(some, F.array_max(dates)).otherwise(end)


def parsed_date(c: Column, end_of_day: bool = False) -> Column:
    """The date that a text like 2024-01-31 names, at its first or last second; null for other texts."""
    day = F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(c, "yyyy-M-d")).cast("timestamp_ntz")
    return day + F.expr("INTERVAL 86399 SECONDS") if end_of_day else day


def to_local(ts: Column, zone: str = "Asia/Shanghai") -> Column:
    """Wall-clock time in the zone of a time in UTC."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def to_utc(ts: Column, zone: str = "Asia/Shanghai") -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), ts)


def from_unix(seconds: Column, zone: str = "Asia/Shanghai") -> Column:
    """Wall-clock time in the zone of a count of seconds since 1970, whatever the session's time zone is."""
    return to_local(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)")), zone)


def relative_day(ts: Column, as_of: Column) -> Column:
    """How long ago, for readers: in whole days of 24 hours, beyond a week the date and half of the day."""
    # The words for the last three days and for days ago.
    today, yesterday, before, ago = "今天", "昨天", "前天", "天前"
    days = F.floor(F.floor(hours_between(ts, as_of)) / 24)
    date = F.concat(F.date_format(ts, "yyyy/MM/dd "), F.when(F.hour(ts) < 12, "am").otherwise("pm"))
    near = F.when(days < 1, today).when(days == 1, yesterday).when(days == 2, before).when(days < 7, F.concat(days.cast("string"), F.lit(ago)))
    return F.when(ts.isNull(), "—").otherwise(F.coalesce(near, date))
