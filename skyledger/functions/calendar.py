"""Calendar columns: the fixed 366-slot year, real days, seasons, zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lengths of the months in the slot year, in which February always has 29 days.
MONTH_DAYS = [31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
SLOTS = 366


def slot_of(month: Column, day: Column) -> Column:
    """Slot 1 to 366 of a month and day, the same in every year."""
    before = F.array(*(F.lit(sum(MONTH_DAYS[:i])) for i in range(12)))
    return (F.get(before, month.cast("int") - 1) + day).cast("int")


def slot_of_date(date: Column) -> Column:
    return slot_of(F.month(date), F.dayofmonth(date))


def month_day_of_slot(slot: Column) -> tuple[Column, Column]:
    """Month and day of a slot."""
    date = F.date_add(F.lit("2000-01-01").cast("date"), slot.cast("int") - 1)
    return F.month(date), F.dayofmonth(date)


def is_leap(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def slot_skipped(slot: Column, year: Column) -> Column:
    """Slot 60 (29 February) is skipped outside leap years."""
    return (slot == 60) & ~is_leap(year)


def cyclic_day(today: Column, start: Column) -> Column:
    """Day 1 to 366 of a plan begun at `start`, over and over; a future start gives 1, no start the calendar's slot."""
    gone = F.greatest(F.datediff(today, start), F.lit(0))
    return F.when(start.isNotNull(), F.pmod(gone, F.lit(SLOTS)) + 1).otherwise(slot_of_date(today)).cast("int")


def weekday(date: Column) -> Column:
    """Sunday is 0."""
    return F.dayofweek(date) - 1


#: The months of each season north of the equator; south of it the opposite season has them.
SEASONS = {"spring": (3, 4, 5), "summer": (6, 7, 8), "autumn": (9, 10, 11), "winter": (12, 1, 2)}
OPPOSITE = {"spring": "autumn", "summer": "winter", "autumn": "spring", "winter": "summer"}


def season(month: Column, latitude: Column) -> Column:
    """Season by month bands; swapped south of the equator."""
    named = lambda name: F.coalesce(*(F.when(month.isin(*months), name(s)) for s, months in SEASONS.items()))
    return F.when(latitude < 0, named(OPPOSITE.get)).otherwise(named(lambda s: s))


def millis(ts: Column) -> Column:
    """Epoch milliseconds of a UTC wall clock (timestamps without zone are taken as UTC)."""
    return F.timestamp_diff("MILLISECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts.cast("timestamp_ntz"))


def in_zone(ts: Column, zone: str | Column) -> Column:
    """The wall clock of a zone at a UTC instant."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone) if isinstance(zone, str) else zone, ts.cast("timestamp_ntz"))


def date_key(ts: Column, zone: str | Column) -> Column:
    """YYYY-MM-DD of an instant in a zone."""
    return F.date_format(in_zone(ts, zone), "yyyy-MM-dd")


def long_date(date: Column) -> Column:
    return F.date_format(date, "EEEE, MMMM d, yyyy")


def long_date_of_key(key: Column) -> Column:
    """The long date of a YYYY-M-D key; nothing for none, a key of other than three parts as it is. Days and months over the end run on."""
    part = F.split(key, "-")
    year, month, day = (F.get(part, F.lit(i)).try_cast("int") for i in range(3))
    date = F.date_add(F.add_months(F.make_date(year, F.lit(1), F.lit(1)), month - 1), day - 1)
    return F.when(F.coalesce(key, F.lit("")) == "", "").when(F.size(part) != 3, key).otherwise(F.coalesce(long_date(date), F.lit("Invalid Date")))


def zone_offset_minutes(ts: Column, zone: str | Column) -> Column:
    """Minutes that a zone is ahead of UTC at an instant."""
    return F.timestamp_diff("MINUTE", ts.cast("timestamp_ntz"), in_zone(ts, zone)).cast("int")


def utc_of_local(local: Column, zone: str | Column, offset_hours: Column | None = None) -> Column:
    """The instant (UTC wall clock) of a zone's wall time; a given offset (hours ahead of UTC) beats the zone."""
    local = local.cast("timestamp_ntz")
    by_zone = F.convert_timezone(F.lit(zone) if isinstance(zone, str) else zone, F.lit("UTC"), local)
    if offset_hours is None:
        return by_zone
    return F.coalesce(F.timestamp_add("SECOND", (-offset_hours * 3600).cast("int"), local), by_zone)


def minutes_after(day: Column, minutes: Column) -> Column:
    """The instant so many minutes after a UTC midnight, to the millisecond; null minutes give null."""
    return F.timestamp_add("MILLISECOND", F.floor(minutes * 60000 + 0.5).cast("int"), day.cast("date").cast("timestamp_ntz"))
