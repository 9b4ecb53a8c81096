"""Local days, weeks that start on a chosen day, period keys (inventory I1-I19, B16, E1-E4).  Names are English; other
languages are left to the reader of the result."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole weeks of each observation window, and the longest window walked.
WINDOW_WEEKS = {"month": 5, "quarter": 13, "semester": 26, "year": 53}
LONGEST_WEEKS, FIRST_YEAR = 520, 1900


def local_day(instant: Column, zone: str | None = None) -> Column:
    """Calendar day of an instant, in ``zone`` if given."""
    return F.to_date(F.from_utc_timestamp(instant, zone) if zone else instant)


def plausible(day: Column, last_year: int) -> Column:
    """Year between 1900 and ``last_year``."""
    return F.coalesce(F.year(day).between(FIRST_YEAR, last_year), F.lit(False))


def declared_day(raw: Column, last_year: int) -> Column:
    """Day of a declared date string, or null if it is no plausible date."""
    day = F.try_to_date(F.regexp_extract(raw, r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    return F.when(plausible(day, last_year), day)


def weekday_index(day: Column, first_day: int = 1) -> Column:
    """0 for the chosen first day of the week (0: Sunday) up to 6."""
    return F.pmod(F.dayofweek(day) - 1 - first_day, F.lit(7)).cast("int")


def week_start(day: Column, first_day: int = 1) -> Column:
    return F.date_sub(day, weekday_index(day, first_day))


def period_key(day: Column, granularity: str, first_day: int = 1) -> Column:
    """Week start, month or year as text; text order is time order."""
    if granularity == "week":
        return F.date_format(week_start(day, first_day), "yyyy-MM-dd")
    return F.date_format(day, "yyyy" if granularity == "year" else "yyyy-MM")


def period_start(day: Column, granularity: str, first_day: int = 1) -> Column:
    """First day of the period."""
    return week_start(day, first_day) if granularity == "week" else F.trunc(day, "year" if granularity == "year" else "month").cast("date")


def window_bounds(ref_day: date, period: str = "quarter", first_day: int = 1) -> tuple[date, date]:
    """First and last day of N whole weeks that end with the week of ``ref_day``; the last day is ``ref_day``."""
    weeks = WINDOW_WEEKS.get(period, WINDOW_WEEKS["quarter"])
    this_week = ref_day - timedelta(days=(ref_day.isoweekday() % 7 - first_day) % 7)
    return this_week - timedelta(days=7 * (weeks - 1)), ref_day


def import_date(raw: Column) -> Column:
    """ISO date at the start of an import cell, else null (I16)."""
    return F.try_to_date(F.regexp_extract(F.trim(raw.cast("string")), r"^(\d{4}-\d{2}-\d{2})(?:$|[T ])", 1), "yyyy-MM-dd")


def relative_label(day: Column, today: Column) -> Column:
    """today, yesterday, the weekday within a week, else the date."""
    ago = F.datediff(today, day)
    return F.when(ago == 0, "today").when(ago == 1, "yesterday").when(ago.between(2, 6), F.date_format(day, "EEEE")).otherwise(F.date_format(day, "yyyy-MM-dd"))


def finished_at(before_status: Column, after_status: Column, before: Column, patched: Column, today: Column) -> Column:
    """Entering ``done`` stamps today unless the change sets a date itself."""
    entering = (after_status == "done") & ~before_status.eqNullSafe(F.lit("done"))
    return F.when(patched.isNotNull(), patched).when(entering & (F.coalesce(before, F.lit("")) == ""), today).otherwise(before)


def started_at(before: Column, today: Column) -> Column:
    """The first write wins."""
    return F.coalesce(F.nullif(before, F.lit("")), today)


def shift_day(day: Column, by: Column | int) -> Column:
    """The day ``by`` days later, or earlier if negative."""
    return F.date_add(day, F.lit(by) if isinstance(by, int) else by)


def weekday_names(first_day: int = 1, long: bool = True) -> Column:
    """The seven weekday names from the chosen first day on."""
    sunday = date(2024, 1, 7)
    return F.array(*(F.date_format(F.lit(sunday + timedelta(days=first_day + i)), "EEEE" if long else "EEE") for i in range(7)))


def local_noon(day_text: Column) -> Column:
    """Noon of a written day, the one time that no clock change moves to another date; null if it is no day."""
    return F.try_to_timestamp(F.concat(F.regexp_extract(day_text, r"^(\d{1,4}-\d{1,2}-\d{1,2})$", 1), F.lit(" 12:00:00")), F.lit("y-M-d HH:mm:ss"))


def shown_day(value: Column, zone: str | None = None) -> Column:
    """Day of a stored text: ten characters are a day as it stands, longer ones or ones with a T are an instant, whose day
    depends on the zone; what cannot be read is shown as it is, null as nothing (I14)."""
    instant = (F.length(value) > 10) | F.contains(value, F.lit("T"))
    at = value.try_cast("timestamp")
    day = F.try_to_date(F.substring(value, 1, 10), "y-M-d")
    shown = lambda d: F.date_format(d, "yyyy-MM-dd")
    return F.coalesce(F.when(instant, F.coalesce(shown(local_day(at, zone)), value)).otherwise(F.coalesce(shown(day), F.substring(value, 1, 10))), F.lit(""))


def derives_done(before_status: Column, before_day: Column, new_status: Column, new_day: Column) -> Column:
    """Whether a change that sets an end date finishes the project: the day is new, the change does not itself choose
    another status, and the status is not done already (I18).  ``before_status`` is null for a new project."""
    day = lambda c: F.substring(F.trim(F.coalesce(c, F.lit(""))), 1, 10)
    chosen = before_status.isNotNull() & new_status.isNotNull() & (new_status != before_status)
    done = F.coalesce(new_status, before_status, F.lit("")) == "done"
    return (day(new_day) != "") & (day(new_day) != day(before_day)) & ~F.coalesce(chosen, F.lit(False)) & ~done
