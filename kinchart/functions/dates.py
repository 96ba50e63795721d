"""Date expressions in medical text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinchart.functions import columns as C
from kinchart.functions.spans import groups, in_ascii, is_ascii, let
from kinchart.sources.dimensions import pattern

MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def _make(year: Column, month: Column, day: Column) -> Column:
    """A date, or null where there is no such day."""
    padded = F.when(year < 1000, F.lpad(year.cast("string"), 4, "0")).otherwise(year.cast("string"))
    return F.concat(padded, F.lit("-"), month.cast("string"), F.lit("-"), day.cast("string")).try_cast("date")


def _year(digits: Column) -> Column:
    """Two digits stand for 2000-2049 or 1950-1999."""
    y = digits.try_cast("int")
    return F.when(y < 50, y + 2000).when(y < 100, y + 1900).otherwise(y)


def _month(name: Column) -> Column:
    names = F.array(*[F.lit(m) for m in MONTHS])
    at = F.array_position(names, F.substring(F.lower(name), 1, 3)).cast("int")
    return F.when(at > 0, at)


def _part(text: Column, pat: str, group: int) -> Column:
    return F.regexp_extract(text, pat, group)


def written_date(text: Column) -> Column:
    p = pattern("written_date")
    g = lambda i: _part(text, p, i)
    day_first = F.when(g(1) != "", _make(_year(g(3)), _month(g(2)), g(1).try_cast("int")))
    month_first = F.when(g(4) != "", _make(_year(g(6)), _month(g(4)), g(5).try_cast("int")))
    return F.when(F.rlike(text, F.lit(p)), F.coalesce(day_first, month_first))


def numeric_date(text: Column) -> Column:
    """Day first, else month first; a first part over 31 is a year."""
    p = pattern("numeric_date")

    def date(parts: Column) -> Column:
        g = lambda i: F.get(parts, F.lit(i)).try_cast("int")
        year = _year(F.get(parts, F.lit(2)))
        day_month = F.coalesce(_make(year, g(1), g(0)), _make(year, g(0), g(1)))
        short = F.when(g(0) > 31, _make(g(0), g(1), g(2))).otherwise(day_month)
        # a first part of four digits is a year
        return F.when(g(0).isNotNull(), F.when(F.length(F.get(parts, F.lit(0))) <= 2, short).otherwise(_make(g(0), g(1), g(2))))

    return let(F.split(_part(text, p, 0), r"[/\-.]"), date)


def normalize_date(text: Column) -> Column:
    """Date of a date text: written, numeric, then a few compact forms; null if none fits."""
    t = F.trim(text)
    compact = F.when(t.rlike(r"^\d{8}$"), F.try_to_date(t, "yyyyMMdd"))
    p = r"(?i)^(\d{1,2})[\s\-/]+([a-z]{3})[a-z]*[\s\-/,]+(\d{2,4})$"
    hyphened = F.when(t.rlike(p), _make(_year(_part(t, p, 3)), _month(_part(t, p, 2)), _part(t, p, 1).try_cast("int")))
    return F.coalesce(written_date(t), numeric_date(t), compact, hyphened)


_LAST_DAY = 2_932_896  # 9999-12-31 in days after 1970-01-01


def add_units(as_of: Column, count: Column, unit: Column) -> Column:
    """``as_of`` plus a number of days, weeks, months or years; null past the year 9999."""
    n = count.try_cast("int").cast("long")
    u = F.rtrim(F.lower(unit), F.lit("s"))
    days = n * F.when(u == "week", 7).otherwise(1)
    last_day = F.lit(_LAST_DAY) - F.unix_date(as_of)
    months = n * F.when(u == "year", 12).otherwise(1)
    last_month = F.lit(9999 * 12 + 11) - (F.year(as_of) * 12 + F.month(as_of) - 1)
    # what is added never leaves the calendar, whatever the branch
    by_days = F.date_add(as_of, F.least(days, last_day).cast("int"))
    by_months = F.add_months(as_of, F.least(months, last_month).cast("int"))
    return F.when(u.isin("day", "week") & (days <= last_day), by_days).when(
        u.isin("month", "year") & (months <= last_month), by_months
    )


def follow_up_date(text: Column, as_of) -> Column:
    """First follow-up phrase: its explicit date, or ``as_of`` plus its span."""
    p = pattern("follow_up")
    first = F.when(is_ascii(text), _part(text, in_ascii(p), 0)).otherwise(_part(text, p, 0))

    def date(parts: Column) -> Column:
        count, unit, explicit = (F.get(parts, F.lit(i)) for i in range(3))
        return F.when(explicit != "", normalize_date(explicit)).otherwise(add_units(C.day(as_of), count, unit))

    return let(first, lambda m: F.when(m != "", let(groups(m, p, 3), date)))


def relative_date(text: Column, as_of) -> Column:
    p = pattern("relative_date")
    return add_units(C.day(as_of), _part(text, p, 1), _part(text, p, 2))
