"""Spreadsheet serials and date text."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import as_col
from .text import once, strip

# Serial numbers strictly between these bounds are dates counted from the origin.
SERIAL_LOW, SERIAL_HIGH, SERIAL_ORIGIN = 25000, 55000, "1899-12-30"

# Tried in this order; the first that reads the whole text wins.
DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
    "yyyy/M/d",
    "d-MMM-yyyy",
    "d MMM yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "yyyyMMdd",
    "MMM yyyy",
    "MMM-yyyy",
    "MMMM yyyy",
    "yyyy-MM",
)

# Month names and their short forms.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6,
    "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8,
    "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}


_SHAPES = {"yyyy": r"\d{4}", "MMMM": "[A-Za-z]+", "MMM": "[A-Za-z]{3}", "MM": r"\d{2}", "M": r"\d{1,2}", "dd": r"\d{2}", "d": r"\d{1,2}",
           "HH": r"\d{2}", "mm": r"\d{2}", "ss": r"\d{2}", "'T'": "T"}


def shape(fmt: str) -> str:
    """Regular expression of the texts a format can read; failed parses are slow, failed matches are not."""
    return "^" + re.sub("'T'|yyyy|MMMM|MMM|MM|M|dd|d|HH|mm|ss", lambda m: _SHAPES[m[0]], fmt) + "$"


def read_format(text: Column, fmt: str) -> Column:
    return F.when(text.rlike(shape(fmt)), F.try_to_timestamp(text, F.lit(fmt)))


# What every text that reads as a number without a minus looks like; like failed parses, failed casts are slow.
_NUMBER = r"^[^0-9A-Za-z.+]*\+?(0[xX][0-9a-fA-F.]+|[0-9]*\.?[0-9]*)([eEpP][+-]?[0-9]+)?[dDfF]?[^0-9A-Za-z.+]*$"


def _serial(value: Column | str) -> Column:
    """The number in the serial range, or null."""
    text = as_col(value).cast("string")
    return once(F.when(text.rlike(_NUMBER), text.try_cast("double")), lambda n: F.when((n > SERIAL_LOW) & (n < SERIAL_HIGH), n))


def is_serial(value: Column | str) -> Column:
    return _serial(value).isNotNull()


def serial_to_timestamp(value: Column | str) -> Column:
    """Days since the origin, the fraction being the time of day; null outside the serial range."""
    def moment(n: Column) -> Column:
        day = F.date_add(F.lit(SERIAL_ORIGIN).cast("date"), F.floor(n).cast("int"))
        seconds = F.round((n - F.floor(n)) * 86400).cast("long")
        return F.when(n.isNotNull(), F.timestamp_seconds(F.unix_seconds(day.cast("timestamp")) + seconds))

    return once(_serial(value), moment)


# Orders of day and month in numeric dates; which one a column uses is settled by ``operators.date_order``.
MONTH_FIRST, DAY_FIRST = "month", "day"
_NUMERIC = r"^(\d{1,2})([/.\-])(\d{1,2})\2(\d{4})(?:[ T](\d{1,2}:\d{2}(?::\d{2})?))?$"


def numeric_separator(value: Column | str) -> Column:
    """The sign between the numbers of a date such as 3/12/2024 or 3.12.2024 10:15; null for other texts."""
    found = F.regexp_extract(strip(value), _NUMERIC, 2)
    return F.when(found != "", found)


# What ``strip`` may touch at either end; texts without these need no regular expression.
_EDGES = " \t\n\x0b\f\r\x85\u2028\u2029"


def _bare(value: Column | str, then: Callable[[Column], Column]) -> Column:
    """``then`` of the stripped text."""
    edged = once(as_col(value).cast("string"), lambda raw: F.when(F.btrim(raw, F.lit(_EDGES)) == raw, raw).otherwise(strip(raw)))
    return once(edged, then)


def _parts(text: Column) -> Column:
    """The two numbers, the year and perhaps the time of a stripped numeric date; null for other texts."""
    return F.when(text.rlike(_NUMERIC), F.split(text, r"[/.\- T]"))


def _read_parts(part: Column, order: str) -> Column:
    """``_parts`` read in one order. Days and months out of range are no dates, without trying to read them."""
    month, day = (part[0], part[1]) if order == MONTH_FIRST else (part[1], part[0])
    whole, time = F.concat_ws("-", part[2], month, day), F.coalesce(F.get(part, F.lit(3)), F.lit(""))
    full = F.when(F.length(time) <= 5, F.concat(time, F.lit(":00"))).otherwise(time)
    able = month.cast("int").between(1, 12) & day.cast("int").between(1, 31)
    return F.when(able & (time == ""), F.try_to_timestamp(whole, F.lit("yyyy-M-d"))).when(
        able, F.try_to_timestamp(F.concat_ws(" ", whole, full), F.lit("yyyy-M-d H:mm:ss")))


def numeric_dates(value: Column | str, then: Callable[[dict[str, Column]], Column]) -> Column:
    """``then`` of a date of two numbers and a year, read in either order; null for other texts."""
    read = lambda part: then({order: _read_parts(part, order) for order in (MONTH_FIRST, DAY_FIRST)})
    return _bare(value, lambda text: once(_parts(text), lambda part: F.when(part.isNotNull(), read(part))))


def numeric_date(value: Column | str, order: str = MONTH_FIRST) -> Column:
    """A date of two numbers and a year, read in one order; null where that gives no day of the calendar."""
    return numeric_dates(value, lambda read: read[order])


def parse_timestamp(value: Column | str, formats: Sequence[str] = DATE_FORMATS, order: Column | str | None = None) -> Column:
    """Serials first, then the listed formats, then numeric dates in one order; anything else is null.

    ``order`` is ``month`` or ``day``, or a column of these; null and None are month-first.
    """
    def read(text: Column) -> Column:
        tried = [read_format(text, fmt) for fmt in formats]
        return F.coalesce(*tried, once(_parts(text), numeric))

    def numeric(part: Column) -> Column:
        if isinstance(order, Column):
            return F.when(order == DAY_FIRST, _read_parts(part, DAY_FIRST)).otherwise(_read_parts(part, MONTH_FIRST))
        return _read_parts(part, order or MONTH_FIRST)

    return F.coalesce(serial_to_timestamp(value), _bare(value, read))


def parse_date(value: Column | str, formats: Sequence[str] = DATE_FORMATS, order: Column | str | None = None) -> Column:
    return parse_timestamp(value, formats, order).cast("date")


def month_text(value: Column | str) -> Column:
    return F.date_format(as_col(value), "yyyy-MM")


def quarter_text(value: Column | str) -> Column:
    day = as_col(value)
    return F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string"))


def period_start(value: Column | str) -> Column:
    """First day of a period written as 2024-Q3, 2024-07 or 2024."""
    text = strip(value)
    year = F.regexp_extract(text, r"^(\d{4})", 1)
    quarter = F.regexp_extract(text, r"^\d{4}-?Q([1-4])$", 1).try_cast("int")
    month = F.regexp_extract(text, r"^\d{4}-(\d{2})$", 1).try_cast("int")
    number = F.coalesce(quarter * 3 - 2, month, F.when(F.length(text) == 4, F.lit(1)))
    return F.when(
        year != "", F.try_to_timestamp(F.format_string("%s-%02d-01", year, number), F.lit("yyyy-MM-dd")).cast("date")
    )
