"""Date and time-of-day rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dispatchmart.functions import fixed_values as V
from dispatchmart.functions.columns import recode

_CLOCK = r"(?<!\d)\d{1,2}:[0-5]\d(?::\d{2})?(?:\.\d+)?\s*(?:[AaPp][Mm])?\s*$"


def _hours() -> dict[str, str]:
    """Hour as found, with A or P when the text said so, to the hour of the day."""
    plain = {text: f"{hour:02d}" for hour in range(24) for text in (f"{hour}", f"{hour:02d}")}
    halves = {
        text + half: f"{hour % 12 + later:02d}"
        for half, later in (("A", 0), ("P", 12))
        for hour in range(1, 13)
        for text in (f"{hour}", f"{hour:02d}")
    }
    return {**plain, **halves}


def day_before(day: Column) -> Column:
    return F.date_sub(day, 1)


def day_before_text(text: Column) -> Column:
    """The day before, text in and text out."""
    return date_text(day_before(F.to_date(text, V.DATE_TEXT_IN)))


def date_text(day: Column) -> Column:
    return F.date_format(day, V.DATE_TEXT)


def minute_of_day(text: Column, compat: bool = False) -> Column:
    """``HH:mm`` out of a date-time text.

    The corrected rule reads the clock at the end of the text, honours AM and PM and
    gives NULL when there is none. ``compat`` cuts by position: six characters off
    the end, the last five of the rest, a zero in front when short.
    """
    if compat:
        cut = F.trim(F.substring(text, F.lit(1), F.greatest(F.length(text) - 6, F.lit(0))))
        clock = F.trim(F.substring(cut, -5, 5))
        return F.substring(F.concat(F.lit("0"), clock), -5, 5)
    found = F.upper(F.regexp_extract(text, _CLOCK, 0))
    half = F.translate(found, "0123456789:. \t\n\r\f\u000bM", "")
    hour = recode(F.concat(F.substring_index(found, ":", 1), half), _hours())
    return F.concat(hour, F.lit(":"), F.substring(F.substring_index(found, ":", 2), -2, 2))


def shift_key(minute: Column, compat: bool = False) -> Column:
    """Shift of an ``HH:mm`` text, -1 for anything else.

    ``compat`` compares the text as it is and puts midnight outside every shift. The
    result is never NULL, so joins on it need no filter that computes it again.
    """
    if compat:
        cases = [
            F.when(minute.between(first, last) & (minute != "00:00"), F.lit(number))
            for number, (first, last) in V.SHIFTS.items()
        ]
        return F.coalesce(*cases, F.lit(V.UNKNOWN_KEY))
    hours = {
        f"{hour:02d}": number
        for number, (first, last) in V.SHIFTS.items()
        for hour in range(int(first[:2]), int(last[:2]) + 1)
    }
    return recode(F.substring(minute, 1, 2), hours, F.lit(V.UNKNOWN_KEY))
