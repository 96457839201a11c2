"""Column expressions over times: parsing, expansion, overlap, decay, extraction from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN_END, UNKNOWN = "9999-12-31", "1900-01-01"
RANGE = r"(?i)\b(\d{4})\s*(?:to|-)\s*(\d{4})\b"
YEAR = r"\b(1\d{3}|2\d{3})\b"
DATE = r"\b(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})\b"


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def iso_date(text) -> Column:
    """A date from text that begins with yyyy-MM-dd, else null."""
    text = col(text)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10).try_cast("date"))


def parse_timestamp(text) -> Column:
    """Four characters: 1 January of that year; ISO: its date; anything else: UNKNOWN."""
    text = col(text)
    year = F.when(text.rlike(r"^\d{4}$"), F.concat(text, F.lit("-01-01")).try_cast("date"))
    return F.coalesce(year, iso_date(text), F.lit(UNKNOWN).cast("date"))


#: Month names, which may be cut from three letters on.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DAY_MONTH = r"(?i)^(?:[a-z]+day,?\s+)?([0-9]{1,2})(?:st|nd|rd|th)?[\s-]+(?:of\s+)?([a-z]{3,9})[.,]*[\s-]+([0-9]{4})$"
MONTH_DAY = r"(?i)^(?:[a-z]+day,?\s+)?([a-z]{3,9})[.]?\s+([0-9]{1,2})(?:st|nd|rd|th)?,?\s+([0-9]{4})$"
MONTH_YEAR = r"(?i)^([a-z]{3,9})[.,]*[\s-]+(?:of\s+)?([0-9]{4})$"
YEAR_MONTH_DAY = r"^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})$"
AGO = r"(?i)^([0-9]{1,4}|an?|one)\s+(day|week|month|year)s?\s+ago$"
NEXT = r"(?i)^(last|next)\s+(day|week|month|year)$"


def parse_lenient(text, today=None) -> Column:
    """A date in any of the forms of `date_forms`; null if none."""
    text = F.btrim(col(text), F.lit(" \t\n\r\f"))
    year = F.when(text.rlike(r"^\d{4}$"), F.concat(text, F.lit("-01-01")).try_cast("date"))
    return F.coalesce(year, iso_date(text), numeric_date(text), *date_forms(text, today))


def month_number(name) -> Column:
    """1 to 12 of a month's name, whole or cut to three letters or more; null of other words."""
    known = {month[:n]: k + 1 for k, month in enumerate(MONTHS) for n in range(3, len(month) + 1)}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), F.lower(col(name)))


def _made(year, month, day) -> Column:
    """A date; a part that is null is written as null, which is no date."""
    return F.format_string("%04d-%02d-%02d", year, month, day).try_cast("date")


def date_forms(text, today=None) -> list[Column]:
    """Dates in words and with the year first: `12 March 2019`, `the 3rd of Aug. 2019` without its article, `March 12, 2019`, `Sept 2019` (its first day), `2019/03/12`.

    With `today`, a date: today, yesterday, tomorrow, `3 days ago`, `a week ago`, `last month`, `next year`.
    """
    text = F.regexp_replace(col(text), "(?i)^(?:on|in|the)\\s+(?:the\\s+)?", "")

    def part(pattern: str, k: int) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))

    number = lambda pattern, k: part(pattern, k).try_cast("int")
    out = [
        _made(number(DAY_MONTH, 3), month_number(part(DAY_MONTH, 2)), number(DAY_MONTH, 1)),
        _made(number(MONTH_DAY, 3), month_number(part(MONTH_DAY, 1)), number(MONTH_DAY, 2)),
        _made(number(MONTH_YEAR, 2), month_number(part(MONTH_YEAR, 1)), F.lit(1)),
        _made(number(YEAR_MONTH_DAY, 1), number(YEAR_MONTH_DAY, 2), number(YEAR_MONTH_DAY, 3)),
    ]
    if today is not None:
        today, low = col(today), F.lower(text)
        count = F.coalesce(number(AGO, 1), F.when(part(AGO, 1).isNotNull(), 1))
        steps = F.when(count.isNotNull(), -count).when(F.lower(part(NEXT, 1)) == "last", -1).when(F.lower(part(NEXT, 1)) == "next", 1)
        unit = F.lower(F.coalesce(part(AGO, 2), part(NEXT, 2)))
        moved = F.when(unit == "day", F.date_add(today, steps)).when(unit == "week", F.date_add(today, 7 * steps)).when(unit == "month", F.add_months(today, steps)).when(unit == "year", F.add_months(today, 12 * steps))
        near = F.when(low == "today", today).when(low == "yesterday", F.date_sub(today, 1)).when(low == "tomorrow", F.date_add(today, 1))
        out += [near, moved]
    return out


def numeric_date(text) -> Column:
    """month-day-year with - or /, day-month-year if the first cannot be a month; two-digit years below 69 are of this century."""
    parts = F.split(col(text), "[-/]")
    part = lambda k: F.try_element_at(parts, F.lit(k)).try_cast("int")
    year = F.when(part(3) < 69, part(3) + 2000).when(part(3) < 100, part(3) + 1900).otherwise(part(3))
    first = part(1) <= 12
    made = _made(year, F.when(first, part(1)).otherwise(part(2)), F.when(first, part(2)).otherwise(part(1)))
    # Years of three digits and more than four, and years in front, are other forms.
    return F.when((F.size(parts) == 3) & (F.length(parts[0]) <= 2), made)


def overlaps(start, end, q_start, q_end) -> Column:
    """Closed periods overlap; no start is always valid, no end is open, no query end is the query start."""
    start, end, q_start, q_end = (F.nullif(col(x), F.lit("")) for x in (start, end, q_start, q_end))
    q_low = parse_timestamp(q_start)
    q_high = F.when(q_end.isNull(), q_low).otherwise(parse_timestamp(q_end))
    high = F.when(end.isNull(), F.lit(OPEN_END).cast("date")).otherwise(parse_timestamp(end))
    return start.isNull() | ((parse_timestamp(start) <= q_high) & (q_low <= high))


def year_of(text) -> Column:
    return F.substring(col(text), 1, 4).try_cast("double")


def decay(start, end, year, sigma: float = 5.0, default: float = 2025.0, neutral: float = 0.5) -> Column:
    """Gaussian of the distance from the period's middle year; without a start neutral, unreadable years count as `default`."""
    start, end = F.nullif(col(start), F.lit("")), F.nullif(col(end), F.lit(""))
    low = year_of(start)
    high = F.when(end.isNull(), low).otherwise(year_of(end))
    middle = F.coalesce((low + high) / 2, F.lit(default))
    return F.when(start.isNull(), F.lit(neutral)).otherwise(F.exp(-F.pow(col(year) - middle, 2) / F.lit(2 * sigma * sigma)))


def expand(text) -> Column:
    """(start, end) of a year, a month, or a day; null of null or empty."""
    text = F.replace(F.nullif(col(text), F.lit("")), F.lit("/"), F.lit("-"))
    first = F.concat(text, F.lit("-01")).try_cast("date")
    return (
        F.when(text.isNull(), None)
        .when(text.rlike(r"^\d{4}$"), F.struct(F.concat(text, F.lit("-01-01")).alias("start"), F.concat(text, F.lit("-12-31")).alias("end")))
        .when(text.rlike(r"^\d{4}-\d{2}$") & first.isNotNull(), F.struct(first.cast("string").alias("start"), F.last_day(first).cast("string").alias("end")))
        .otherwise(F.struct(text.alias("start"), text.alias("end")))
    )


def year_ranges(text) -> Column:
    """Array of (start, end) of the year ranges in a text."""
    low, high = (F.regexp_extract_all(col(text), F.lit(RANGE), F.lit(k)) for k in (1, 2))
    return F.zip_with(low, high, lambda a, b: F.struct(F.concat(a, F.lit("-01-01")).alias("start"), F.concat(b, F.lit("-12-31")).alias("end")))


def single_years(text) -> Column:
    """Years in a text outside of its ranges."""
    return F.regexp_extract_all(F.regexp_replace(col(text), RANGE, "~"), F.lit(YEAR), F.lit(1))


def dates(text) -> Column:
    """Dates in a text that are written in numbers."""
    found = F.regexp_extract_all(col(text), F.lit(DATE), F.lit(1))
    return F.array_compact(F.transform(found, lambda x: numeric_date(x)))


def query_interval(text, default: tuple[str, str] = ("2025-01-01", "2025-12-31")) -> Column:
    """(start, end) that a question asks for: its first range, else year, else date, else the default."""
    year, day = F.try_element_at(single_years(text), F.lit(1)), F.try_element_at(dates(text), F.lit(1)).cast("string")
    pair = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    return F.coalesce(
        F.try_element_at(year_ranges(text), F.lit(1)),
        F.when(year.isNotNull(), pair(F.concat(year, F.lit("-01-01")), F.concat(year, F.lit("-12-31")))),
        F.when(day.isNotNull(), pair(day, day)),
        pair(F.lit(default[0]), F.lit(default[1])),
    )


def confidence(kind) -> Column:
    return F.when(col(kind) == "range", 0.9).when(col(kind).isin("year", "date"), 0.8).otherwise(0.5)


def validity(start, end) -> Column:
    """A period from raw strings: null without a start, open without an end."""
    start, end = F.nullif(F.trim(col(start)), F.lit("")), F.nullif(F.trim(col(end)), F.lit(""))
    return F.when(start.isNotNull(), F.struct(start.alias("start"), end.alias("end")))


def boost(start, end, q_start, q_end, beta: float = 2.0) -> Column:
    """1 + beta for what has a period that overlaps the query's, else 1."""
    timed = F.nullif(col(start), F.lit("")).isNotNull()
    return F.when(timed & overlaps(start, end, q_start, q_end), 1.0 + beta).otherwise(1.0)


def validated(times, q_start) -> Column:
    """(valid, reason, kept) of a question's start against the context's sorted times: only times up to it may be used."""
    times, q_start = col(times), col(q_start)
    kept = F.filter(times, lambda t: t <= q_start)
    none = F.array().cast("array<string>")
    made = lambda valid, reason, left: F.struct(F.lit(valid).alias("valid"), F.lit(reason).cast("string").alias("reason"), left.alias("kept"))
    return (
        F.when(F.size(F.coalesce(times, none)) == 0, made(False, "no_temporal_data", none))
        .when(q_start.isNull(), made(True, None, times))
        .when(F.size(kept) == 0, made(False, "before_all_contexts", none))
        .otherwise(made(True, None, kept))
    )
