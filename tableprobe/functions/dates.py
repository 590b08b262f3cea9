"""Dates in text: what day a cell names, in which format it does so, and what is odd about it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprobe.functions.values import trimmed

# Shapes, month-name patterns, and the limits of plausibility.
ISO = r"(?i)^(\d{4})-(\d{2})-(\d{2})(?:[t ]\d{2}:\d{2}(?::\d{2})?(?:\.\d+)?(?:z|[+-]\d{2}:?\d{2})?)?$"
PARTS = r"^(\d{1,4})([/.-])(\d{1,2})\2(\d{1,4})$"
BARE_ISO = r"^\d{4}-\d{2}-\d{2}$"
MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
CENTURY_PIVOT = 68
OLDEST_YEAR = 1900
DATE_SHARE = 0.7


# A weekday may come first and a time last; parts are parted by blanks, commas or hyphens.
_WEEKDAY, _TIME = r"(?:(?:sun|mon|tue|wed|thu|fri|sat)[a-z]*,?\s+)?", r"(?:,?\s+\d{1,2}:\d{2}(?::\d{2})?(?:\s*[ap]m)?)?"
MONTH_FIRST = rf"(?i)^{_WEEKDAY}({MONTHS})\.?[\s-]+(\d{{1,2}})(?:\s*,\s*|[\s-]+)(\d{{4}}){_TIME}$"
DAY_FIRST = rf"(?i)^{_WEEKDAY}(\d{{1,2}})[\s-]+({MONTHS})\.?(?:\s*,\s*|[\s-]+)(\d{{4}}){_TIME}$"
#: What any date has, whether it begins with a digit or not: cells without it cost one search.
_MONTH = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
_DIGIT_HINT, _LETTER_HINT = rf"(?i)^\d{{1,4}}(?:[/.-]\d{{1,2}}[/.-]\d|.*{_MONTH})", rf"(?i){_MONTH}.*\d"
_ABBREVIATED = "janfebmaraprmayjunjulaugsepoctnovdec"


def _day(y: Column, m: Column, d: Column) -> Column:
    """A calendar day, or null where there is none."""
    return _with(F.when(y.between(1, 9999) & m.between(1, 12), F.make_date(y, m, F.lit(1))), lambda first: F.when(d.between(1, F.dayofmonth(F.last_day(first))), F.date_add(first, d - 1)))


def parse_date(c: Column, kind: T.DataType = T.StringType()) -> Column:
    """struct(day, format), null where the cell names no day.

    ISO dates first; then three numbers with one separator, year first or last: a part over 12 must be the
    day, else the month comes first, and years of two digits pivot at 68; then English month names before or after
    the day, with a year of four digits, where a day up to 31 beyond the month's end runs on into the next."""
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.when(c.isNotNull(), F.struct(c.cast("date").alias("day"), F.lit("Date-object").alias("format")))
    if isinstance(kind, (T.NumericType, T.BooleanType)):  # one number alone is no date
        return F.lit(None).cast("struct<day:date,format:string>")
    read = lambda s: F.when(s.rlike(ISO), _iso(s)).when(s.rlike(PARTS), _with(_pieces(s), _numbered)).otherwise(_named(s))
    hinted = lambda s: F.when(F.substring(s, 1, 1).between("0", "9"), s.rlike(_DIGIT_HINT)).otherwise(s.rlike(_LETTER_HINT))
    return _with(trimmed(c.cast("string")), lambda s: F.when(hinted(s), _with(read(s), lambda d: F.when(d["day"].isNotNull(), d))))


def _with(value: Column, use) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), 0)


def _dated(day: Column, label: Column | str) -> Column:
    return F.struct(day.alias("day"), (F.lit(label) if isinstance(label, str) else label).alias("format"))


def _iso(s: Column) -> Column:
    part = lambda at, n: F.substring(s, at, n).try_cast("int")
    return _dated(_day(part(1, 4), part(6, 2), part(9, 2)), "ISO-8601")


def _pieces(s: Column) -> Column:
    text = lambda k: F.regexp_extract(s, PARTS, k)
    return F.struct(
        F.length(text(1)).alias("n_first"), F.length(text(4)).alias("n_last"),
        text(1).try_cast("int").alias("a"), text(3).try_cast("int").alias("b"), text(4).try_cast("int").alias("last"),
    )


def _numbered(p: Column) -> Column:
    a, b, last = p["a"], p["b"], p["last"]
    year = F.when(p["n_last"] >= 4, last).when(last <= CENTURY_PIVOT, last + 2000).otherwise(last + 1900)
    year_first, day_first = p["n_first"] == 4, (a > 12) & (b <= 12)
    y = F.when(year_first, a).otherwise(year)
    m = F.when(year_first | day_first, b).otherwise(a)
    d = F.when(year_first, last).when(day_first, a).otherwise(b)
    return _dated(_day(y, m, d), F.when(year_first, "ISO-like-slash").when(day_first, "EU-slash").otherwise("US-slash"))


def _named(s: Column) -> Column:
    def dated(shape: str, month: int, day: int) -> Column:
        number = lambda k: F.regexp_extract(s, shape, k).try_cast("int")
        place = F.instr(F.lit(_ABBREVIATED), F.lower(F.substring(F.regexp_extract(s, shape, month), 1, 3)))
        y, d = number(3), number(day)
        return F.when(y.between(1, 9999) & d.between(1, 31), F.date_add(F.make_date(y, ((place + 2) / 3).cast("int"), F.lit(1)), d - 1))

    day = F.when(s.rlike(MONTH_FIRST), dated(MONTH_FIRST, 1, 2)).when(s.rlike(DAY_FIRST), dated(DAY_FIRST, 2, 1))
    return _dated(day, "Other")


def normalized_date(parsed: Column) -> Column:
    return F.date_format(parsed["day"], "yyyy-MM-dd")


def month_of(parsed: Column) -> Column:
    return F.date_format(parsed["day"], "yyyy-MM")


def date_flag(parsed: Column, as_of: str) -> Column:
    """too-old, future, or null."""
    day = parsed["day"]
    return F.when(F.year(day) < OLDEST_YEAR, "too-old").when(day > F.lit(as_of).cast("date"), "future")


def iso_or_parsed(c: Column) -> Column:
    """A bare ISO date as it stands, any other that is understood as ISO, else null."""
    s = trimmed(c)
    return F.when(s.rlike(BARE_ISO), s).otherwise(normalized_date(parse_date(c)))
