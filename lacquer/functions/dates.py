"""Dates of varying precision, kept as ISO text (``YYYY``, ``YYYY-MM``, ``YYYY-MM-DD``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_NAMES = {m: i for i, m in enumerate(_MONTHS, 1)} | {m[:3]: i for i, m in enumerate(_MONTHS, 1)} | {"sept": 9}
_ALT = "|".join(sorted(_NAMES, key=len, reverse=True))
_YEAR = r"(19[3-7]\d)"

# How dates are written, from the most specific on, with the groups of year, month and day.
PATTERNS = (
    ("day", rf"\b{_YEAR}[-.](\d{{1,2}})[-.](\d{{1,2}})\b", 1, 2, 3),
    ("day", rf"(?i)\b{_YEAR}\s*,\s*({_ALT})\.?\s+(\d{{1,2}})\b", 1, 2, 3),
    ("day", rf"(?i)\b({_ALT})\.?\s+(\d{{1,2}})\s*,?\s*{_YEAR}\b", 3, 1, 2),
    ("month", rf"(?i)\b{_YEAR}\s*,\s*({_ALT})\.?\b", 1, 2, 0),
    ("month", rf"(?i)\b({_ALT})\.?\s+'(\d{{2}})\b", 2, 1, 0),
    ("year", rf"\b{_YEAR}\b", 1, 0, 0),
    ("year", r"'(\d{2})\b", 1, 0, 0),
)


def _month(c: Column) -> Column:
    number = c.try_cast("int")
    name = F.try_element_at(F.create_map(*[F.lit(x) for kv in _NAMES.items() for x in kv]), F.lower(c))
    return F.coalesce(number, name)


def parse_date(text: Column) -> Column:
    """struct(iso, precision) of the most specific date in a text, null if there is none.

    Years run from 1930 to 1979, two-digit ones with an apostrophe included; a day up to
    31 is taken in any month.
    """
    return F.coalesce(*[_first(text, *p) for p in PATTERNS])


def _first(text: Column, precision: str, rx: str, y: int, m: int, d: int) -> Column:
    """The first match of one pattern that is a date."""
    every = [F.regexp_extract_all(text, F.lit(rx), F.lit(g)).alias(n) for g, n in ((y, "y"), (m, "m"), (d, "d")) if g]

    def iso(z: Column) -> Column:
        return _iso(z["y"], z["m"] if m else None, z["d"] if d else None, precision)

    return F.try_element_at(F.filter(F.transform(F.arrays_zip(*every), iso), lambda x: x.isNotNull()), F.lit(1))


def _iso(y: Column, m: Column | None, d: Column | None, precision: str) -> Column:
    year = y.try_cast("int")
    year = F.when(year < 100, year + 1900).otherwise(year)
    ok = year.between(1930, 1979)
    iso = F.format_string("%04d", year)
    if m is not None:
        month = _month(m)
        ok = ok & month.between(1, 12)
        iso = F.concat(iso, F.format_string("-%02d", month))
    if d is not None:
        day = d.try_cast("int")
        ok = ok & day.between(1, 31)
        iso = F.concat(iso, F.format_string("-%02d", day))
    return F.when(ok, F.struct(iso.alias("iso"), F.lit(precision).alias("precision")))


def mid_period(iso: Column) -> Column:
    """A partial date completed to the middle of its period."""
    d = F.substring(iso, 1, 10)
    return F.when(F.length(d) == 4, F.concat(d, F.lit("-06-15"))).when(F.length(d) == 7, F.concat(d, F.lit("-15"))).otherwise(d)


def plausible(iso: Column, first: str, last: str) -> Column:
    """Whether a date, completed to mid-period, lies within [first, last]; null and blank are not."""
    return F.coalesce((F.trim(iso) != "") & mid_period(iso).between(first, last), F.lit(False))


def years_in(text: Column) -> Column:
    """All years from 1800 to 2049 in a text that aren't part of a longer number."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?<!\d)(1[89]\d{2}|20[0-4]\d)(?!\d)"), F.lit(1)), lambda y: y.cast("int"))


def first_year(text: Column) -> Column:
    return F.try_element_at(years_in(text), F.lit(1))


def recording_year(text: Column) -> Column:
    """The earliest of several years, null where there is but one."""
    ys = years_in(text)
    return F.when(F.size(ys) >= 2, F.array_min(ys))


def session_date(number: Column) -> Column:
    """YYMMDD at the start of a session number as an ISO date of the 1900s; null out of range."""
    y, m, d = (F.regexp_extract(number, r"^(\d{2})(\d{2})(\d{2})", i) for i in (1, 2, 3))
    ok = m.try_cast("int").between(1, 12) & d.try_cast("int").between(1, 31)
    return F.when(ok, F.concat(F.lit("19"), y, F.lit("-"), m, F.lit("-"), d))


def cue_seconds(index: Column) -> Column:
    """``mm:ss:ff`` in seconds, 75 frames each."""
    m, s, f = (F.regexp_extract(index, r"(\d+):(\d+):(\d+)", i).try_cast("int") for i in (1, 2, 3))
    return m * 60 + s + f / 75.0


def decade(year: Column) -> Column:
    return F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s"))
