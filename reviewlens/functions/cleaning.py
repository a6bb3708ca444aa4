"""Column functions for messy scalar text: dirty tokens, decimal commas, localised dates, keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of "no value" in the raw tables.
DIRTY_TOKENS = ("no information", "nan", "none", "null", "", "na")

# Wording of the stay and date fields.
NIGHTS_PATTERN = r"Đã ở (\d+) đêm"
MONTH_PATTERN = r"Tháng\s+(\d+)"
LOCAL_DATE_PATTERN = r"(\d+)\s+tháng\s+(\d+)\s+(\d+)"

# Fixed value: the number in a rank text.
NUMBER_PATTERN = r"(\d+(?:\.\d+)?)"
# Plain and scientific notation only: Spark's own cast would also read "1d" and "inf".
DECIMAL_GUARD = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# Spark's trim strips the space character only; reviews also carry tabs, NBSP and typographic spaces.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(column: Column) -> Column:
    """Trim every kind of white space from both ends."""
    return F.btrim(column, F.lit(WHITESPACE))


def clean_token(column: Column, dirty: Sequence[str] = DIRTY_TOKENS) -> Column:
    """Trimmed lower-case text, null where it is one of the ``dirty`` spellings."""
    tidy = F.lower(strip(column.cast("string")))
    return F.when(~tidy.isin(*dirty), tidy)


def decimal_comma(column: Column, strict: bool = False) -> Column:
    """Read ``8,5`` as 8.5. Unreadable text becomes null, or fails the job when ``strict``."""
    text = F.replace(column, F.lit(","), F.lit("."))
    if strict:
        return text.cast("double")
    return F.when(text.rlike(DECIMAL_GUARD), text.try_cast("double"))


def clean_number(column: Column, dirty: Sequence[str] = DIRTY_TOKENS, strict: bool = False) -> Column:
    """Dirty token to null, then decimal comma to number."""
    return decimal_comma(clean_token(column, dirty), strict)


def _required(value: Column, what: str) -> Column:
    return F.when(value.isNull(), F.raise_error(F.lit(f"no {what} in row"))).otherwise(value)


def extract_group(column: Column, pattern: str, group: int = 1) -> Column:
    """One regex group; null (not the empty string) where nothing matches."""
    return F.nullif(F.regexp_extract(column, pattern, group), F.lit(""))


def first_number(column: Column) -> Column:
    """First number in free text, for example a star rank."""
    return extract_group(column, NUMBER_PATTERN).try_cast("double")


def extract_int(column: Column, pattern: str, strict: bool = False) -> Column:
    """Integer captured by ``pattern``; rows without it are null, or an error when ``strict``."""
    value = extract_group(column, pattern).try_cast("int")
    return _required(value, pattern) if strict else value


def local_date(column: Column, pattern: str = LOCAL_DATE_PATTERN, strict: bool = False) -> Column:
    """Date from text such as ``12 tháng 8 2023``; the three groups are day, month, year.

    Text without a match gives null; ``strict`` fails the job for a date that does not exist.
    """
    day, month, year = (extract_group(column, pattern, g) for g in (1, 2, 3))
    slashed = F.when(day.isNotNull(), F.concat_ws("/", day, month, year))
    value = F.try_to_timestamp(slashed, F.lit("d/M/yyyy")).cast("date")
    if strict:
        bad = day.isNotNull() & value.isNull()
        return F.when(bad, F.raise_error(F.lit("impossible date in row")).cast("date")).otherwise(value)
    return value


def lenient_date(column: Column, fmt: str = "yyyy-MM-dd") -> Column:
    """Re-read a stored date, null where it does not parse."""
    return F.try_to_timestamp(column, F.lit(fmt)).cast("date")


def synthetic_key(*columns: tuple[Column, str]) -> Column:
    """Join ``(column, null text)`` pairs with ``_`` so that missing parts compare equal."""
    return F.concat_ws("_", *[F.coalesce(c.cast("string"), F.lit(null)) for c, null in columns])


def name_matches(column: Column, keyword: str, literal: bool = False) -> Column:
    """Case-insensitive search in a name; a null name never matches.

    The keyword is a regular expression unless ``literal`` is set.
    """
    if literal:
        keyword = "\\Q" + keyword.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.coalesce(column.rlike("(?iu)" + keyword), F.lit(False))


def half_even(column: Column, digits: int) -> Column:
    """Round half to even."""
    return F.bround(column, digits)


def month_of(column: Column) -> Column:
    """First day of the month, as a date."""
    return F.trunc(column.cast("date"), "MM")
