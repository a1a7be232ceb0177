"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pitsignal.functions.times import col

_BLANKS = " \t\n\r\x0b\x0c"
_BANNER = r"(?i)EQUIPO\s+\w+\s+([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})"


def strip(c: str | Column) -> Column:
    return F.btrim(col(c), F.lit(_BLANKS))


def tidy_upper(c: str | Column) -> Column:
    return strip(F.upper(col(c)))


def first_three_digits(c: str | Column) -> Column:
    """First run of three digits, null when there is none."""
    return F.nullif(F.regexp_extract(col(c), "([0-9]{3})", 1), F.lit(""))


def zero_fill(c: str | Column, width: int = 3) -> Column:
    """Pad with zeros on the left; longer text stays whole."""
    text = col(c)
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def truck_code(number: str | Column) -> Column:
    return F.concat(F.lit("T-"), zero_fill(number))


def banner_date(c: str | Column) -> Column:
    """``d/m/yyyy`` text of an equipment banner cell, null when the cell is none."""
    return F.nullif(F.regexp_extract(col(c), _BANNER, 1), F.lit(""))


def is_code_header(c: str | Column) -> Column:
    return F.contains(col(c), F.lit("CODIGO EQ."))


def is_digits(c: str | Column) -> Column:
    return F.coalesce(col(c).rlike("^[0-9]+$"), F.lit(False))


def is_plain_number(c: str | Column) -> Column:
    """Digits with at most one point, and at least one digit."""
    text = col(c)
    return F.coalesce(
        text.rlike("^[0-9]*[.]?[0-9]*$") & text.rlike("[0-9]"), F.lit(False)
    )


def grouped_number(c: str | Column, decimals: int = 0) -> Column:
    """``1,234`` or ``1,234.50`` for reports."""
    return F.format_number(col(c), decimals)


def time_text(c: str | Column) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd HH:mm:ss.SSSSSS")
