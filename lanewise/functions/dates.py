"""Dates in the spellings that exports use.

All formats are alternatives of one regular expression, in order, so the first
that fits wins as it would by trying them in turn. The expression rearranges the
parts into ``year-month-day``, which the plain cast to date then checks. Trying
a timestamp parser per format would throw and catch an exception for every
format that does not fit, on every cell.
"""

from __future__ import annotations

import calendar
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewise import schema

_MONTHS_SHORT = [m.lower() for m in calendar.month_abbr[1:]]
_MONTHS_LONG = [m.lower() for m in calendar.month_name[1:]]
_PARTS = {
    "%Y": r"(?<y@>(?!0000)[0-9]{4})",
    "%y": r"(?<y@>[0-9]{2})",
    "%m": r"(?<m@>1[0-2]|0[1-9]|[1-9])",
    "%b": f"(?<m@>{'|'.join(_MONTHS_SHORT)})",
    "%B": f"(?<m@>{'|'.join(_MONTHS_LONG)})",
    "%d": r"(?<d@>3[01]|[12][0-9]|0[1-9]|[1-9])",
    "%H": r"(?:2[0-3]|[01][0-9]|[0-9])",
    "%M": r"(?:[0-5][0-9]|[0-9])",
    "%S": r"(?:[0-5][0-9]|[0-9])",
}
# Two-digit years below this are 20xx, the rest 19xx.
_CENTURY_PIVOT = "69"
_PLAIN = "^(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}$"
def _alternative(fmt: str, number: int) -> str:
    pieces = re.split(r"(%[A-Za-z])", fmt.replace("T", "t"))
    body = "".join(
        _PARTS[p] if p in _PARTS else re.escape(p).replace(r"\ ", r"\s+") for p in pieces
    )
    return body.replace("@", str(number))


def _rearranged(text: Column, formats: list[str]) -> Column:
    """``year-month-day`` of text written in one of ``formats``, ``--`` of any other."""
    pattern = "|".join(_alternative(f, i) for i, f in enumerate(formats))
    # A group of an alternative that did not match is empty.
    year, month, day = (
        "".join(f"${{{part}{i}}}" for i in range(len(formats))) for part in "ymd"
    )
    return F.regexp_replace(text, f"(?s)^(?:{pattern}|.*)$", f"{year}-{month}-{day}")


def _is_named(fmt: str) -> bool:
    return "%b" in fmt.lower()


def _numeric_date(text: Column) -> Column:
    formats = [f for f in schema.DATE_FORMATS if not _is_named(f)]
    return _rearranged(text, formats).try_cast("date")


def _named_date(text: Column) -> Column:
    def assemble(parts: Column) -> Column:
        year, month, day = (parts.getItem(i) for i in range(3))
        century = F.when(F.length(year) > 2, "").when(year < _CENTURY_PIVOT, "20").otherwise("19")
        number = (F.instr(F.lit("".join(_MONTHS_SHORT)), F.left(month, F.lit(3))) + 2) / 3
        iso = F.concat_ws("-", F.concat(century, year), number.cast("int").cast("string"), day)
        return F.when(year != "", iso.try_cast("date"))

    formats = [f for f in schema.DATE_FORMATS if _is_named(f)]
    parts = F.split(_rearranged(text, formats), "-")
    # A one-element transform computes the parts once for all their uses.
    return F.transform(F.array(parts), assemble).getItem(0)


def date_from_text(cell: Column) -> Column:
    """The date a cell states in one of ``schema.DATE_FORMATS``, else NULL."""
    text = F.lower(cell)
    # By far the commonest spelling needs no rearranging.
    return (
        F.when(cell.rlike(_PLAIN), cell.try_cast("date"))
        .when(text.rlike("[a-z]{3}"), _named_date(text))
        .otherwise(_numeric_date(text))
    )
