"""Coercion of text cells, as native column expressions.

A cell that cannot be read becomes NULL and never fails the row or the job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewise import schema
from lanewise.functions.dates import date_from_text

_DIGITS = r"[0-9]+(?:_[0-9]+)*"
_NUMBER = rf"^[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"


# Blanks around a cell: all that Unicode has.
_WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_LONGEST_TOKEN = max(map(len, schema.NULL_TOKENS))


def trimmed(cell: Column) -> Column:
    return F.btrim(cell, F.lit(_WHITESPACE))


def unless_empty(text: Column) -> Column:
    """A trimmed cell, NULL when it is one of the spellings of "no data"."""
    short = F.length(text) <= _LONGEST_TOKEN
    return F.when(~(short & F.lower(text).isin(*schema.NULL_TOKENS)), text)


def present(cell: Column) -> Column:
    """The trimmed cell, NULL when it says nothing."""
    return unless_empty(trimmed(cell))


def _number(text: Column) -> Column:
    digits = F.replace(text, F.lit("_"), F.lit(""))
    return F.when(text.rlike(_NUMBER), digits.try_cast("double"))


# The ``*_from`` functions read a cell that went through ``present``, numbers also
# through ``*_digits``, so that an ingest does each of these once per cell.


def int_digits(text: Column) -> Column:
    return F.translate(text, ",_ ", "")


def float_digits(text: Column) -> Column:
    return F.translate(text, schema.CURRENCY_SYMBOLS + ", ", "")


def int_from(digits: Column) -> Column:
    return _number(digits).try_cast("int")


def float_from(plain: Column) -> Column:
    bracketed = F.startswith(plain, F.lit("(")) & F.endswith(plain, F.lit(")"))
    inside = F.concat(F.lit("-"), F.substr(plain, F.lit(2), F.length(plain) - 2))
    return _number(F.when(bracketed, inside).otherwise(plain))


def bool_from(text: Column) -> Column:
    token = F.lower(text)
    return F.when(token.isin(*schema.TRUE_TOKENS), True).when(
        token.isin(*schema.FALSE_TOKENS), False
    )


def parse_int(cell: Column) -> Column:
    """Thousands separators dropped, fractions cut towards zero."""
    return int_from(int_digits(present(cell)))


def parse_float(cell: Column) -> Column:
    """Currency signs and separators dropped; ``(x)`` means ``-x``."""
    return float_from(float_digits(present(cell)))


def parse_date(cell: Column) -> Column:
    """The first known spelling that fits; day before month where both would."""
    return date_from_text(present(cell))


def parse_bool(cell: Column) -> Column:
    """True, False, or NULL for "the file did not say"."""
    return bool_from(present(cell))


def clean_text(cell: Column, limit: int) -> Column:
    return F.substring(present(cell), 1, limit)


def join_place(city: Column, country: Column) -> Column:
    """``city, country``, whichever is known, or NULL."""
    parts = (F.nullif(city, F.lit("")), F.nullif(country, F.lit("")))
    return F.nullif(F.concat_ws(", ", *parts), F.lit(""))


def normalize_header(header: Column) -> Column:
    return F.regexp_replace(F.lower(header), r"[^\p{L}\p{N}]", "")
