"""Text to numbers the way label files are written: strict, and with the full whitespace set."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from annolytics import settings

_DIGITS = r"[0-9]+(_[0-9]+)*"
_INTEGER = rf"^[+-]?{_DIGITS}$"
_DECIMAL = rf"^[+-]?({_DIGITS}([.]({_DIGITS})?)?|[.]{_DIGITS})([eE][+-]?{_DIGITS})?$"
_NOT_FINITE = r"(?i)^[+-]?(nan|inf|infinity)$"


def strip(text: Column) -> Column:
    space = settings.WHITESPACE
    return F.regexp_replace(text, f"^{space}+|{space}+$", "")


def split_lines(text: Column) -> Column:
    return F.split(text, settings.LINE_BREAK)


def split_fields(stripped: Column) -> Column:
    # a split at one character needs no pattern, which Spark would compile for every text
    return F.split(F.regexp_replace(stripped, f"{settings.WHITESPACE}+", " "), " ")


def is_integer(text: Column) -> Column:
    return text.rlike(_INTEGER)


def to_integer(text: Column) -> Column:
    """BIGINT, or null when the text is no integer or does not fit."""
    return F.when(is_integer(text), F.replace(text, F.lit("_"), F.lit("")).try_cast("bigint"))


def to_number(text: Column) -> Column:
    """DOUBLE, or null when the text is no number; every non-finite spelling becomes NaN.

    A plain cast would also take Java spellings such as `1d` or `0x1p3`.
    """
    return F.when(text.rlike(_DECIMAL), F.replace(text, F.lit("_"), F.lit("")).try_cast("double")).when(
        text.rlike(_NOT_FINITE), F.lit(float("nan"))
    )
