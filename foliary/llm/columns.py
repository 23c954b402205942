"""Column helpers of the native operators: words of a text and single evaluation of a shared value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of the word rule: blank and tab to carriage return.
BLANK = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once."""
    return F.transform(F.array(value), body)[0]


def whole(text: Column | str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def squeezed(text: Column) -> Column:
    """The text without its white space."""
    return F.translate(text, BLANK, "")


def word_list(text: Column) -> Column:
    """The words of a text in order."""
    return F.filter(F.split(F.translate(text, BLANK, " " * len(BLANK)), " ", -1), lambda w: w != "")
