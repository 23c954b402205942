"""Bounded text and list checks; each gives a value or an error, never an exception."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliary.functions.text import is_blank, strip


def _outcome(value: Column, error: Column) -> Column:
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


def bounded_text(text: Column, limit: int) -> Column:
    """struct(value, error): stripped and cut text; blank is an error."""
    return _outcome(F.substring(strip(text), 1, limit), F.when(is_blank(text), F.lit("blank")))


def bounded_string_list(items: Column, maximum: int, limit: int) -> Column:
    """struct(value, error): stripped, cut, ordered distinct, at most `maximum`.

    A blank item is an error only if it comes before the list is full.
    """
    clean = F.transform(items, lambda x: F.substring(strip(x), 1, limit))
    first_blank = F.array_position(F.transform(items, is_blank), F.lit(True))
    before = F.size(F.array_distinct(F.slice(clean, F.lit(1), F.greatest(first_blank - 1, F.lit(0)).cast("int"))))
    error = F.when(items.isNull(), F.lit("not a list")).when(
        (first_blank > 0) & (before < maximum), F.lit("blank item")
    )
    return _outcome(F.slice(F.array_distinct(clean), 1, maximum), error)


def required_text(text: Column, limit: int) -> Column:
    """Error text, or null if the stripped text is non-blank and within the limit."""
    return F.when(is_blank(text), F.lit("blank")).when(F.length(strip(text)) > limit, F.lit("too long"))


def string_list_error(items: Column, maximum: int, limit: int) -> Column:
    """Error text, or null if the list and each item are within their limits."""
    return (
        F.when(items.isNull(), F.lit("not a list"))
        .when(F.size(items) > maximum, F.lit("too many"))
        .when(F.exists(items, lambda x: required_text(x, limit).isNotNull()), F.lit("bad item"))
    )


def unique_non_blank(items: Column) -> Column:
    """struct(value, error): stripped ordered distinct items; any blank is an error."""
    error = F.when(items.isNull(), F.lit("not a list")).when(F.exists(items, is_blank), F.lit("blank item"))
    return _outcome(F.array_distinct(F.transform(items, strip)), error)


def extract_json_object(text: Column) -> Column:
    """JSON text of the one object in a model reply, or null.

    A reply that is one fenced block is unwrapped; then the whole text is tried, then the span
    from the first opening to the last closing brace.
    """
    whole = strip(text)
    fenced = r"(?is)\A```(?:json)?\s*(.*?)\s*```\z"
    inner = F.when(whole.rlike(fenced), strip(F.regexp_extract(whole, fenced, 1))).otherwise(whole)
    start = F.locate("{", inner)
    stop = F.length(inner) - F.locate("}", F.reverse(inner)) + 1
    span = F.when(
        (start > 0) & (stop > start) & inner.contains("}"), F.substring(inner, start, stop - start + 1)
    )

    def as_object(candidate: Column) -> Column:
        kind = F.schema_of_variant(F.try_parse_json(candidate))
        return F.when(kind.startswith("OBJECT"), candidate)

    return F.coalesce(as_object(inner), as_object(span))
