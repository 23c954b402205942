"""Rendering of typed table cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def float_text(value: Column) -> Column:
    """Shortest decimal text: plain between 1e-4 and 1e16, else with a two-digit exponent."""
    raw = value.cast("string")
    size = F.abs(value)
    plain = F.regexp_replace(raw.try_cast("decimal(38,21)").cast("string"), "0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    mantissa = F.regexp_replace(F.split_part(raw, F.lit("E"), F.lit(1)), r"\.0$", "")
    power = F.split_part(raw, F.lit("E"), F.lit(2)).try_cast("int")
    scientific = F.concat(
        mantissa,
        F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")),
    )
    return (
        F.when(F.isnan(value), F.lit("NaN"))
        .when(value == float("inf"), F.lit("Infinity"))
        .when(value == float("-inf"), F.lit("-Infinity"))
        .when(~raw.contains("E"), raw)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(scientific)
    )


def table_cell_render(value: Column, data_type: T.DataType) -> Column:
    """Text of one cell, safe inside a Markdown table row; null becomes empty."""
    if isinstance(data_type, T.BooleanType):
        text = F.when(value, F.lit("TRUE")).otherwise(F.lit("FALSE"))
    elif isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        micros = F.date_format(value, "SSSSSS")
        text = F.concat(
            F.date_format(value, "yyyy-MM-dd HH:mm:ss"),
            F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(F.lit("")),
        )
    elif isinstance(data_type, (T.DoubleType, T.FloatType)):
        text = float_text(value.cast("double"))
    else:
        text = value.cast("string")
    for old, new in (("\\", "\\\\"), ("|", "\\|"), ("\r\n", "<br>"), ("\r", "<br>"), ("\n", "<br>")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.when(value.isNull(), F.lit("")).otherwise(text)


def spreadsheet_column_name(number: Column) -> Column:
    """1 is A, 26 is Z, 27 is AA; up to three letters."""

    def letter(index: Column) -> Column:
        return F.char(F.pmod(index, F.lit(26)) + 65)

    one = (number - 1).cast("long")
    two = F.floor(one / 26) - 1
    three = F.floor(two / 26) - 1
    return F.concat(
        F.when(three >= 0, letter(three)).otherwise(F.lit("")),
        F.when(two >= 0, letter(two)).otherwise(F.lit("")),
        letter(one),
    )
