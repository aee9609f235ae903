"""Text forms of numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def number_text(value: Column | str) -> Column:
    """A double as text the way line-protocol writers print it: 10000000.0, 1e-05, 1e+16.

    Spark switches to the 1.0E7 notation at 10^7 and below 10^-3; this switches at 10^16 and
    below 10^-4 and spells exponents with a sign and at least two digits. The digits are the JVM's:
    before version 19 it prints some doubles with one digit more than needed to read them back.
    """
    value = _column(value)
    text = value.cast("string")
    size = F.abs(value)
    scientific = text.contains("E")
    plain = F.regexp_replace(
        text.cast("decimal(38,20)").cast("string"), r"(\.\d)(\d*?)0+$", "$1$2")
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    exponent = F.substring_index(text, "E", -1).cast("int")
    digits = F.abs(exponent).cast("string")
    spelled = F.concat(
        mantissa,
        F.when(exponent < 0, "e-").otherwise("e+"),
        F.when(F.length(digits) < 2, F.concat(F.lit("0"), digits)).otherwise(digits))
    return (F.when(F.isnan(value), "nan")
            .when(value == float("inf"), "inf")
            .when(value == float("-inf"), "-inf")
            .when(~scientific, text)
            .when((size >= 1e-4) & (size < 1e16), plain)
            .otherwise(spelled))


def two_places(value: Column | str) -> Column:
    return F.format_string("%.2f", _column(value))
