"""Number expressions with the rounding, casting and default rules the results depend on."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Splits a double into two halves whose products are exact (2^27 + 1).
_SPLIT = 134_217_729.0
# Up to here (2^53) every whole number is a double.
_WHOLE_UP_TO = 9_007_199_254_740_992.0


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def to_double(text: Column | str) -> Column:
    """Text as a double, null when it is not a decimal number, nan or inf.

    The cast alone would also take the JVM's suffixed and hexadecimal literals ("1.5d", "0x1p3").
    """
    text = _column(text)
    jvm_literal = text.rlike(r"[0-9.][dDfF]\s*$|[xX]")
    return F.when(~jvm_literal, text.try_cast("double"))


def to_bigint_half_even(value: Column | str) -> Column:
    """Double to BIGINT with ties to the even neighbour; overflow and NaN raise."""
    return F.rint(_column(value)).cast("bigint")


def round_places(value: Column | str, places: int) -> Column:
    """Round the exact binary value to decimal places, true ties to even.

    The built-in rounds the shortest decimal text of the number, so it lifts 1.005 to 1.01 although
    the stored double lies below the tie. Here a product that looks like a tie is nudged to the side
    its rounding error, which two half-width products give exactly, says it is on.
    """
    value = _column(value)
    scale = float(10 ** places)
    scaled = value * scale
    high = value * _SPLIT - (value * _SPLIT - value)
    error = (high * scale - scaled) + (value - high) * scale
    nudge = F.when(F.abs(scaled % 1) == 0.5, F.signum(error) * 0.25).otherwise(-0.0)
    # Larger numbers lie further apart than the places, and NaN compares above every number.
    return F.when(F.abs(value) < _WHOLE_UP_TO / scale, F.rint(scaled + nudge) / scale).otherwise(
        value)


def first_truthy(*values: Column | str) -> Column:
    """First value that is neither null nor zero; the last one is taken as it is."""
    *leading, last = [_column(value) for value in values]
    return F.coalesce(*[F.nullif(value, F.lit(0.0)) for value in leading], last)


def percent_change(value: Column | str, base: Column | str) -> Column:
    """Change from base to value in percent, 0 when the base is 0."""
    value, base = _column(value), _column(base)
    return F.when(base == 0, F.lit(0.0)).otherwise(((value - base) / base) * 100)
