from barlake.functions.numbers import (
    first_truthy, percent_change, round_places, to_bigint_half_even, to_double,
)
from barlake.functions.text import number_text, two_places
from barlake.functions.times import (
    day_of_millis, instant_of_millis, millis_now, nanos_of_millis, utc_date_text,
)

__all__ = [
    "day_of_millis", "first_truthy", "instant_of_millis", "millis_now", "nanos_of_millis",
    "number_text", "percent_change", "round_places", "to_bigint_half_even", "to_double",
    "two_places", "utc_date_text",
]
