import math
import random
import struct
from datetime import datetime, timezone

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from barlake import functions as fn


def doubles(count, seed):
    """Doubles of every size, many of them on or next to a decimal tie."""
    rng = random.Random(seed)
    values = [0.0, -0.0, 1.005, 2.675, 1.115, 0.285, 0.125, 0.375, -0.001, -2.5, 1e15, 1e16, 1e22]
    for _ in range(count):
        cents = rng.randrange(-10 ** rng.randrange(1, 9), 10 ** rng.randrange(1, 9))
        values.append(cents / 100 + rng.choice([0.0, 0.005, 0.0005, 0.00005]))
        values.append(rng.uniform(-1, 1) * 10 ** rng.randrange(-8, 18))
        values.append(rng.randrange(-4000, 4000) / 2 ** rng.randrange(0, 12))
    return values


def same_bits(a, b):
    return struct.pack("d", a) == struct.pack("d", b)


@pytest.mark.parametrize("places", [2, 4])
def test_round_places_is_exact_rounding(spark, places):
    rows = spark.createDataFrame([(x,) for x in doubles(6000, places)], "x DOUBLE")
    for row in rows.select("x", fn.round_places("x", places).alias("r")).collect():
        assert same_bits(row.r, round(row.x, places)), row


def test_round_places_keeps_special_values(spark):
    rows = spark.createDataFrame([(math.nan,), (math.inf,), (-math.inf,), (None,)], "x DOUBLE")
    got = [row.r for row in rows.select(fn.round_places("x", 2).alias("r")).collect()]
    assert math.isnan(got[0]) and got[1:] == [math.inf, -math.inf, None]


def test_number_text_prints_like_line_protocol_writers(spark):
    values = [1e7, 12345678.9, 1e-4, 1.5e-5, 0.001, 0.00012, 1e15, 1e16, 1.5e17, -3e-7, 1e100,
              123.0, -0.0, 2e-308, 9999999.0, 123456789012345.6]
    rows = spark.createDataFrame([(x,) for x in values], "x DOUBLE")
    got = [row.t for row in rows.select(fn.number_text("x").alias("t")).collect()]
    assert got == [repr(x) for x in values]
    special = spark.createDataFrame([(math.nan,), (math.inf,), (-math.inf,)], "x DOUBLE")
    texts = [row.t for row in special.select(fn.number_text("x").alias("t")).collect()]
    assert texts == ["nan", "inf", "-inf"]


def test_number_text_reads_back_as_the_same_number(spark):
    rows = spark.createDataFrame([(x,) for x in doubles(1000, 7)], "x DOUBLE")
    for row in rows.select("x", fn.number_text("x").alias("t")).collect():
        assert float(row.t) == row.x


def test_bigint_rounds_half_to_even(spark):
    rows = spark.createDataFrame(
        [(0.4,), (0.5,), (1.7,), (2.5,), (3.5,), (-2.5,), (None,)], "x DOUBLE")
    got = [row.n for row in rows.select(fn.to_bigint_half_even("x").alias("n")).collect()]
    assert got == [0, 0, 2, 2, 4, -2, None]


def test_bigint_overflow_fails(spark):
    rows = spark.createDataFrame([(1e19,)], "x DOUBLE")
    with pytest.raises(PySparkException):
        rows.select(fn.to_bigint_half_even("x")).collect()


def test_to_double_takes_decimal_numbers_only(spark):
    texts = ["1.5", " 2 ", "1e3", "-.5", "nan", "inf", "abc", "", "1.5d", "2f", "0x1p3", None]
    rows = spark.createDataFrame([(x,) for x in texts], "x STRING")
    got = [row.n for row in rows.select(fn.to_double("x").alias("n")).collect()]
    assert got[:4] == [1.5, 2.0, 1000.0, -0.5]
    assert math.isnan(got[4]) and got[5] == math.inf
    assert got[6:] == [None] * 6


def test_dates_are_utc_whatever_the_session_zone(spark):
    instants = [0, -1, 1704067199999, 1704067200000, -86400000, -86400001]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = spark.createDataFrame([(x,) for x in instants], "ms BIGINT")
        got = [row.d for row in rows.select(fn.utc_date_text("ms").alias("d")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [datetime.fromtimestamp(ms / 1000, timezone.utc).strftime("%Y-%m-%d")
                   for ms in instants]


def test_first_truthy_and_percent_change(spark):
    rows = spark.createDataFrame(
        [(0.0, 5.0, 7.0), (None, 0.0, 0.0), (3.0, 5.0, 7.0), (None, None, None)],
        "a DOUBLE, b DOUBLE, c DOUBLE")
    got = [row.x for row in rows.select(fn.first_truthy("a", "b", "c").alias("x")).collect()]
    assert got == [5.0, 0.0, 3.0, None]
    changes = rows.select(fn.percent_change("c", "b").alias("p")).collect()
    assert [row.p for row in changes] == [pytest.approx(40.0), 0.0, pytest.approx(40.0), None]


def test_nanos_and_now(spark):
    row = spark.range(1).select(
        fn.nanos_of_millis(F.lit(1704067200123)).alias("ns"), fn.millis_now().alias("now")).first()
    assert row.ns == 1704067200123000000
    assert row.now > 1704067200123
