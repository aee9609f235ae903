import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from barlake.operators import decode
from barlake.operators.quality import split_valid

TRADE = {"e": "trade", "s": "BTCUSDT", "t": 12, "p": "42000.5", "q": "0.25",
         "T": 1700000000000, "m": False}


def envelope(**changes):
    """A trade envelope; a change to ... removes the field."""
    data = {k: v for k, v in {**TRADE, **changes}.items() if v is not ...}
    return json.dumps({"stream": "btcusdt@trade", "data": data})


def decoded(spark, *texts, **kwargs):
    frame = spark.createDataFrame([(text,) for text in texts], "value STRING")
    ticks, rejected = decode.decode_trades(frame, F.lit(5).cast("bigint"), **kwargs)
    return ticks.collect(), rejected.collect()


def test_trade_becomes_a_tick(spark):
    ticks, rejected = decoded(spark, envelope())
    assert [tuple(row) for row in ticks] == [
        ("BTCUSDT", 42000.5, 0.25, 12, 1700000000000, 5, "buy")]
    assert rejected == []


@pytest.mark.parametrize("maker, side", [
    (False, "buy"), (True, "sell"), (None, "sell"), (..., "sell"), ("false", "sell"), (0, "sell")])
def test_only_a_false_flag_is_a_buy(spark, maker, side):
    assert decoded(spark, envelope(m=maker))[0][0].side == side


def test_other_events_vanish_without_a_report(spark):
    texts = [envelope(e="aggTrade"), envelope(e=...), '{"stream":"x"}', "{}"]
    assert decoded(spark, *texts) == ([], [])


def test_time_and_id_differ_only_by_case(spark):
    row = decoded(spark, envelope(t=1, T=2))[0][0]
    assert (row.trade_id, row.timestamp_ms) == (1, 2)
    assert decoded(spark, envelope(t=...))[1][0].reason == "trade_id"
    assert decoded(spark, envelope(T=...))[1][0].reason == "timestamp_ms"


@pytest.mark.parametrize("text, reason", [
    (envelope(p="abc"), "price"), (envelope(s=...), "symbol"), (envelope(q=None), "quantity"),
    (envelope(p="x", q="y"), "price,quantity"), ("{bad", "not_json"), ("", "not_json")])
def test_bad_messages_are_reported(spark, text, reason):
    ticks, rejected = decoded(spark, text)
    assert ticks == []
    assert [(row.value, row.reason) for row in rejected] == [(text, reason)]


def test_prices_given_as_numbers_count(spark):
    assert decoded(spark, envelope(p=1.5, q=2))[0][0][1:3] == (1.5, 2.0)


def test_allow_list(spark):
    ticks, rejected = decoded(spark, envelope(), envelope(s="DOGEUSDT"), symbols=["BTCUSDT"])
    assert [row.symbol for row in ticks] == ["BTCUSDT"] and rejected == []


TICK = {"symbol": "A", "price": 1.0, "quantity": 2.0, "trade_id": 3, "timestamp_ms": 4,
        "ingested_at_ms": 5, "side": "buy"}


def records(spark, *texts):
    return spark.createDataFrame([(text.encode(),) for text in texts], "value BINARY")


def test_tick_round_trip_over_bytes(spark):
    ticks, _ = decode.decode_ticks(records(spark, json.dumps(TICK)))
    again = decode.encode_ticks(ticks).first()
    assert again.key == "A" and json.loads(again.value) == TICK


def test_bad_ticks_are_rejected_per_consumer(spark):
    no_id = json.dumps({k: v for k, v in TICK.items() if k != "trade_id"})
    no_symbol = json.dumps({k: v for k, v in TICK.items() if k != "symbol"})
    no_price = json.dumps({**TICK, "price": "12"})
    frame = records(spark, json.dumps({**TICK, "extra": 1}), no_id, no_symbol, no_price, "{bad",
                    "null", "[1]")
    archive, rejected = decode.decode_ticks(frame)
    assert archive.count() == 1 and rejected.count() == 6
    reasons = {row.value: row.reason for row in rejected.collect()}
    assert reasons[no_id] == "trade_id" and reasons[no_price] == "price"
    candle, _ = decode.decode_ticks(frame, required=decode.CANDLE_FIELDS)
    assert candle.count() == 2


def test_strict_decoding_fails_the_job(spark):
    ticks, _ = decode.decode_ticks(records(spark, json.dumps(TICK), "{bad"), strict=True)
    with pytest.raises(PySparkException, match="row breaks: symbol,price"):
        ticks.collect()


def test_archive_rows_carry_source_and_day(spark):
    ticks, _ = decode.decode_ticks(records(spark, json.dumps(TICK)))
    row = decode.archive_rows(ticks).first()
    assert row.source == "binance" and str(row.day) == "1970-01-01"


def test_split_valid_loses_no_row(spark):
    frame = spark.createDataFrame([(1,), (-1,), (None,), (50,)], "x INT")
    valid, rejected = split_valid(frame, {"positive": F.col("x") > 0, "small": F.col("x") < 10})
    assert [row.x for row in valid.collect()] == [1]
    assert {row.x: row.reason for row in rejected.collect()} == {
        -1: "positive", None: "positive,small", 50: "small"}


def test_messages_are_parsed_once(spark):
    frame = spark.createDataFrame([(envelope(),)], "value STRING")
    ticks, _ = decode.decode_trades(frame)
    plan = ticks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1
