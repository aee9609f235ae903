"""Text messages to typed rows. Works on batch and streaming frames alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barlake.dimensions import TICK_SOURCE
from barlake.functions import day_of_millis, millis_now, to_double
from barlake.operators.quality import require_valid, split_valid
from barlake.schemas import TICK, TRADE_ENVELOPE, TRADE_FIELDS

# What each consumer of the tick topic needs from a message.
ARCHIVE_FIELDS = TICK.fieldNames()
CANDLE_FIELDS = ["symbol", "price", "quantity"]


def parse_once(df: DataFrame, parsed: Column, name: str) -> DataFrame:
    """Add a parsed column that later filters do not parse again.

    A filter on a projected expression is pushed below the projection, which repeats the expression
    once per predicate. Filters on the output of a generator stay above it.
    """
    return df.select("*", F.explode(F.array(parsed)).alias(name))


def decode_trades(envelopes: DataFrame, received_ms: Column | None = None,
                  symbols: Sequence[str] | None = None,
                  keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Trade envelopes (a `value` text column) to (ticks, rejected).

    Events other than trades are dropped without a report, as are pairs outside `symbols`.
    `received_ms` is the arrival time, the clock by default; `keep` names columns to carry along.
    """
    envelope = F.from_json(
        "value", TRADE_ENVELOPE, {"columnNameOfCorruptRecord": "malformed"}).cast(TRADE_FIELDS)
    parsed = parse_once(envelopes, envelope, "envelope")
    event = F.col("envelope.trade.event")
    not_json = F.col("envelope").isNull() | (
        F.col("envelope.malformed").isNotNull() & F.col("envelope.trade").isNull())
    ticks = parsed.filter((event == "trade") | not_json).select(
        *keep,
        "value",
        F.coalesce(event, F.lit("")).alias("event"),
        F.col("envelope.trade.symbol").alias("symbol"),
        to_double("envelope.trade.price_text").alias("price"),
        to_double("envelope.trade.quantity_text").alias("quantity"),
        F.col("envelope.trade.trade_id").alias("trade_id"),
        F.col("envelope.trade.timestamp_ms").alias("timestamp_ms"),
        (millis_now() if received_ms is None else received_ms).alias("ingested_at_ms"),
        F.when(F.col("envelope.trade.buyer_is_maker") == F.lit(False), "buy")
        .otherwise("sell").alias("side"))
    is_trade = F.col("event") == "trade"
    valid, rejected = split_valid(ticks, {
        "not_json": is_trade,
        **{field: ~is_trade | F.col(field).isNotNull()
           for field in ["symbol", "price", "quantity", "trade_id", "timestamp_ms"]}})
    if symbols is not None:
        valid = valid.filter(F.col("symbol").isin(list(symbols)))
    return valid.select(*keep, *ARCHIVE_FIELDS), rejected.select(*keep, "value", "reason")


def encode_ticks(ticks: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Ticks to topic records: the symbol as key, the tick as JSON."""
    return ticks.select(
        *keep,
        F.col("symbol").alias("key"),
        F.to_json(F.struct(*ARCHIVE_FIELDS), {"ignoreNullFields": "false"}).alias("value"))


def _tick_fields(records: DataFrame, keep: Sequence[str]) -> DataFrame:
    text = F.col("value").cast("string")
    parsed = parse_once(records, F.from_json(text, TICK), "tick")
    return parsed.select(*keep, text.alias("value"), "tick.*")


def decode_ticks(records: DataFrame, required: Sequence[str] = ARCHIVE_FIELDS,
                 keep: Sequence[str] = (), strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Topic records (`value` as text or bytes) to (ticks, rejected).

    `required` names the fields a consumer cannot do without; rows lacking one are rejected with
    the names of the fields, or fail the job when `strict`.
    """
    fields = _tick_fields(records, keep)
    rules = {name: F.col(name).isNotNull() for name in required}
    valid, rejected = split_valid(fields, rules)
    if strict:
        valid = require_valid(fields, rules)
    return valid.select(*keep, *ARCHIVE_FIELDS), rejected.select(*keep, "value", "reason")


def archive_rows(ticks: DataFrame, source: str = TICK_SOURCE) -> DataFrame:
    """Ticks as bronze rows, with the source literal and the arrival day to partition by."""
    return ticks.select(
        *ARCHIVE_FIELDS, F.lit(source).alias("source"),
        day_of_millis("ingested_at_ms").alias("day"))
