"""The row contracts, as DDL where only reading needs them."""

from __future__ import annotations

from pyspark.sql import types as T

TICK = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("quantity", T.DoubleType()),
    T.StructField("trade_id", T.LongType()),
    T.StructField("timestamp_ms", T.LongType()),
    T.StructField("ingested_at_ms", T.LongType()),
    T.StructField("side", T.StringType()),
])

BRONZE_TICK_DDL = (
    "symbol STRING NOT NULL, price DOUBLE NOT NULL, quantity DOUBLE NOT NULL, "
    "trade_id BIGINT NOT NULL, timestamp_ms BIGINT NOT NULL, ingested_at_ms BIGINT NOT NULL, "
    "side STRING NOT NULL, source STRING NOT NULL, day DATE"
)

# The payload keys "t" and "T" differ only by case. Columns of a struct are looked up without
# regard to case, so the payload is renamed by position (a struct cast) before anything reads it.
TRADE_ENVELOPE = (
    "data STRUCT<e: STRING, s: STRING, p: STRING, q: STRING, t: BIGINT, T: BIGINT, m: BOOLEAN>, "
    "malformed STRING"
)
TRADE_FIELDS = (
    "STRUCT<trade: STRUCT<event: STRING, symbol: STRING, price_text: STRING, "
    "quantity_text: STRING, trade_id: BIGINT, timestamp_ms: BIGINT, buyer_is_maker: BOOLEAN>, "
    "malformed: STRING>"
)

CANDLE_COLUMNS = ["symbol", "open", "high", "low", "close", "volume", "trade_count", "timestamp"]

BAR_DOCUMENT = (
    "status STRING, error STRING, results ARRAY<STRUCT<t: BIGINT, o: DOUBLE, h: DOUBLE, "
    "l: DOUBLE, c: DOUBLE, v: DOUBLE, vw: DOUBLE, n: BIGINT>>"
)

BAR = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.DoubleType()),
    T.StructField("vwap", T.DoubleType()),
    T.StructField("trade_count", T.LongType()),
    T.StructField("timestamp_ms", T.LongType()),
    T.StructField("ingested_at_ms", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("adjusted", T.BooleanType()),
])

OBSERVATION_DOCUMENT = "observations ARRAY<STRUCT<date: STRING, value: STRING>>"
