"""Market inputs projected from the shared test tables (events, lineitem, supplier, nation).

Each view is a narrow projection of one table, without a filter, so the work of every query grows
with its table. Some rows are given faults on purpose, by row id, so that the rules have something
to reject.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barlake.dimensions import (
    COMMODITY_TICKERS, FOREX_TICKERS, INDEX_TICKERS, MACRO_SERIES,
)
from barlake.functions import utc_date_text
from barlake.operators.decode import encode_ticks


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table as a stream of files, be it one file or a folder of them.

    A streaming path must be a folder or a pattern, hence the pattern that matches one name.
    """
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def _millis(column: str) -> Column:
    """Epoch milliseconds of a zone-less time, read as UTC (the session zone)."""
    return F.unix_millis(F.col(column).cast("timestamp"))


def ticks_of(events: DataFrame) -> DataFrame:
    """Events as ticks that arrive up to 1.75 s after the time the exchange gives them."""
    arrived = _millis("ts")
    return events.select(
        F.upper("event_type").alias("symbol"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("quantity"),
        F.col("event_id").alias("trade_id"),
        (arrived - F.col("user_id") % 8 * 250).alias("timestamp_ms"),
        arrived.alias("ingested_at_ms"),
        F.when(F.col("user_id") % 2 == 0, "buy").otherwise("sell").alias("side"))


def records_of(events: DataFrame) -> DataFrame:
    """Ticks as topic records, every tenth or so damaged in one of three ways."""
    ticks = ticks_of(events).withColumn("offset", F.col("trade_id"))
    fault = F.col("offset") % 31
    return encode_ticks(ticks, keep=["offset"]).withColumn("value",
        F.when(fault == 3, F.concat(F.lit("{"), "value"))
        .when(fault == 11, F.regexp_replace("value", '"symbol":"[A-Z]*",', ""))
        .when(fault == 17, F.regexp_replace("value", '"price":[0-9.E-]*,', '"price":"n/a",'))
        .otherwise(F.col("value")))


def envelopes_of(events: DataFrame) -> DataFrame:
    """Events as trade envelopes, some of them damaged or of another kind."""
    kind = F.col("event_id") % 20
    quoted = lambda text: F.concat(F.lit('"'), text, F.lit('"'))
    parts = F.concat_ws(",",
        F.when(kind == 1, F.lit('"e":"aggTrade"')).otherwise(F.lit('"e":"trade"')),
        F.when(kind != 3, F.concat(F.lit('"s":'), quoted(F.upper("event_type")))),
        F.when(kind != 10, F.concat(F.lit('"t":'), F.col("event_id").cast("string"))),
        F.concat(F.lit('"p":'), quoted(
            F.when(kind == 2, "abc").otherwise(F.col("value").cast("string")))),
        F.when(kind == 9, F.lit('"q":null')).otherwise(
            F.concat(F.lit('"q":'), quoted(F.get_json_object("props", "$.k")))),
        F.concat(F.lit('"T":'), _millis("ts").cast("string")),
        F.when(kind == 6, F.lit('"m":null')).when(kind == 8, F.lit('"m":"false"'))
        .when(kind != 7, F.concat(F.lit('"m":'), (F.col("user_id") % 2 == 1).cast("string"))))
    stream = F.concat(F.lit('"stream":"'), F.col("event_type"), F.lit('@trade"'))
    whole = F.concat(F.lit("{"), stream, F.lit(',"data":{'), parts, F.lit("}}"))
    return events.select(
        F.col("event_id").alias("seq"),
        F.when(kind == 4, F.concat(F.lit("{"), whole))
        .when(kind == 5, F.concat(F.lit("{"), stream, F.lit("}")))
        .otherwise(whole).alias("value"))


def bars_of(lineitem: DataFrame) -> DataFrame:
    """Line items as bronze bars; every silver rule but the one on open rejects some."""
    open_, discount = F.col("l_extendedprice"), F.col("l_discount")
    close = F.when(discount >= 0.10, 0.0).otherwise(open_ * (1 - discount))
    millis = _millis("l_shipdate")
    return lineitem.select(
        F.when(F.col("l_linenumber") != 7, F.concat(F.lit("S"), F.col("l_suppkey")))
        .alias("symbol"),
        utc_date_text(millis).alias("date"),
        open_.alias("open"),
        (open_ * (1 + F.col("l_tax"))).alias("high"),
        (open_ * (1.05 - discount)).alias("low"),
        close.alias("close"),
        (F.col("l_quantity") - 5.5).alias("volume"),
        F.when(F.col("l_linenumber") != 3, (open_ + close) / 2).alias("vwap"),
        F.when(F.col("l_linenumber") != 5, F.col("l_partkey")).alias("trade_count"),
        millis.alias("timestamp_ms"),
        (millis + 86_400_000).alias("ingested_at_ms"),
        F.lit("polygon").alias("source"),
        F.lit(True).alias("adjusted"))


def bar_documents_of(lineitem: DataFrame) -> DataFrame:
    """Line items as bar responses of two bars each; some in error, some without results."""
    open_, discount = F.col("l_extendedprice"), F.col("l_discount")
    millis = _millis("l_shipdate")

    def bar(time: Column, close: Column) -> Column:
        return F.struct(
            time.alias("t"), open_.alias("o"), (open_ * 1.5).alias("h"), (open_ * 0.5).alias("l"),
            close.alias("c"), F.col("l_quantity").alias("v"),
            F.when(F.col("l_linenumber") != 3, open_).alias("vw"),
            F.when(F.col("l_linenumber") != 5, F.col("l_partkey")).alias("n"))

    no_close = F.when(F.col("l_linenumber") != 4, open_ * (1 - discount))
    results = F.array(bar(millis, open_ * (1 + discount)), bar(millis + 86_399_999, no_close))
    return lineitem.select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"),
        F.to_json(F.struct(
            F.when(F.col("l_linenumber") == 1, "ERROR").otherwise("OK").alias("status"),
            F.when(F.col("l_linenumber") != 2, results).alias("results"))).alias("value"))


def universe_of(supplier: DataFrame) -> DataFrame:
    return supplier.select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol"))


def listed_universe_of(supplier: DataFrame) -> DataFrame:
    """Suppliers as listed symbols, and for every tenth supplier one more that never trades."""
    traded = universe_of(supplier)
    idle = supplier.filter(F.col("s_suppkey") % 10 == 3).select(
        F.concat(F.lit("IDLE"), F.col("s_suppkey")).alias("symbol"))
    return traded.unionByName(idle)


def observation_documents_of(events: DataFrame) -> DataFrame:
    """Events as observation responses of two dates; two listed series never occur."""
    event_types = ["click", "view", "purchase", "signup", "error"]
    series = F.create_map(*[F.lit(part) for event_type, (_, series_id, _) in
                            zip(event_types, MACRO_SERIES) for part in (event_type, series_id)])
    day = F.col("ts").cast("date")
    text = F.col("value").cast("string")
    listed = F.array(
        F.struct(F.date_sub(day, 1).cast("string").alias("date"),
                 F.concat(text, F.lit("p")).alias("value")),
        F.struct(day.cast("string").alias("date"), text.alias("value")))
    kind = F.col("event_id") % 10
    return events.select(
        series[F.col("event_type")].alias("series_id"),
        F.col("event_id").alias("seq"),
        F.when(kind == 7, F.lit("{}")).when(kind == 8, F.lit('{"observations":[]}'))
        .otherwise(F.to_json(F.struct(listed.alias("observations")))).alias("value"))


def quote_documents_of(events: DataFrame, tickers: list[tuple[str, str]]) -> DataFrame:
    """Events as quote responses with every kind of gap; the last listed ticker never occurs."""
    names = F.array(*[F.lit(ticker) for _, ticker in tickers])
    kind = F.col("event_id") % 16
    number = lambda column: column.cast("string")
    value = F.col("value")
    meta = F.concat_ws(",",
        F.when(kind == 1, F.lit('"regularMarketPrice":0'))
        .when(kind == 2, F.lit('"regularMarketPrice":null'))
        .when(kind != 3, F.concat(F.lit('"regularMarketPrice":'), number(value))),
        F.when(kind == 4, F.lit('"previousClose":0'))
        .when(kind == 5, F.lit('"previousClose":null'))
        .when(kind != 6, F.concat(F.lit('"previousClose":'), number(value + 0.125))),
        F.when(kind.isin(4, 7), F.lit('"chartPreviousClose":0'))
        .when(kind == 8, F.lit('"chartPreviousClose":null'))
        .when(~kind.isin(6, 9), F.concat(
            F.lit('"chartPreviousClose":'), number(value + F.col("user_id") % 5 - 2.0))),
        F.when(kind == 10, F.lit('"currency":null'))
        .when(kind != 11, F.lit('"currency":"EUR"')))
    return events.select(
        F.get(names, (F.col("user_id") % (len(tickers) - 1)).cast("int")).alias("ticker"),
        F.col("event_id").alias("seq"),
        F.when(kind == 12, F.lit('{"chart":{"result":null,"error":{"code":"Not Found"}}}'))
        .when(kind == 13, F.lit("{truncated"))
        .otherwise(F.concat(
            F.lit('{"chart":{"result":[{"meta":{'), meta, F.lit('}}]}}'))).alias("value"))


def forex_documents_of(events: DataFrame) -> DataFrame:
    return quote_documents_of(events, FOREX_TICKERS)


def commodity_documents_of(events: DataFrame) -> DataFrame:
    return quote_documents_of(events, COMMODITY_TICKERS)


def index_documents_of(events: DataFrame) -> DataFrame:
    return quote_documents_of(events, INDEX_TICKERS)
