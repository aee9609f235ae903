"""Tumbling open/high/low/close/volume candles."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from barlake.functions import instant_of_millis, nanos_of_millis, number_text
from barlake.schemas import CANDLE_COLUMNS

# Fixed value: windows are aligned to 2026-01-01T00:00:00Z.
ALIGN_TO_EPOCH_SECONDS = 1_767_225_600

TIME_COLUMNS = {"arrival": "ingested_at_ms", "event": "timestamp_ms"}

_ID_RANGE = Decimal(10 ** 20)
_ID_OFFSET = Decimal(2 ** 63)
_PARTITION_RANGE = Decimal(10 ** 19)
_TIME_RANGE = Decimal(10 ** 25)


def order_key(millis: Column | str, trade_id: Column | str) -> Column:
    """(time, trade id) as one number that sorts like the pair, for any 64-bit id.

    A struct would do too, but aggregation buffers holding a struct rule out hash aggregation.
    """
    millis = F.col(millis) if isinstance(millis, str) else millis
    trade_id = F.col(trade_id) if isinstance(trade_id, str) else trade_id
    return (millis.cast("decimal(18,0)") * F.lit(_ID_RANGE)
            + (trade_id.cast("decimal(20,0)") + F.lit(_ID_OFFSET)))


def topic_order(millis: str, partition: str = "partition", offset: str = "offset") -> Column:
    """(time, topic partition, offset) as one number. Offsets of different partitions do not compare:
    the producer's time decides between partitions, and the offset between ticks of one millisecond."""
    return (F.col(millis).cast("decimal(13,0)") * F.lit(_TIME_RANGE)
            + F.col(partition).cast("decimal(6,0)") * F.lit(_PARTITION_RANGE)
            + F.col(offset).cast("decimal(19,0)")).cast("decimal(38,0)")


def arrival_order(ticks: DataFrame, time_column: str) -> Column:
    """The order in which the ticks arrived, by what the frame carries: (time, partition, offset) if it
    names the topic partition; the offset alone for a topic of one partition; else (time, trade id)."""
    if {"partition", "offset"} <= set(ticks.columns):
        return topic_order(time_column)
    if "offset" in ticks.columns:
        return F.col("offset")
    return order_key(time_column, "trade_id")


class _Ends:
    """First and last price of a window in the order of (time, trade id).

    Where the id leaves room, the time within the window and the id fit one BIGINT, which is much
    cheaper to compare than the exact decimal key. Only the other rows use that key, and a window
    that saw both kinds compares the best of each at the end.
    """

    def __init__(self, millis: str, seconds: int):
        length = seconds * 1000
        self.id_bits = 63 - (length - 1).bit_length()
        into_window = F.pmod(F.col(millis) - ALIGN_TO_EPOCH_SECONDS * 1000, F.lit(length))
        is_short = F.col("trade_id").between(0, 2 ** self.id_bits - 1)
        short = F.when(
            is_short, F.shiftleft(into_window, self.id_bits).bitwiseOR(F.col("trade_id")))
        wide = F.when(~is_short, order_key(millis, "trade_id"))
        self.aggregates = [
            F.min(short).alias("first_short"), F.min_by("price", short).alias("open_short"),
            F.max(short).alias("last_short"), F.max_by("price", short).alias("close_short"),
            F.min(wide).alias("first_wide"), F.min_by("price", wide).alias("open_wide"),
            F.max(wide).alias("last_wide"), F.max_by("price", wide).alias("close_wide")]

    def _widened(self, short: str) -> Column:
        millis = F.unix_millis("window.start") + F.shiftright(short, self.id_bits)
        trade_id = F.col(short).bitwiseAND(F.lit(2 ** self.id_bits - 1))
        return order_key(millis, trade_id)

    def columns(self) -> dict[str, Column]:
        wide_opens = F.col("first_short").isNull() | (
            F.col("first_wide") < self._widened("first_short"))
        wide_closes = F.col("last_short").isNull() | (
            F.col("last_wide") > self._widened("last_short"))
        return {
            "open": F.when(F.col("first_wide").isNotNull() & wide_opens, F.col("open_wide"))
            .otherwise(F.col("open_short")),
            "close": F.when(F.col("last_wide").isNotNull() & wide_closes, F.col("close_wide"))
            .otherwise(F.col("close_short")),
        }


def candles(ticks: DataFrame, seconds: int = 60, time_basis: str = "arrival",
            late_by: str = "10 seconds") -> DataFrame:
    """One row per symbol and window that saw a tick, labelled with the window's end.

    `time_basis` picks the clock: "arrival" (when the tick was received) or "event". Open and close
    follow that clock and the trade id, or, by arrival, the place in the topic where the frame carries
    `offset`, with `partition` if the topic has several (see `arrival_order`); frames over several
    topics have to drop both first. Only partial
    aggregates are shuffled, so a symbol with most of the ticks costs its task no more than the others.
    On a stream a window is emitted once it is `late_by` behind the newest tick.
    """
    time_column = TIME_COLUMNS[time_basis]
    timed = ticks.withColumn("ts", instant_of_millis(time_column))
    if ticks.isStreaming:
        timed = timed.withWatermark("ts", late_by)
    start = f"{ALIGN_TO_EPOCH_SECONDS % seconds} seconds"
    windows = timed.groupBy("symbol", F.window("ts", f"{seconds} seconds", startTime=start))
    totals = [F.max("price").alias("high"), F.min("price").alias("low"),
              F.sum("quantity").alias("volume"), F.count(F.lit(1)).alias("trade_count")]
    if time_basis == "arrival" and "offset" in ticks.columns:
        order = arrival_order(ticks, time_column)
        folded = windows.agg(F.min_by("price", order).alias("open"),
                             F.max_by("price", order).alias("close"), *totals)
    else:
        ends = _Ends(time_column, seconds)
        folded = windows.agg(*ends.aggregates, *totals).withColumns(ends.columns())
    return folded.withColumn("timestamp", F.col("window.end")).select(*CANDLE_COLUMNS)


def with_day(rows: DataFrame) -> DataFrame:
    """Candles with the day of their label, the partition of a candle table."""
    return rows.withColumn("day", F.to_date("timestamp"))


def line_protocol(rows: DataFrame, measurement: str = "ohlcv_1m") -> DataFrame:
    """Candles as line-protocol text, timestamps in nanoseconds."""
    fields = [F.concat(F.lit(f"{name}="), number_text(name))
              for name in ["open", "high", "low", "close", "volume"]]
    count = F.concat(F.lit("trade_count="), F.col("trade_count").cast("string"), F.lit("i"))
    return rows.select(F.concat(
        F.lit(f"{measurement},symbol="), F.col("symbol"), F.lit(" "),
        F.concat_ws(",", *fields, count), F.lit(" "),
        nanos_of_millis(F.unix_millis("timestamp")).cast("string")).alias("line"))


def summary_lines(rows: DataFrame) -> DataFrame:
    """Candles as one readable line each, for logs and consoles."""
    return rows.select("symbol", "timestamp", F.format_string(
        "%s O=%.2f H=%.2f L=%.2f C=%.2f V=%.4f trades=%d",
        "symbol", "open", "high", "low", "close", "volume", "trade_count").alias("summary"))
