"""Candles on a stream that lose no tick.

Ticks are folded to partial candles where they are read. A keyed state holds the windows of each symbol:
a window is emitted once the symbol's newest tick is late enough, or, if the symbol falls silent, by the
clock. A tick for a window that was emitted before gives a corrected candle; one for a window whose state
is gone gives a late row of its own. `settled` puts these updates together, so that every tick counts
once, also over restarts, and nothing has to be stopped because a tick came late.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from barlake.functions import instant_of_millis
from barlake.operators.candles import ALIGN_TO_EPOCH_SECONDS, TIME_COLUMNS, arrival_order, order_key
from barlake.operators.decode import CANDLE_FIELDS, decode_ticks
from barlake.schemas import CANDLE_COLUMNS
from barlake.session import settings, ship_library
from barlake.streaming.jobs import places

CLOSED, CORRECTED, LATE = "closed", "corrected", "late"

_FOLD = ("open double, high double, low double, close double, volume double, trade_count bigint, "
         "first_key decimal(38,0), last_key decimal(38,0)")
_PARTIAL = f"symbol string, start_ms bigint, {_FOLD}, newest_ms bigint"
_UPDATE = f"symbol string, end_ms bigint, kind string, revision int, late_ticks bigint, {_FOLD}"
_FOLD_NAMES = [field.split()[0] for field in _FOLD.replace("(38,0)", "").split(", ")]
UPDATE_DDL = f"symbol string, timestamp timestamp, kind string, revision int, late_ticks bigint, {_FOLD}, day date"

WINDOWS, CLOCK = "windows", "clock"


def _partial_candles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per symbol and window of a batch of ticks."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ticks = pa.Table.from_batches([batch]).sort_by("key")
        rows = pa.array(range(ticks.num_rows), pa.int64())
        folded = ticks.append_column("row", rows).group_by(["symbol", "start_ms"]).aggregate([
            ("row", "min"), ("row", "max"), ("price", "max"), ("price", "min"), ("quantity", "sum"),
            ("price", "count"), ("clock_ms", "max")])
        first, last = ticks.take(folded["row_min"]), ticks.take(folded["row_max"])
        yield from pa.table({
            "symbol": folded["symbol"], "start_ms": folded["start_ms"], "open": first["price"],
            "high": folded["price_max"], "low": folded["price_min"], "close": last["price"],
            "volume": folded["quantity_sum"], "trade_count": folded["price_count"],
            "first_key": first["key"], "last_key": last["key"],
            "newest_ms": folded["clock_ms_max"]}).to_batches()


def merged(one: tuple | None, two: tuple) -> tuple:
    """Two folds of the same window as one; their fields are those of _FOLD."""
    if one is None:
        return two
    first, last = (one if one[6] <= two[6] else two), (one if one[7] > two[7] else two)
    return (first[0], max(one[1], two[1]), min(one[2], two[2]), last[3], one[4] + two[4], one[5] + two[5],
            first[6], last[7])


class CandleKeeper(StatefulProcessor):
    """The windows of a symbol: open ones, and emitted ones that late ticks may still correct."""

    def __init__(self, length_ms: int, late_ms: int, idle_ms: int, keep_ms: int):
        if keep_ms < 2 * (length_ms + late_ms + idle_ms):
            raise ValueError("windows must be kept for twice their length, lateness and idle time")
        self.length_ms, self.late_ms, self.idle_ms, self.keep_ms = length_ms, late_ms, idle_ms, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.windows = handle.getMapState(
            WINDOWS, "start_ms bigint", f"revision int, late_ticks bigint, {_FOLD}", ttlDurationMs=self.keep_ms)
        # The symbol's newest time, its open windows and the timer that is set (0: none).
        self.clock = handle.getValueState(CLOCK, "newest_ms bigint, open array<bigint>, timer_ms bigint")

    def due(self, start_ms: int) -> int:
        """The time from which on a window is closed."""
        return start_ms + self.length_ms + self.late_ms

    def handleInputRows(self, key, rows, timerValues):
        now = timerValues.getCurrentProcessingTimeInMs()
        newest, still_open, timer = self.clock_state()
        folds: dict[int, tuple] = {}
        reached = newest
        for frame in rows:
            for start, *fold, clock in frame.drop(columns="symbol").itertuples(index=False, name=None):
                folds[start] = merged(folds.get(start), tuple(fold))
                reached = max(reached, clock)
        out = []
        for start, fold in sorted(folds.items()):
            if self.windows.containsKey((start,)):
                revision, late, *known = self.windows.getValue((start,))
                whole = merged(tuple(known), fold)
                if start not in still_open:
                    revision, late = revision + 1, late + fold[5]
                    out.append((start, CORRECTED, revision, late, whole))
                self.windows.updateValue((start,), (revision, late, *whole))
            elif self.due(start) <= newest:
                out.append((start, LATE, 0, fold[5], fold))
            else:
                still_open = [*still_open, start]
                self.windows.updateValue((start,), (0, 0, *fold))
        still_open, closed = self.close_until(still_open, reached)
        self.set_clock(reached, still_open, timer, now)
        yield self.frame(key, out + closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = max(timerValues.getCurrentProcessingTimeInMs(), expiredTimerInfo.getExpiryTimeInMs())
        newest, still_open, _ = self.clock_state()
        after, closed = self.close_until(still_open, now)
        # What the clock has closed is closed for the symbol's ticks, too.
        newest = max([newest, *(self.due(start) for start in still_open if start not in after)])
        self.set_clock(newest, after, 0, now)
        yield self.frame(key, closed)

    def clock_state(self) -> tuple[int, list[int], int]:
        newest, still_open, timer = self.clock.get() if self.clock.exists() else (0, [], 0)
        return newest, list(still_open), timer

    def close_until(self, still_open: list[int], time_ms: int) -> tuple[list[int], list[tuple]]:
        closed = []
        for start in sorted(start for start in still_open if self.due(start) <= time_ms):
            revision, late, *fold = self.windows.getValue((start,))
            self.windows.updateValue((start,), (revision, late, *fold))  # kept from now on for keep_ms
            closed.append((start, CLOSED, revision, late, tuple(fold)))
        return [start for start in still_open if self.due(start) > time_ms], closed

    def set_clock(self, newest: int, still_open: list[int], timer: int, now: int) -> None:
        if timer:
            self.handle.deleteTimer(timer)
        timer = min((max(self.due(start), now + self.idle_ms) for start in still_open), default=0)
        if timer:
            self.handle.registerTimer(timer)
        self.clock.update((newest, still_open, timer))

    def frame(self, key, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(
            [(key[0], start + self.length_ms, kind, revision, late, *fold) for start, kind, revision, late, fold in rows],
            columns=["symbol", "end_ms", "kind", "revision", "late_ticks", *_FOLD_NAMES])

    def close(self) -> None:
        pass


def candle_updates(records: DataFrame, seconds: int = 60, time_basis: str = "arrival", late_seconds: float = 10,
                   idle_seconds: float = 10, keep_seconds: float = 86_400) -> DataFrame:
    """Candles of the topic, and what late ticks change about them.

    A window is `closed` once its symbol has a tick `late_seconds` past its end, or, without further
    ticks, `idle_seconds` after the symbol's last one, but not before `late_seconds` past its end by the
    clock. A tick that comes afterwards gives a `corrected` candle with the next revision, as long as the
    window was touched in the last `keep_seconds`; after that, a `late` row with those ticks alone.

    Partial candles are what is shuffled, so the symbol with most of the ticks costs its task a row per
    window and batch of ticks read. The state holds the windows of the last `keep_seconds`.
    """
    ship_library(records.sparkSession)
    clock = TIME_COLUMNS[time_basis]
    ticks, _ = decode_ticks(records, required=[*CANDLE_FIELDS, clock], keep=places(records))
    ticks = ticks.withColumn("trade_id", F.coalesce("trade_id", F.lit(0)))  # only breaks ties
    order = arrival_order(ticks, clock) if time_basis == "arrival" else order_key(clock, "trade_id")
    length = seconds * 1000
    into = F.pmod(F.col(clock) - ALIGN_TO_EPOCH_SECONDS * 1000, F.lit(length))
    partials = ticks.select(
        "symbol", (F.col(clock) - into).alias("start_ms"), "price", "quantity",
        order.cast("decimal(38,0)").alias("key"), F.col(clock).alias("clock_ms")).mapInArrow(
        _partial_candles, _PARTIAL)
    keeper = CandleKeeper(length, round(late_seconds * 1000), round(idle_seconds * 1000), round(keep_seconds * 1000))
    updates = partials.groupBy("symbol").transformWithStateInPandas(keeper, _UPDATE, "Append", "ProcessingTime")
    stamped = updates.withColumn("timestamp", instant_of_millis("end_ms"))
    return stamped.select("symbol", "timestamp", "kind", "revision", "late_ticks", *_FOLD_NAMES)


def update_writer(updates: DataFrame, path: str, checkpoint: str, format: str = "parquet") -> DataStreamWriter:
    """Updates appended to a table partitioned by the day of their label."""
    return (updates.withColumn("day", F.to_date("timestamp")).writeStream.format(format)
            .option("path", path).option("checkpointLocation", checkpoint)
            .partitionBy("day").outputMode("append"))


def _folded(rows: DataFrame) -> DataFrame:
    """Folds of one symbol and window as one."""
    return rows.groupBy("symbol", "timestamp").agg(
        F.min_by("open", "first_key").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "last_key").alias("close"), F.sum("volume").alias("volume"),
        F.sum("trade_count").alias("trade_count"))


def settled(updates: DataFrame) -> DataFrame:
    """The candles that a table of updates amounts to: the last revision of each, with its late rows."""
    whole = updates.filter(F.col("kind") != LATE)
    last = whole.groupBy("symbol", "timestamp").agg(
        *[F.max_by(name, "revision").alias(name) for name in _FOLD_NAMES])
    late = updates.filter(F.col("kind") == LATE).select(*last.columns)
    return _folded(last.unionByName(late)).select(*CANDLE_COLUMNS)


def open_candles(spark: SparkSession, checkpoint: str, seconds: int = 60) -> DataFrame:
    """The windows a stopped query of updates has left open, as candles so far, read from its state."""
    def state(name: str) -> DataFrame:
        return (spark.read.format("statestore").option("stateVarName", name).load(checkpoint))

    opened = state(CLOCK).select(F.col("key.symbol").alias("symbol"), F.explode("value.open").alias("start_ms"))
    held = state(WINDOWS)
    value = F.col("user_map_value.value") if "value" in held.schema["user_map_value"].dataType.names else (
        F.col("user_map_value"))
    folds = held.select(F.col("key.symbol").alias("symbol"), F.col("user_map_key.start_ms").alias("start_ms"),
                        value.alias("fold"))
    return folds.join(opened, ["symbol", "start_ms"], "left_semi").select(
        "symbol", *[F.col(f"fold.{name}").alias(name) for name in CANDLE_COLUMNS[1:-1]],
        instant_of_millis(F.col("start_ms") + seconds * 1000).alias("timestamp"))


def drain_updates(spark: SparkSession, writer: DataStreamWriter, partitions: int | None = None) -> StreamingQuery:
    """Process everything that is there, commit and stop. Windows that neither ticks nor the clock have
    closed stay open in the checkpoint: `open_candles` lists them, and the next run goes on from there.

    Timers would have Spark run batches without input for ever, so a drain has none of those; a timer that
    is due fires in a batch with input, or in the next run. `partitions` is how many parts the state has,
    which the first run of a checkpoint decides.
    """
    wanted = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    if partitions is not None:
        wanted["spark.sql.shuffle.partitions"] = str(partitions)
    with settings(spark, wanted):  # a query takes the settings it is started with
        query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query
