"""Latest-by, newest-N and previous-value operators that hold up under hot keys."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from barlake.dimensions import broadcast_listed
from barlake.functions import percent_change
from barlake.session import run_folder, ship_library


def latest_row(df: DataFrame, key: str, order: str) -> DataFrame:
    """The whole row of the largest `order` per key, for rows of numbers and times.

    One max_by per column keeps every buffer fixed-width, which plans as hash aggregation with a
    partial step per task. `order` must not repeat within a key.
    """
    rest = [name for name in df.columns if name not in (key, order)]
    return df.groupBy(key).agg(
        *[F.max_by(name, order).alias(name) for name in rest],
        F.max(order).alias(order)).select(*df.columns)


def latest_documents(documents: DataFrame, key: str, order: str,
                     keys: Sequence[str]) -> DataFrame:
    """The newest document (`value`) of each listed key.

    The first pass reads only key and order and ends in at most one row per listed key. That side,
    broadcast while the list is short, then picks the documents, so text is neither sorted nor
    shuffled. Should an order value repeat within a key, the largest text counts.
    """
    listed = documents.filter(F.col(key).isin(list(keys)))
    newest = broadcast_listed(listed.groupBy(key).agg(F.max(order).alias(order)), keys)
    picked = listed.join(newest, [key, order], "left_semi")
    return picked.groupBy(key, order).agg(F.max("value").alias("value"))


def newest(df: DataFrame, symbol: str, order: Sequence[Column], limit: int) -> DataFrame:
    """The first `limit` rows of one symbol in the given order; the symbol in any case."""
    return df.filter(F.col("symbol") == F.upper(F.lit(symbol))).orderBy(*order).limit(limit)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int,
                shares: int | Column = 64) -> DataFrame:
    """The first `limit` rows of every key, with their place in it.

    A key is first cut to `limit` rows in each of its `shares`, so no task sorts more than a share
    of a hot key, then to `limit` rows overall. Rows are dealt to shares one by one, so copies of one
    row spread as well; which share a row is in has no influence on the result, as long as `order` is
    total but for identical rows.
    """
    count = F.lit(shares) if isinstance(shares, int) else shares
    share = F.pmod(F.xxhash64(F.monotonically_increasing_id()), count)
    salted = df.withColumn("share", share)
    by_share = Window.partitionBy(*keys, "share").orderBy(*order)
    by_key = Window.partitionBy(*keys).orderBy(*order)
    return (salted.withColumn("place", F.row_number().over(by_share))
            .filter(F.col("place") <= limit)
            .withColumn("place", F.row_number().over(by_key))
            .filter(F.col("place") <= limit)
            .drop("share"))


_ORDER_OF_BARS = ["open", "high", "low", "close", "volume", "vwap", "trade_count"]
# Whether a row is the first or the last of its task.
_FIRST, _LAST = 1, 2


def _with_row_before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The close of the row before, where it is of the same symbol; the rows are sorted."""
    held, symbol, close = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        symbols, closes = batch.column("symbol"), batch.column("close")
        above = pa.concat_arrays([pa.array([symbol], symbols.type), symbols.slice(0, len(symbols) - 1)])
        value = pa.concat_arrays([pa.array([close], closes.type), closes.slice(0, len(closes) - 1)])
        same = pc.fill_null(pc.equal(symbols, above), False)
        before = pc.if_else(same, value, pa.scalar(None, closes.type))
        edge = [0] * len(symbols)
        if held is not None:
            yield held
        else:
            edge[0] = _FIRST
        held = pa.RecordBatch.from_arrays(
            [*batch.columns, before, pa.array(edge, pa.int32())], names=[*batch.schema.names, "before", "edge"])
        symbol, close = symbols[-1].as_py(), closes[-1].as_py()
    if held is not None:
        edge = held.column("edge").to_pylist()
        edge[-1] |= _LAST
        yield held.set_column(held.schema.get_field_index("edge"), "edge", pa.array(edge, pa.int32()))


def previous_close(silver: DataFrame) -> DataFrame:
    """Close, previous bar's close and change for every bar of every symbol.

    Bars follow each other by trade date, those of one date by their values. They are sorted once, dealt
    by ranges of symbol, date and values (copies of one bar by chance), so a hot symbol is spread over
    several tasks, each of which looks at a batch of rows at a time. Only a task's first bar may follow
    one in another task: the last bar of every task, a row each, is broadcast. The sorted bars are written
    to the run folder, so that both steps see the same tasks.
    """
    spark = silver.sparkSession
    ship_library(spark)
    order = ["symbol", F.col("trade_date"), *[F.col(name).asc_nulls_last() for name in _ORDER_OF_BARS]]
    salted = silver.select("symbol", "trade_date", *_ORDER_OF_BARS,
                           F.xxhash64(F.monotonically_increasing_id()).alias("salt"))
    dealt = (salted.repartitionByRange(*order, "salt").sortWithinPartitions(*order)
             .select("symbol", "trade_date", "close", F.spark_partition_id().alias("part")))
    schema = "symbol string, trade_date date, close double, part int, before double, edge int"
    place = run_folder(spark, "previous_close")
    dealt.mapInArrow(_with_row_before, schema).write.parquet(place)
    rows = spark.read.schema(schema).parquet(place)
    by_part = Window.orderBy("part")  # a row per task
    carried = rows.filter(F.col("edge").bitwiseAND(_LAST) > 0).select(
        "part", F.lag("symbol").over(by_part).alias("last_symbol"), F.lag("close").over(by_part).alias("last_close"))
    follows = (F.col("edge").bitwiseAND(_FIRST) > 0) & (F.col("symbol") == F.col("last_symbol"))
    previous = rows.join(F.broadcast(carried), "part").withColumn(
        "prev_close", F.when(follows, F.col("last_close")).otherwise(F.col("before")))
    return previous.select(
        "symbol", "trade_date", "close", "prev_close",
        (F.col("close") - F.col("prev_close")).alias("change"),
        percent_change("close", "prev_close").alias("change_pct"))


def progress_snapshot(ticks: DataFrame, order: Column) -> DataFrame:
    """Tick count so far with the newest symbol and price, as one row."""
    return ticks.agg(
        F.count(F.lit(1)).alias("ticks"),
        F.max_by("symbol", order).alias("latest_symbol"),
        F.max_by("price", order).alias("latest_price"))
