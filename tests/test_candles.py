import random
from collections import defaultdict

import pytest

from barlake.operators import candles as c
from barlake.operators.latest import latest_row, newest
from barlake.plans import market

ALIGN_MS = 1_767_225_600_000
FIELDS = "symbol STRING, price DOUBLE, quantity DOUBLE, trade_id BIGINT, timestamp_ms BIGINT, " \
         "ingested_at_ms BIGINT, side STRING"


def tick(symbol, price, quantity, trade_id, event_ms, arrived_ms):
    return (symbol, price, quantity, trade_id, event_ms, arrived_ms, "buy")


def fold(ticks, seconds, clock):
    """Candles by brute force: sort by clock and id, then walk."""
    windows = defaultdict(list)
    for row in sorted(ticks, key=lambda row: (row[clock], row[3])):
        length = seconds * 1000
        end = ALIGN_MS + ((row[clock] - ALIGN_MS) // length + 1) * length
        windows[row[0], end].append(row)
    return sorted((symbol, rows[0][1], max(r[1] for r in rows), min(r[1] for r in rows),
                   rows[-1][1], sum(r[2] for r in rows), len(rows), end)
                  for (symbol, end), rows in windows.items())


def candle_rows(frame):
    from pyspark.sql import functions as F
    rows = frame.withColumn("timestamp", F.unix_millis("timestamp")).collect()
    return sorted(tuple(row) for row in rows)


def random_ticks(count, seed, hot=0.6, step=1):
    """Most ticks on one symbol; arrival order differs from event order; small and extreme ids."""
    rng = random.Random(seed)
    ids = {rng.randrange(-2 ** 63, 2 ** 63) if n % 2 else n for n in range(count)}
    rows = []
    for trade_id in ids:
        symbol = "HOT" if rng.random() < hot else f"S{rng.randrange(20)}"
        arrived = ALIGN_MS + rng.randrange(-400_000, 400_000) // step * step
        event = arrived - rng.randrange(0, 90_000) // step * step
        rows.append(tick(symbol, rng.randrange(1, 10_000) / 4, float(rng.randrange(1, 50)),
                         trade_id, event, arrived))
    return rows


@pytest.mark.parametrize("step", [1, 20_000])
@pytest.mark.parametrize("seconds", [1, 11, 60, 77, 3600, 86_400 * 400])
@pytest.mark.parametrize("basis, clock", [("arrival", 5), ("event", 4)])
def test_candles_equal_a_fold(spark, seconds, basis, clock, step):
    ticks = random_ticks(3000, seconds, step=step)
    frame = spark.createDataFrame(ticks, FIELDS).repartition(7)
    assert candle_rows(c.candles(frame, seconds, basis)) == fold(ticks, seconds, clock)


def test_open_and_close_follow_arrival(spark):
    ticks = [tick("A", 1.0, 1.0, 7, ALIGN_MS + 9_000, ALIGN_MS + 10_000),
             tick("A", 2.0, 1.0, 8, ALIGN_MS + 1_000, ALIGN_MS + 20_000)]
    frame = spark.createDataFrame(ticks, FIELDS)
    arrival, event = c.candles(frame).first(), c.candles(frame, time_basis="event").first()
    assert (arrival.open, arrival.close) == (1.0, 2.0)
    assert (event.open, event.close) == (2.0, 1.0)


def test_topic_offset_decides_when_there_is_one(spark):
    same_ms = [(*tick("A", 1.0, 1.0, 9, ALIGN_MS, ALIGN_MS), 1),
               (*tick("A", 2.0, 1.0, 3, ALIGN_MS, ALIGN_MS), 2)]
    frame = spark.createDataFrame(same_ms, FIELDS + ", offset BIGINT")
    row, by_event = c.candles(frame).first(), c.candles(frame, time_basis="event").first()
    assert (row.open, row.close) == (1.0, 2.0)
    assert (by_event.open, by_event.close) == (2.0, 1.0)


def test_edge_tick_opens_the_later_window_and_silence_leaves_no_row(spark):
    ticks = [tick("A", 1.0, 1.0, 1, 0, ALIGN_MS + 59_999),
             tick("A", 2.0, 1.0, 2, 0, ALIGN_MS + 60_000),
             tick("A", 3.0, 1.0, 3, 0, ALIGN_MS + 600_000)]
    rows = candle_rows(c.candles(spark.createDataFrame(ticks, FIELDS)))
    assert [(row[1], row[6], row[7] - ALIGN_MS) for row in rows] == [
        (1.0, 1, 60_000), (2.0, 1, 120_000), (3.0, 1, 660_000)]


def test_hash_aggregation_with_a_partial_step(spark):
    frame = spark.createDataFrame(random_ticks(10, 1), FIELDS)
    plan = c.candles(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and "SortAggregate" not in plan
    latest = market.latest_prices(c.candles(frame))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in latest and "Window" not in latest


def test_latest_price_per_symbol(spark):
    ticks = random_ticks(2000, 5)
    expected = {}
    for row in fold(ticks, 60, 5):
        if row[0] not in expected or row[7] > expected[row[0]][7]:
            expected[row[0]] = row
    table = c.candles(spark.createDataFrame(ticks, FIELDS))
    got = {row.symbol: (row.price, row.volume, row.trade_count)
           for row in market.latest_prices(table).collect()}
    assert got == {s: (row[4], row[5], row[6]) for s, row in expected.items()}


def test_latest_row_keeps_the_columns(spark):
    frame = spark.createDataFrame([("A", 1, 9.0), ("A", 2, 8.0), ("B", 1, 7.0)],
                                  "symbol STRING, at INT, x DOUBLE")
    got = latest_row(frame, "symbol", "at")
    assert got.columns == ["symbol", "at", "x"]
    assert sorted(tuple(row) for row in got.collect()) == [("A", 2, 8.0), ("B", 1, 7.0)]


def test_newest_candles_of_a_symbol_in_any_case(spark):
    ticks = random_ticks(2000, 6)
    table = c.candles(spark.createDataFrame(ticks, FIELDS), 60)
    own = sorted((row for row in fold(ticks, 60, 5) if row[0] == "HOT"), key=lambda row: row[7])
    got = market.symbol_candles(table, "hot", 3).collect()
    assert [row.close for row in got] == [row[4] for row in own[::-1][:3]]
    assert market.symbol_candles(table, "hot", 10_000).count() == len(own)
    assert newest(table, "nothing", [table.timestamp.desc()], 5).count() == 0


def test_line_protocol_and_summary(spark):
    ticks = [tick("A", 12.5, 1e7, 1, 0, ALIGN_MS + 1), tick("A", 0.00001, 2.0, 2, 0, ALIGN_MS + 2)]
    table = c.candles(spark.createDataFrame(ticks, FIELDS))
    assert c.line_protocol(table).first().line == (
        "ohlcv_1m,symbol=A open=12.5,high=12.5,low=1e-05,close=1e-05,volume=10000002.0,"
        f"trade_count=2i {(ALIGN_MS + 60_000) * 1_000_000}")
    assert c.summary_lines(table).first().summary == (
        "A O=12.50 H=12.50 L=0.00 C=0.00 V=10000002.0000 trades=2")


def test_candle_properties(spark):
    ticks = random_ticks(2000, 9)
    rows = c.candles(spark.createDataFrame(ticks, FIELDS), 11).collect()
    assert all(r.low <= min(r.open, r.close) and max(r.open, r.close) <= r.high for r in rows)
    assert sum(r.trade_count for r in rows) == len(ticks)
    assert len({(r.symbol, r.timestamp) for r in rows}) == len(rows)
