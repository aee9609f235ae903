import json
import os

import pytest
from pyspark.sql import functions as F

from barlake.operators import candles as c
from barlake.operators.decode import decode_ticks
from barlake.schemas import BRONZE_TICK_DDL
from barlake.sources import topics
from barlake.streaming import jobs
from tests.test_candles import ALIGN_MS, FIELDS, candle_rows, fold, random_ticks, tick

CANDLE_DDL = ("symbol STRING, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, "
              "trade_count BIGINT, timestamp TIMESTAMP")


class Topic:
    """A topic of message files, one per micro-batch."""

    def __init__(self, spark, root):
        self.spark, self.root, self.files = spark, root, 0
        (root / "topic").mkdir()

    def send(self, *values):
        lines = [v if isinstance(v, str) else json.dumps(dict(zip(
            [f.split()[0] for f in FIELDS.split(", ")], v))) for v in values]
        hidden = self.root / f"{self.files:04d}.tmp"
        hidden.write_text("\n".join(lines) + "\n")
        # Files are taken in the order of their modification times, which would tie here.
        os.utime(hidden, (1_700_000_000 + self.files,) * 2)
        hidden.rename(self.root / "topic" / f"{self.files:04d}.txt")
        self.files += 1

    def stream(self):
        return topics.read_topic_stream(
            self.spark, "text", {"path": str(self.root / "topic"), "maxFilesPerTrigger": "1"})

    def path(self, name):
        return str(self.root / name)


@pytest.fixture
def topic(spark, tmp_path):
    return Topic(spark, tmp_path)


def run_candles(topic, seconds=60, basis="arrival", late_by="10 seconds"):
    closed = jobs.candle_stream(topic.stream(), seconds, basis, late_by)
    query = jobs.drain(jobs.candle_writer(closed, topic.path("candles"), topic.path("state")))
    return query, topic.spark.read.schema(CANDLE_DDL).parquet(topic.path("candles")).drop("day")


def test_streamed_candles_equal_batch_but_for_open_windows(topic):
    ticks = sorted(random_ticks(900, 3), key=lambda row: row[5])
    for start in range(0, 900, 300):
        topic.send(*ticks[start:start + 300])
    _, rows = run_candles(topic)
    watermark = max(row[5] for row in ticks) - 10_000
    closed = [row for row in fold(ticks, 60, 5) if row[7] <= watermark]
    assert candle_rows(rows) == closed
    assert 0 < len(closed) < len(fold(ticks, 60, 5))


def test_later_messages_close_open_windows_after_a_restart(topic):
    topic.send(tick("A", 1.0, 1.0, 1, 0, ALIGN_MS + 1_000))
    assert run_candles(topic)[1].count() == 0
    topic.send(tick("A", 3.0, 2.0, 2, 0, ALIGN_MS + 30_000))
    topic.send(tick("B", 9.0, 1.0, 3, 0, ALIGN_MS + 71_000))
    _, rows = run_candles(topic)
    assert candle_rows(rows) == [("A", 1.0, 3.0, 1.0, 3.0, 3.0, 2, ALIGN_MS + 60_000)]
    topic.send(tick("B", 9.0, 1.0, 4, 0, ALIGN_MS + 900_000))
    assert run_candles(topic)[1].count() == 2


def test_ticks_behind_the_watermark_are_dropped_and_counted(topic):
    topic.send(tick("A", 1.0, 1.0, 1, ALIGN_MS + 1_000, 0))
    topic.send(tick("A", 1.0, 1.0, 2, ALIGN_MS + 300_000, 0))
    topic.send(tick("A", 1.0, 1.0, 3, ALIGN_MS + 310_000, 0))
    topic.send(tick("A", 5.0, 1.0, 4, ALIGN_MS + 2_000, 0),
               tick("A", 1.0, 1.0, 5, ALIGN_MS + 600_000, 0))
    query, rows = run_candles(topic, basis="event")
    assert [(row[2], row[6]) for row in candle_rows(rows)] == [(1.0, 1), (1.0, 2)]
    assert query.totals()["late_rows"] == 1
    with pytest.raises(RuntimeError, match="1 partial rows"):
        jobs.drain_candles(jobs.candle_writer(
            jobs.candle_stream(topic.stream(), 60, "event"),
            topic.path("candles2"), topic.path("state2")))


def test_totals_cover_more_batches_than_a_query_remembers(topic):
    rows = [tick("A", 1.0, 1.0, n, ALIGN_MS + 1_000, n) for n in range(160)]
    for row in rows:
        topic.send(row)
    told = []
    query = jobs.archive_writer(topic.stream(), topic.path("bronze"), topic.path("state")).trigger(
        availableNow=True).start()
    totals = jobs.follow(query, 0.05, told.append, report_seconds=0.5).totals()
    assert totals["ticks"] == totals["input_rows"] == 160
    assert topic.spark.read.parquet(topic.path("bronze")).count() == 160
    assert told and told[0]["ticks"] <= told[-1]["ticks"] <= 160


def test_an_early_late_tick_fails_a_long_drain(topic):
    topic.send(tick("A", 1.0, 1.0, 0, ALIGN_MS + 300_000, 0))
    topic.send(tick("A", 1.0, 1.0, 1, ALIGN_MS + 301_000, 0))
    topic.send(tick("A", 1.0, 1.0, 2, ALIGN_MS + 2_000, 0), tick("A", 1.0, 1.0, 3, ALIGN_MS + 302_000, 0))
    for n in range(4, 40):
        topic.send(tick("A", 1.0, 1.0, n, ALIGN_MS + 300_000 + n, 0))
    closed = jobs.candle_stream(topic.stream(), 60, "event")
    with pytest.raises(RuntimeError, match="after their window was emitted"):
        jobs.drain_candles(jobs.candle_writer(closed, topic.path("candles"), topic.path("state")))
    with pytest.raises(RuntimeError, match="after their window was emitted"):
        jobs.run_candles(jobs.candle_writer(closed, topic.path("candles2"), topic.path("state2")))


def test_a_ledger_with_a_gap_does_not_add_up():
    ledger = jobs.RunLedger()
    ledger.batches = {3: (1, 1, 0), 5: (1, 1, 0)}
    with pytest.raises(RuntimeError, match="1 batches were not seen"):
        ledger.totals()


def test_archive_and_quarantine_split_the_topic(topic):
    ticks = random_ticks(50, 4)
    topic.send(*ticks[:25], "{bad", '{"symbol":"A"}')
    topic.send(*ticks[25:], ticks[0])
    query = jobs.drain(jobs.archive_writer(
        topic.stream(), topic.path("bronze"), topic.path("state1")))
    jobs.drain(jobs.quarantine_writer(topic.stream(), topic.path("bad"), topic.path("state2")))
    bronze = topic.spark.read.schema(BRONZE_TICK_DDL).parquet(topic.path("bronze"))
    assert sorted(tuple(row)[:7] for row in bronze.collect()) == sorted([*ticks, ticks[0]])
    assert {(row.source, str(row.day)) for row in bronze.collect()} <= {
        ("binance", "2025-12-31"), ("binance", "2026-01-01")}
    bad = topic.spark.read.schema("value STRING, reason STRING").parquet(topic.path("bad"))
    assert sorted(row.value for row in bad.collect()) == ['{"symbol":"A"}', "{bad"]
    totals = query.totals()
    newest = max(ticks, key=lambda row: (row[5], row[3]))
    assert totals["ticks"] == 51 and totals["input_rows"] == 53
    assert totals["latest_symbol"] in {row[0] for row in ticks}
    assert newest[1] in {row[1] for row in ticks}


def test_restarted_archive_appends_each_message_once(topic):
    ticks = random_ticks(20, 8)
    topic.send(*ticks[:10])
    for _ in range(2):
        jobs.drain(jobs.archive_writer(topic.stream(), topic.path("bronze"), topic.path("state")))
    topic.send(*ticks[10:])
    jobs.drain(jobs.archive_writer(topic.stream(), topic.path("bronze"), topic.path("state")))
    bronze = topic.spark.read.schema(BRONZE_TICK_DDL).parquet(topic.path("bronze"))
    assert sorted(tuple(row)[:7] for row in bronze.collect()) == sorted(ticks)


def test_strict_archive_stops_on_a_bad_message(topic):
    topic.send("{bad")
    with pytest.raises(Exception, match="row breaks"):
        jobs.drain(jobs.archive_writer(
            topic.stream(), topic.path("bronze"), topic.path("state"), strict=True))


def test_published_ticks_reach_both_readers(topic):
    envelopes = [json.dumps({"data": {"e": "trade", "s": s, "p": "2.5", "q": "1", "t": n,
                                      "T": ALIGN_MS, "m": False}})
                 for n, s in enumerate(["A", "B", "A"])]
    topic.send(*envelopes)
    jobs.drain(jobs.publish_writer(topic.stream(), "parquet", {"path": topic.path("records")},
                                   topic.path("state"), symbols=["A", "B"]))
    records = topics.read_topic(topic.spark, "parquet", {"path": topic.path("records")},
                                "key STRING, value STRING")
    assert sorted(row.key for row in records.collect()) == ["A", "A", "B"]
    ticks, rejected = decode_ticks(records)
    assert rejected.count() == 0 and c.candles(ticks).agg(F.sum("trade_count")).first()[0] == 3


def test_only_subscribed_symbols_are_published_by_default(topic):
    envelopes = [json.dumps({"data": {"e": "trade", "s": s, "p": "2.5", "q": "1", "t": n,
                                      "T": ALIGN_MS, "m": False}})
                 for n, s in enumerate(["BTCUSDT", "OTHER"])]
    topic.send(*envelopes)
    jobs.drain(jobs.publish_writer(topic.stream(), "parquet", {"path": topic.path("records")},
                                   topic.path("state")))
    assert [row.key for row in topic.spark.read.parquet(topic.path("records")).collect()] == ["BTCUSDT"]


def test_batch_publish_and_options(topic):
    records = topic.spark.createDataFrame([("A", "{}")], "key STRING, value STRING")
    topics.write_topic(records, "parquet", {"path": topic.path("out")})
    topics.write_topic(records, "parquet", {"path": topic.path("out")})
    assert topic.spark.read.parquet(topic.path("out")).count() == 2
    assert topics.kafka_options("h:9092", "t")["startingOffsets"] == "earliest"
    assert jobs.archive_limits() == {"maxOffsetsPerTrigger": "500"}


def test_line_protocol_and_console_sinks(topic):
    topic.send(tick("A", 1.5, 2.0, 1, 0, ALIGN_MS + 1),
               tick("A", 1.5, 2.0, 2, 0, ALIGN_MS + 90_000))
    closed = jobs.candle_stream(topic.stream())
    jobs.drain(jobs.line_protocol_writer(closed, topic.path("ilp"), topic.path("state1")))
    lines = [row.value for row in topic.spark.read.text(topic.path("ilp")).collect()]
    assert lines == ["ohlcv_1m,symbol=A open=1.5,high=1.5,low=1.5,close=1.5,volume=2.0,"
                     f"trade_count=1i {(ALIGN_MS + 60_000) * 1_000_000}"]
    query = jobs.console_writer(jobs.candle_stream(topic.stream())).trigger(availableNow=True).start()
    jobs.follow(query)
    assert all("Console" in progress.sink.description for progress in query.recentProgress)
    assert sum(progress.sink.numOutputRows for progress in query.recentProgress) == 1
