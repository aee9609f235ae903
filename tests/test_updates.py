"""Candle updates, the stored ledger, idempotent appends and orders over topic partitions."""

import os
import time

import pytest
from pyspark.sql import functions as F

from barlake.operators import candles as c
from barlake.operators import latest
from barlake.sources import tables
from barlake.streaming import jobs, ledger, updates
from tests.test_candles import ALIGN_MS, FIELDS, candle_rows, fold, random_ticks, tick
from tests.test_streaming import Topic

KEEP = 86_400


@pytest.fixture
def topic(spark, tmp_path):
    return Topic(spark, tmp_path)


def run_updates(topic, seconds=60, basis="event", late=10, idle=3600, keep=KEEP):
    stream = updates.candle_updates(topic.stream(), seconds, basis, late, idle, keep)
    updates.drain_updates(topic.spark, updates.update_writer(stream, topic.path("updates"), topic.path("state")))
    return topic.spark.read.schema(updates.UPDATE_DDL).parquet(topic.path("updates"))


def opened(topic, seconds=60):
    return updates.open_candles(topic.spark, topic.path("state"), seconds)


def all_candles(topic, rows, seconds=60):
    return candle_rows(updates.settled(rows).unionByName(opened(topic, seconds)))


def test_closed_and_open_candles_hold_every_tick(topic):
    ticks = random_ticks(900, 3)  # in no order, so that most windows get late ticks
    for start in range(0, 900, 180):
        topic.send(*ticks[start:start + 180])
    rows = run_updates(topic)
    assert all_candles(topic, rows) == fold(ticks, 60, 4)
    kinds = {r.kind for r in rows.select("kind").distinct().collect()}
    assert updates.CLOSED in kinds and kinds & {updates.CORRECTED, updates.LATE}


def test_a_late_tick_corrects_its_candle_also_after_restarts(topic):
    topic.send(tick("A", 1.0, 1.0, 1, ALIGN_MS + 1_000, 0), tick("A", 1.0, 1.0, 2, ALIGN_MS + 90_000, 0))
    assert [(r.kind, r.trade_count) for r in run_updates(topic).collect()] == [("closed", 1)]
    topic.send(tick("A", 5.0, 2.0, 3, ALIGN_MS + 2_000, 0))
    run_updates(topic)
    topic.send(tick("A", 0.5, 1.0, 4, ALIGN_MS + 500, 0))
    rows = run_updates(topic)
    last = rows.orderBy(F.col("revision").desc()).first()
    assert (last.kind, last.revision, last.late_ticks) == ("corrected", 2, 2)
    assert candle_rows(updates.settled(rows)) == [("A", 0.5, 5.0, 0.5, 5.0, 4.0, 3, ALIGN_MS + 60_000)]
    assert candle_rows(opened(topic)) == [("A", 1.0, 1.0, 1.0, 1.0, 1.0, 1, ALIGN_MS + 120_000)]


def test_ticks_of_windows_never_seen_or_forgotten_are_late_rows(topic):
    topic.send(tick("A", 1.0, 1.0, 1, ALIGN_MS + 600_000, 0))
    topic.send(tick("A", 3.0, 1.0, 2, ALIGN_MS + 2_000, 0))
    topic.send(tick("A", 2.0, 1.0, 3, ALIGN_MS + 1_000, 0))
    rows = run_updates(topic)
    assert sorted((r.kind, r.open) for r in rows.collect()) == [("late", 2.0), ("late", 3.0)]
    assert candle_rows(updates.settled(rows)) == [("A", 2.0, 3.0, 2.0, 3.0, 2.0, 2, ALIGN_MS + 60_000)]


def test_the_clock_closes_the_windows_of_a_silent_topic(topic):
    topic.send(tick("A", 1.0, 1.0, 1, ALIGN_MS + 1_000, 0), tick("B", 2.0, 1.0, 2, ALIGN_MS + 2_000, 0))
    stream = updates.candle_updates(topic.stream(), 60, "event", 1, 1, KEEP)
    query = updates.update_writer(stream, topic.path("updates"), topic.path("state")).trigger(
        processingTime="200 milliseconds").start()
    until = time.monotonic() + 60
    try:
        while time.monotonic() < until and topic_rows(topic) < 2:
            time.sleep(0.3)
    finally:
        query.stop()
    rows = topic.spark.read.schema(updates.UPDATE_DDL).parquet(topic.path("updates"))
    assert sorted((r.symbol, r.kind) for r in rows.collect()) == [("A", "closed"), ("B", "closed")]
    assert opened(topic).count() == 0
    # A tick for what the clock has closed corrects it.
    topic.send(tick("A", 4.0, 1.0, 3, ALIGN_MS + 3_000, 0))
    assert candle_rows(updates.settled(run_updates(topic)))[0][:7] == ("A", 1.0, 4.0, 1.0, 4.0, 2.0, 2)


def topic_rows(topic):
    if not os.path.exists(topic.path("updates")):
        return 0
    return topic.spark.read.schema(updates.UPDATE_DDL).parquet(topic.path("updates")).count()


def test_windows_must_be_kept_longer_than_they_are_open(topic):
    with pytest.raises(ValueError, match="kept"):
        updates.candle_updates(topic.stream(), 3600, keep_seconds=3600)


def test_damaged_records_do_not_reach_the_state(topic):
    topic.send("{bad", '{"symbol":"A"}', tick("A", 1.0, 1.0, None, ALIGN_MS, ALIGN_MS))
    topic.send(tick("A", 2.0, 1.0, None, ALIGN_MS, ALIGN_MS + 1), "")
    assert run_updates(topic, basis="arrival").count() == 0
    assert candle_rows(opened(topic)) == [("A", 1.0, 2.0, 1.0, 2.0, 2.0, 2, ALIGN_MS + 60_000)]


def test_a_late_tick_among_many_batches(topic):
    for n in range(30):
        topic.send(tick("A", 1.0, 1.0, n, ALIGN_MS + n * 60_000 + 1, 0))
        if n == 5:
            topic.send(tick("A", 7.0, 1.0, 100, ALIGN_MS + 2, 0))
    rows = run_updates(topic)
    assert [(r.kind, r.high) for r in rows.filter("late_ticks > 0").collect()] == [("corrected", 7.0)]
    whole = all_candles(topic, rows)
    assert len(whole) == 30 and sum(r[6] for r in whole) == 31


def test_orders_over_topic_partitions(spark):
    # Offsets of the partitions interleave: by offset alone, the first tick would be the newest.
    rows = [(0, 900, "A", 1.0, 1.0, 1, 0, ALIGN_MS + 1_000), (1, 5, "B", 2.0, 1.0, 2, 0, ALIGN_MS + 2_000),
            (0, 901, "A", 3.0, 1.0, 3, 0, ALIGN_MS + 1_500), (2, 70, "C", 4.0, 1.0, 4, 0, ALIGN_MS + 9_000),
            (1, 6, "A", 9.0, 1.0, 5, 0, ALIGN_MS + 3_000), (1, 7, "A", 8.0, 1.0, 6, 0, ALIGN_MS + 3_000)]
    ticks = spark.createDataFrame(
        rows, "partition int, offset long, symbol string, price double, quantity double, trade_id long, "
              "timestamp_ms long, ingested_at_ms long")
    snapshot = latest.progress_snapshot(ticks, c.arrival_order(ticks, "ingested_at_ms")).first()
    assert (snapshot.latest_symbol, snapshot.latest_price) == ("C", 4.0)
    by_symbol = {r[0]: r for r in candle_rows(c.candles(ticks))}
    assert by_symbol["A"][:7] == ("A", 1.0, 9.0, 1.0, 8.0, 4.0, 4)


def test_limits_of_micro_batches():
    assert jobs.archive_limits(None, files=2) == {"maxFilesPerTrigger": "2"}
    assert jobs.archive_limits(None, size="64m") == {"maxBytesPerTrigger": "64m"}
    with pytest.raises(ValueError, match="not by both"):
        jobs.archive_limits(files=1, size="1g")


def commits(topic):
    return sorted(int(n) for n in os.listdir(topic.path("state") + "/commits") if n.isdigit())


def test_a_ledger_adds_up_over_runs_and_knows_what_it_lacks(topic):
    rows = random_ticks(50, 9)
    for start in (0, 10, 20):
        topic.send(*rows[start:start + 10], "{bad")
    counted = lambda: ledger.run_counted(topic.spark, jobs.archive_writer(
        topic.stream(), topic.path("bronze"), topic.path("state")).trigger(availableNow=True), topic.path("state"))
    counted()
    topic.send(*rows[30:])
    counted()
    total = ledger.totals(topic.spark, topic.path("state")).first()
    assert (total.runs, total.ticks, total.input_rows) == (2, 50, 53)
    assert topic.spark.read.parquet(topic.path("bronze")).count() == total.ticks
    assert total.batches == len(commits(topic)) == 4
    newest = max(rows[30:], key=lambda row: (row[5], row[3]))
    assert total.latest_price == newest[1] or newest[5] == max(r[5] for r in rows[30:])
    os.remove(topic.path("state") + f"/ledger/{1:012d}.json")
    with pytest.raises(RuntimeError, match=r"lacks batches \[1\]"):
        ledger.totals(topic.spark, topic.path("state"))


def test_more_batches_than_a_query_remembers_are_in_the_ledger(topic):
    for n in range(130):
        topic.send(tick("A", 1.0, 1.0, n, ALIGN_MS + 1_000, n))
    ledger.run_counted(topic.spark, jobs.archive_writer(
        topic.stream(), topic.path("bronze"), topic.path("state")).trigger(availableNow=True), topic.path("state"))
    assert ledger.totals(topic.spark, topic.path("state")).first().ticks == 130


def test_a_batch_run_again_adds_no_rows(topic):
    rows = random_ticks(40, 5)
    topic.send(*rows[:20])
    topic.send(*rows[20:30])
    tables.ensure_table(topic.spark, "again_t", tables.batch_ddl(), tables.BATCH_PARTITIONS, topic.path("table"))
    run = lambda: jobs.drain(jobs.archive_table_writer(topic.stream(), "again_t", topic.path("state")))
    run()
    last = commits(topic)[-1]
    for name in (f"{last}", f".{last}.crc"):  # killed between append and commit
        os.remove(topic.path("state") + f"/commits/{name}")
    run()
    assert commits(topic) == [0, 1]
    topic.send(*rows[30:])
    run()
    got = topic.spark.table("again_t").drop("writer", "batch", "source", "day").collect()
    assert sorted(map(tuple, got)) == sorted(rows)
    # A query that begins anew appends its own batches.
    jobs.drain(jobs.archive_table_writer(topic.stream(), "again_t", topic.path("state2")))
    assert topic.spark.table("again_t").count() == 80


def test_repeated_ticks_can_be_left_out(topic):
    rows = random_ticks(20, 6)
    topic.send(*rows, *rows[:5])
    topic.send(*rows[:3])
    jobs.drain(jobs.archive_writer(topic.stream(), topic.path("once"), topic.path("s1"), distinct_within="1 day"))
    jobs.drain(jobs.archive_writer(topic.stream(), topic.path("all"), topic.path("s2")))
    assert topic.spark.read.parquet(topic.path("once")).count() == len({(r[0], r[3]) for r in rows})
    assert topic.spark.read.parquet(topic.path("all")).count() == 28


def test_compacted_days_are_read_once(topic):
    spark, rows = topic.spark, [("A", 1), ("B", 1), ("C", 2), ("D", 3)]
    fresh = spark.createDataFrame(rows, "symbol string, day int")
    fresh.write.partitionBy("day").parquet(topic.path("fresh"))
    tables.compact_partitions(fresh.filter("day < 3"), topic.path("done"))
    both = tables.with_compacted(spark.read.parquet(topic.path("fresh")), spark.read.parquet(topic.path("done")))
    assert sorted((r.symbol, r.day) for r in both.collect()) == rows
