"""One query per operator or job, over the shared test tables.

Dates and times leave a query as text, as the reports show them; tables keep native types.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from barlake import adapters
from barlake.adapters import table, table_stream
from barlake.dimensions import FOREX_TICKERS, MACRO_SERIES
from barlake.operators import bars, boards, candles, decode, latest
from barlake.plans import market
from barlake.schemas import BRONZE_TICK_DDL, CANDLE_COLUMNS, TICK
from barlake.session import configure, file_names, run_folder
from barlake.sources.files import (
    read_bar_documents_checked, read_bars, read_documents, write_documents, write_lines,
)
from barlake.sources.tables import BATCH_PARTITIONS, append_rows, batch_ddl, ensure_table
from barlake.streaming import jobs, ledger, updates

CANDLE_DDL = ("symbol STRING, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, "
              "trade_count BIGINT, timestamp TIMESTAMP")


def as_text(df: DataFrame) -> DataFrame:
    """The same rows with dates and times as text."""
    return df.select(*[
        F.col(name).cast("string").alias(name) if kind in ("date", "timestamp") else F.col(name)
        for name, kind in df.dtypes])


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(configure(spark), folder, "events")


def lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return table(configure(spark), folder, "lineitem")


def supplier(spark: SparkSession, folder: str) -> DataFrame:
    return table(configure(spark), folder, "supplier")


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    return adapters.ticks_of(events(spark, folder))


def bronze(spark: SparkSession, folder: str) -> DataFrame:
    return adapters.bars_of(lineitem(spark, folder))


def silver(spark: SparkSession, folder: str) -> DataFrame:
    return bars.silver_bars(bronze(spark, folder))


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    return candles.candles(ticks(spark, folder), 3600)


def record_stream(spark: SparkSession, folder: str) -> DataFrame:
    return adapters.records_of(table_stream(configure(spark), folder, "events"))


# Ticks

def decode_ticks(spark, folder):
    envelopes = adapters.envelopes_of(events(spark, folder))
    accepted, _ = decode.decode_trades(envelopes, F.col("seq") + 1_000, keep=["seq"])
    return accepted


def rejected_envelopes(spark, folder):
    envelopes = adapters.envelopes_of(events(spark, folder))
    return decode.decode_trades(envelopes, F.col("seq"), keep=["seq"])[1].select("seq", "reason")


def subscribed_ticks(spark, folder):
    envelopes = adapters.envelopes_of(events(spark, folder))
    accepted, _ = decode.decode_trades(
        envelopes, F.col("seq") + 1_000, symbols=["CLICK", "VIEW"], keep=["seq"])
    return accepted


def topic_records(spark, folder):
    """Ticks rendered as key and JSON value, read back from the JSON."""
    records = decode.encode_ticks(ticks(spark, folder))
    text = F.encode("value", "UTF-8")
    accepted, _ = decode.decode_ticks(records.withColumn("value", text), keep=["key"], strict=True)
    return accepted


def bronze_ticks(spark, folder):
    accepted, _ = decode.decode_ticks(adapters.records_of(events(spark, folder)))
    return as_text(decode.archive_rows(accepted))


def rejected_ticks(spark, folder):
    records = adapters.records_of(events(spark, folder))
    return decode.decode_ticks(records, keep=["offset"])[1].select("offset", "reason")


def bronze_table(spark, folder):
    """Bronze ticks appended to a table that is created on the first run."""
    place = run_folder(configure(spark), "bronze_table")
    name = "bronze_ticks_" + place.rpartition("-")[2]
    ensure_table(spark, name, BRONZE_TICK_DDL, ["day"], place)
    ensure_table(spark, name, BRONZE_TICK_DDL, ["day"], place)
    accepted, _ = decode.decode_ticks(adapters.records_of(events(spark, folder)))
    append_rows(decode.archive_rows(accepted), name)
    return as_text(spark.table(name))


def progress_snapshot(spark, folder):
    rows = ticks(spark, folder)
    return latest.progress_snapshot(rows, candles.arrival_order(rows, "ingested_at_ms"))


# Candles

def ohlcv_1m(spark, folder):
    return as_text(candles.candles(ticks(spark, folder)))


def ohlcv_1h(spark, folder):
    return as_text(hourly(spark, folder))


def ohlcv_1m_event_time(spark, folder):
    return as_text(candles.candles(ticks(spark, folder), time_basis="event"))


def ohlcv_aligned_77s(spark, folder):
    return as_text(candles.candles(ticks(spark, folder), 77))


def latest_candle(spark, folder):
    return market.latest_prices(hourly(spark, folder))


def candles_for_symbol(spark, folder):
    return market.symbol_candles(hourly(spark, folder), "click")


def candle_table(spark, folder):
    """Hourly candles stored by day, as the candle stream leaves them, and read back."""
    place = run_folder(configure(spark), "candle_table")
    candles.with_day(hourly(spark, folder)).hint("rebalance", "day").write.partitionBy("day").parquet(place)
    return spark.read.schema(f"{CANDLE_DDL}, day DATE").parquet(place)


def stored_candles(spark, folder):
    return as_text(candle_table(spark, folder).select(*CANDLE_COLUMNS))


def stored_latest_candle(spark, folder):
    return market.latest_prices(candle_table(spark, folder).drop("day"))


def stored_candles_for_symbol(spark, folder):
    return market.symbol_candles(candle_table(spark, folder), "click")


def ilp_lines(spark, folder):
    """Line protocol, written to text files and read back."""
    place = run_folder(configure(spark), "ilp_lines")
    write_lines(candles.line_protocol(hourly(spark, folder)), place)
    return spark.read.text(place).withColumnRenamed("value", "line")


def candle_summaries(spark, folder):
    return as_text(candles.summary_lines(hourly(spark, folder)))


# Daily bars

def bar_documents(spark, folder):
    documents = bars.parse_bar_documents(adapters.bar_documents_of(lineitem(spark, folder)))
    return bars.bars_from_documents(documents, F.col("bar.t") + 1)[0]


def rejected_document_bars(spark, folder):
    documents = bars.parse_bar_documents(adapters.bar_documents_of(lineitem(spark, folder)))
    rejected = bars.bars_from_documents(documents)[1]
    return rejected.select("symbol", F.col("bar.t").alias("timestamp_ms"), "reason")


def landed_bars(spark, folder):
    """Documents of the universe written as JSON lines, read back as bronze bars."""
    place = run_folder(configure(spark), "landed_bars")
    documents = adapters.bar_documents_of(lineitem(spark, folder))
    universe = adapters.universe_of(supplier(spark, folder).filter(F.col("s_nationkey") < 10))
    market.land_bars(documents, universe, place, F.col("bar.t") + 1)
    return read_bars(spark, place)


def landed_documents(spark, folder, job):
    """The response of the first line of every supplier, one file each; every fifth is cut short."""
    place = run_folder(configure(spark), job)
    first = lineitem(spark, folder).groupBy("l_suppkey").agg(
        F.min_by(F.struct("*"), F.struct("l_orderkey", "l_linenumber")).alias("line")).select("line.*")
    documents = adapters.bar_documents_of(first)
    number = F.regexp_extract("symbol", "[0-9]+", 0).cast("bigint")
    value = F.when(number % 5 == 2, F.substring("value", 1, 12)).otherwise(F.col("value"))
    write_documents(documents.withColumn("value", value), place, "symbol")
    return place


def landed_document_bars(spark, folder):
    """Bars of landed response files, one per symbol; files that are no JSON are left out."""
    place = landed_documents(spark, folder, "landed_document_bars")
    documents, _ = read_bar_documents_checked(spark, place, "symbol")
    return bars.bars_from_documents(documents, F.col("bar.t") + 1)[0]


def rejected_document_files(spark, folder):
    """The landed response files that are no JSON."""
    place = landed_documents(spark, folder, "rejected_document_files")
    rejected = read_bar_documents_checked(spark, place, "symbol")[1]
    return rejected.select("symbol", F.rtrim("malformed", F.lit("\n")).alias("malformed"))


def landing_report(spark, folder):
    """Bars written by a landing run and the listed symbols that had none."""
    place = run_folder(configure(spark), "landing_report")
    documents = adapters.bar_documents_of(lineitem(spark, folder))
    universe = adapters.listed_universe_of(supplier(spark, folder))
    rows, missing = market.land_bars(documents, universe, place, F.col("bar.t") + 1)
    return missing.select("symbol", F.lit(rows).cast("bigint").alias("bars_written"))


def silver_bars(spark, folder):
    return as_text(silver(spark, folder).drop("processed_at"))


def silver_table(spark, folder):
    """Silver as a catalog table: built under another name, then swapped in."""
    place = run_folder(configure(spark), "silver_table")
    name = "silver_bars_" + place.rpartition("-")[2]
    market.refresh_silver(bronze(spark, folder), name, place)
    return as_text(spark.table(name).drop("processed_at"))


def rejected_bars(spark, folder):
    return bars.rejected_bars(bronze(spark, folder)).drop("ingested_at_ms", "source", "adjusted")


def bars_for_symbol(spark, folder):
    return market.symbol_bars(silver(spark, folder), "s7")


def symbols(spark, folder):
    return market.symbol_list(silver(spark, folder))


def universe_bars(spark, folder):
    universe = adapters.universe_of(supplier(spark, folder).filter(F.col("s_nationkey") < 10))
    return bars.in_universe(bronze(spark, folder), universe).drop("ingested_at_ms")


def missing_symbols(spark, folder):
    universe = adapters.listed_universe_of(supplier(spark, folder))
    return bars.missing_symbols(universe, bronze(spark, folder))


def bars_capped(spark, folder):
    return bars.capped_history(bronze(spark, folder), "1996-01-01", "2001-12-31", 300)


def bars_default_cap(spark, folder):
    """The capped history with the default cap."""
    return bars.capped_history(bronze(spark, folder), "1992-01-01")


def sample_bars(spark, folder):
    return market.sample_bars(bronze(spark, folder))


def prev_close_change(spark, folder):
    return as_text(latest.previous_close(silver(spark, folder)))


# Boards

def macro_pulse(spark, folder):
    return market.macro_pulse(adapters.observation_documents_of(events(spark, folder)))


def series_history(spark, folder):
    rows = boards.observations(adapters.observation_documents_of(events(spark, folder)))
    return boards.newest_observations(rows, 5)


def index_board(spark, folder):
    return market.index_board(adapters.index_documents_of(events(spark, folder)))


def forex_board(spark, folder):
    return market.forex_board(adapters.forex_documents_of(events(spark, folder)))


def commodity_board(spark, folder):
    return market.commodity_board(adapters.commodity_documents_of(events(spark, folder)))


def landed_forex_board(spark, folder):
    """The newest quote documents as landed files, read back for the board."""
    place = run_folder(configure(spark), "landed_forex_board")
    documents = adapters.forex_documents_of(events(spark, folder))
    keys = [ticker for _, ticker in FOREX_TICKERS]
    write_documents(latest.latest_documents(documents, "ticker", "seq", keys), place, "ticker")
    return market.forex_board(read_documents(spark, place, "ticker"))


def landed_macro_pulse(spark, folder):
    """The newest document of every series as landed files, read back for the report."""
    place = run_folder(configure(spark), "landed_macro_pulse")
    documents = adapters.observation_documents_of(events(spark, folder))
    keys = [series_id for _, series_id, _ in MACRO_SERIES]
    write_documents(latest.latest_documents(documents, "series_id", "seq", keys), place, "series_id")
    return market.macro_pulse(read_documents(spark, place, "series_id"))


def quote_changes(spark, folder):
    documents = adapters.forex_documents_of(events(spark, folder))
    return boards.quote_changes(documents).drop("value")


def index_changes(spark, folder):
    documents = adapters.index_documents_of(events(spark, folder))
    return boards.index_changes(documents).drop("value")


# Streams: each run drains everything there is into files of its own, then reads them.

def stream_bronze(spark, folder):
    place = run_folder(configure(spark), "stream_bronze")
    jobs.drain(jobs.archive_writer(
        record_stream(spark, folder), f"{place}/rows", f"{place}/checkpoint"))
    return as_text(spark.read.schema(BRONZE_TICK_DDL).parquet(f"{place}/rows"))


def stream_rejected(spark, folder):
    place = run_folder(configure(spark), "stream_rejected")
    jobs.drain(jobs.quarantine_writer(
        record_stream(spark, folder), f"{place}/rows", f"{place}/checkpoint"))
    return spark.read.schema("value STRING, reason STRING").parquet(f"{place}/rows").select(
        "reason", F.regexp_extract("value", '"trade_id":([0-9]+)', 1).cast("bigint").alias("seq"))


def stream_candles(spark, folder):
    place = run_folder(configure(spark), "stream_candles")
    closed = jobs.candle_stream(record_stream(spark, folder))
    jobs.drain_candles(jobs.candle_writer(closed, f"{place}/rows", f"{place}/checkpoint"))
    return as_text(spark.read.schema(CANDLE_DDL).parquet(f"{place}/rows").select(*CANDLE_COLUMNS))


def stream_ilp_lines(spark, folder):
    place = run_folder(configure(spark), "stream_ilp_lines")
    closed = jobs.candle_stream(record_stream(spark, folder), 3600)
    jobs.drain_candles(jobs.line_protocol_writer(closed, f"{place}/rows", f"{place}/checkpoint"))
    return spark.read.text(f"{place}/rows").withColumnRenamed("value", "line")


def stream_published(spark, folder):
    """Envelopes decoded and published to a topic of landed JSON records, then read back."""
    place = run_folder(configure(spark), "stream_published")
    envelopes = adapters.envelopes_of(table_stream(spark, folder, "events"))
    jobs.drain(jobs.publish_writer(
        envelopes, "parquet", {"path": f"{place}/rows"}, f"{place}/checkpoint", symbols=None))
    records = spark.read.schema("key STRING, value STRING").parquet(f"{place}/rows")
    accepted, _ = decode.decode_ticks(records, keep=["key"])
    return accepted.select("key", *[c for c in TICK.fieldNames() if c != "ingested_at_ms"])


def stream_totals(spark, folder):
    """Counters of an archive run, taken from the progress of the query."""
    place = run_folder(configure(spark), "stream_totals")
    totals = jobs.drain(jobs.archive_writer(
        record_stream(spark, folder), f"{place}/rows", f"{place}/checkpoint")).totals()
    return spark.createDataFrame(
        [(totals["ticks"], totals["latest_symbol"], totals["latest_price"])],
        "ticks BIGINT, latest_symbol STRING, latest_price DOUBLE")


# Streams over a topic of several files, a micro-batch each. Events are dealt to the files by their number,
# so that every file spans the whole time and most ticks come after later ones.

TOPIC_FILES = 7


def send(spark, folder, place, files):
    """Write some of the topic's files."""
    number = F.col("event_id") % TOPIC_FILES
    dealt = events(spark, folder).filter(number.isin(list(files)))
    records = adapters.records_of(dealt).withColumn("file", F.col("offset") % TOPIC_FILES)
    records.repartition("file").write.mode("append").partitionBy("file").parquet(f"{place}/topic")


def topic_stream(spark, place):
    reader = spark.readStream.schema("offset BIGINT, value STRING").options(**jobs.archive_limits(None, files=1))
    return reader.parquet(f"{place}/topic/file=*")


def updates_run(spark, folder, job):
    """Hourly candles of the topic as updates, over two runs of one checkpoint."""
    place = run_folder(configure(spark), job)
    for files in (range(4), range(4, TOPIC_FILES)):
        send(spark, folder, place, files)
        stream = updates.candle_updates(topic_stream(spark, place), 3600, idle_seconds=3600)
        writer = updates.update_writer(stream, f"{place}/rows", f"{place}/checkpoint")
        updates.drain_updates(spark, writer, partitions=8)
    return place


def stream_settled_candles(spark, folder):
    """Every tick in its candle, however late: closed windows with their corrections, and open ones."""
    place = updates_run(spark, folder, "stream_settled_candles")
    rows = spark.read.schema(updates.UPDATE_DDL).parquet(f"{place}/rows")
    return as_text(updates.settled(rows).unionByName(
        updates.open_candles(spark, f"{place}/checkpoint", 3600)))


def stream_open_candles(spark, folder):
    """The windows a drained stream has left open, read from its state."""
    place = updates_run(spark, folder, "stream_open_candles")
    return as_text(updates.open_candles(spark, f"{place}/checkpoint", 3600))


def stream_ledger(spark, folder):
    """Counters over two runs of one checkpoint, with the number of micro-batches."""
    place = run_folder(configure(spark), "stream_ledger")
    checkpoint = f"{place}/checkpoint"
    for files in (range(4), range(4, TOPIC_FILES)):
        send(spark, folder, place, files)
        ledger.run_counted(spark, jobs.archive_writer(
            topic_stream(spark, place), f"{place}/rows", checkpoint).trigger(availableNow=True), checkpoint)
    return ledger.totals(spark, checkpoint).select("batches", "runs", "ticks", "input_rows", "late_rows")


def stream_table(spark, folder):
    """Bronze ticks appended to a catalog table; the last batch is run twice, as after a failure."""
    place = run_folder(configure(spark), "stream_table")
    name = "stream_table_" + place.rpartition("-")[2]
    ensure_table(spark, name, batch_ddl(), BATCH_PARTITIONS, f"{place}/rows")
    send(spark, folder, place, range(TOPIC_FILES))
    checkpoint = f"{place}/checkpoint"
    for _ in range(2):
        jobs.drain(jobs.archive_table_writer(topic_stream(spark, place), name, checkpoint))
        forget_commit(spark, checkpoint)
    return as_text(spark.table(name).drop("writer", "batch"))


def forget_commit(spark, checkpoint):
    """Take back the commit of the last batch: the next run has to do it again."""
    last = max(int(commit) for commit in file_names(spark, f"{checkpoint}/commits") if commit.isdigit())
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits/{last}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query for query in [
        decode_ticks, rejected_envelopes, subscribed_ticks, topic_records, bronze_ticks,
        rejected_ticks, bronze_table, progress_snapshot,
        ohlcv_1m, ohlcv_1h, ohlcv_1m_event_time, ohlcv_aligned_77s, latest_candle,
        candles_for_symbol, stored_candles, stored_latest_candle, stored_candles_for_symbol,
        ilp_lines, candle_summaries,
        bar_documents, rejected_document_bars, landed_bars, landed_document_bars, rejected_document_files,
        landing_report,
        silver_bars, silver_table, rejected_bars, bars_for_symbol, symbols,
        universe_bars, missing_symbols, bars_capped, bars_default_cap, sample_bars, prev_close_change,
        macro_pulse, series_history, index_board, forex_board, commodity_board,
        landed_forex_board, landed_macro_pulse, quote_changes, index_changes,
        stream_bronze, stream_rejected, stream_candles, stream_ilp_lines, stream_published,
        stream_totals, stream_settled_candles, stream_open_candles, stream_ledger, stream_table,
    ]
}
