"""The jobs and reports users call, composed from the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F

from barlake.dimensions import (
    COMMODITY_TICKERS, FOREX_TICKERS, INDEX_TICKERS, MACRO_SERIES, broadcast_listed, dimension,
    in_list_order,
)
from barlake.operators.bars import (
    bar_order, bars_from_documents, in_counted_universe, missing_symbols, newest_silver_order,
    parse_bar_documents, silver_bars,
)
from barlake.operators.boards import (
    index_changes, latest_of_documents, quote_changes,
)
from barlake.operators.latest import latest_documents, latest_row, newest
from barlake.sources.files import read_bar_symbols, write_json_lines
from barlake.sources.tables import refresh_table

# How many candles and bars a report shows unless told otherwise.
CANDLE_LIMIT = 60
BAR_LIMIT = 500


# Reports over tables

def latest_prices(candle_table: DataFrame) -> DataFrame:
    """The newest candle of every symbol, its close as price."""
    return latest_row(candle_table, "symbol", "timestamp").select(
        "symbol", F.col("close").alias("price"), "volume", "trade_count",
        "open", "high", "low", F.col("timestamp").cast("string").alias("timestamp"))


def symbol_candles(candle_table: DataFrame, symbol: str, limit: int = CANDLE_LIMIT) -> DataFrame:
    """The last candles of one symbol, newest first."""
    rows = newest(candle_table, symbol, [F.col("timestamp").desc_nulls_last()], limit)
    return rows.select("symbol", "open", "high", "low", "close", "volume", "trade_count",
                       F.col("timestamp").cast("string").alias("timestamp"))


def symbol_bars(silver: DataFrame, symbol: str, limit: int = BAR_LIMIT) -> DataFrame:
    """The last daily bars of one symbol, newest first."""
    rows = newest(silver, symbol, newest_silver_order(), limit)
    return rows.select("symbol", F.col("trade_date").cast("string").alias("trade_date"),
                       "open", "high", "low", "close", "volume", "vwap", "trade_count")


def symbol_list(silver: DataFrame) -> DataFrame:
    return silver.select("symbol").distinct().orderBy("symbol")


# Boards over landed documents

def _quote_board(documents: DataFrame, name: str, tickers: Sequence[tuple]) -> DataFrame:
    """One row per listed key in list order; a key without a usable quote says fetch_failed."""
    keys = dimension(documents.sparkSession, tickers, [name, "ticker"])
    latest = latest_documents(documents, "ticker", "seq", [ticker for _, ticker in tickers])
    quotes = quote_changes(latest.select("ticker", "value")).drop("value")
    board = keys.join(broadcast_listed(quotes, tickers), "ticker", "left").withColumn(
        "error", F.when(F.col("price").isNull(), F.lit("fetch_failed")))
    return in_list_order(board, tickers).select(
        name, "price", "prev_close", "change_pct", "currency", "error")


def forex_board(documents: DataFrame, tickers: Sequence[tuple] = FOREX_TICKERS) -> DataFrame:
    return _quote_board(documents, "pair", tickers)


def commodity_board(documents: DataFrame,
                    tickers: Sequence[tuple] = COMMODITY_TICKERS) -> DataFrame:
    return _quote_board(documents, "commodity", tickers)


def index_board(documents: DataFrame, tickers: Sequence[tuple] = INDEX_TICKERS) -> DataFrame:
    """Listed indices that have a readable quote, in list order."""
    keys = dimension(documents.sparkSession, tickers, ["sym", "ticker"])
    latest = latest_documents(documents, "ticker", "seq", [ticker for _, ticker in tickers])
    changes = index_changes(latest.select("ticker", "value"))
    board = keys.join(broadcast_listed(changes, tickers), "ticker")
    return in_list_order(board, tickers).select("sym", "val", "chg", "pct", "pos")


def macro_pulse(documents: DataFrame, series: Sequence[tuple] = MACRO_SERIES) -> DataFrame:
    """Every listed indicator with its newest observation, nulls where there is none."""
    keys = dimension(documents.sparkSession, series, ["indicator", "series_id", "label"])
    listed = documents.filter(F.col("series_id").isin([series_id for _, series_id, _ in series]))
    latest = latest_of_documents(listed)
    board = keys.join(broadcast_listed(latest, series), "series_id", "left")
    return in_list_order(board, series).select("indicator", "label", "value", "date")


# Jobs that write

def land_bars(documents: DataFrame, universe: DataFrame, path: str,
              received_ms: Column | None = None) -> tuple[int, DataFrame]:
    """Documents of the universe to bronze JSON lines: (bars written, symbols without bars).

    Documents are texts (`value`), which are parsed after those outside the universe are gone, or
    already parsed. The count is taken while writing, and the missing symbols are read off the
    written bars, of which only the symbol is parsed.
    """
    listed = in_counted_universe(documents, universe)
    parsed = parse_bar_documents(listed) if "value" in listed.columns else listed
    bars, _ = bars_from_documents(parsed, received_ms)
    written = Observation("bars")
    write_json_lines(bars.observe(written, F.count(F.lit(1)).alias("rows")), path)
    landed = read_bar_symbols(documents.sparkSession, path)
    return written.get["rows"], missing_symbols(universe, landed)


def sample_bars(bars: DataFrame, rows: int = 3) -> DataFrame:
    """A few bars to look at, always the same ones."""
    return bars.orderBy("symbol", *bar_order()).limit(rows)


def refresh_silver(bars: DataFrame, table: str, location: str | None = None) -> None:
    """Rebuild the silver table from all bronze bars."""
    refresh_table(silver_bars(bars), table, ["symbol", "trade_date"], location)
