"""Fixed dimension values and frames made from short lists."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

# Subscribed trading pairs.
SUBSCRIBED_SYMBOLS = ["BTCUSDT", "ETHUSDT", "SOLUSDT"]

# Provider names written to the source columns.
TICK_SOURCE = "binance"
BAR_SOURCE = "polygon"

# Daily-bar universe.
BAR_UNIVERSE = [
    "AAPL", "MSFT", "NVDA", "AMZN", "META",
    "GOOGL", "GOOG", "BRK.B", "LLY", "JPM",
    "V", "XOM", "UNH", "MA", "AVGO",
    "PG", "JNJ", "HD", "MRK", "COST",
    "ABBV", "CVX", "CRM", "BAC", "NFLX",
    "WMT", "AMD", "PEP", "KO", "TMO",
    "ACN", "MCD", "CSCO", "ABT", "TXN",
    "ADBE", "DHR", "WFC", "LIN", "NKE",
    "NEE", "PM", "ORCL", "RTX", "QCOM",
    "INTC", "INTU", "AMGN", "IBM", "GE",
]

# First day of bar history and rows per ticker and request.
BAR_HISTORY_START = "2024-01-01"
BAR_HISTORY_CAP = 50_000

# Macro indicators as (key, series, label).
MACRO_SERIES = [
    ("fed_rate", "FEDFUNDS", "Fed Funds Rate"),
    ("treasury_10y", "GS10", "10Y Treasury"),
    ("cpi", "CPIAUCSL", "CPI Inflation"),
    ("unemployment", "UNRATE", "Unemployment"),
    ("gdp_growth", "A191RL1Q225SBEA", "GDP Growth"),
    ("vix", "VIXCLS", "VIX"),
    ("dxy", "DTWEXBGS", "USD Index (DXY)"),
]

# Currency pairs as (key, quote ticker).
FOREX_TICKERS = [
    ("EURUSD", "EURUSD=X"),
    ("GBPUSD", "GBPUSD=X"),
    ("USDJPY", "JPY=X"),
    ("USDCHF", "CHF=X"),
    ("AUDUSD", "AUDUSD=X"),
    ("USDCAD", "CAD=X"),
    ("USDCNY", "CNY=X"),
    ("USDINR", "INR=X"),
]

# Commodities as (key, quote ticker).
COMMODITY_TICKERS = [
    ("GOLD", "GC=F"),
    ("OIL", "CL=F"),
    ("SILVER", "SI=F"),
    ("NATGAS", "NG=F"),
    ("COPPER", "HG=F"),
    ("WHEAT", "ZW=F"),
]

# Stock indices as (name, quote ticker). The quote service's request path carries
# the leading caret percent-encoded; the landed documents are keyed by the plain ticker.
INDEX_TICKERS = [
    ("S&P 500", "^GSPC"),
    ("NASDAQ", "^IXIC"),
    ("DOW JONES", "^DJI"),
    ("RUSSELL 2K", "^RUT"),
    ("VIX", "^VIX"),
    ("NIKKEI 225", "^N225"),
]

# Only lists up to this length, known before planning, lead to broadcasts or single-task sorts.
MAX_BROADCAST_ROWS = 10_000


def dimension(spark: SparkSession, rows: Sequence[tuple], columns: Sequence[str]) -> DataFrame:
    """A literal dimension with its list position; its size is known to the planner."""
    names = ["position", *columns]
    listed = [dict(zip(names, (position, *row))) for position, row in enumerate(rows)]
    fields = [pa.field("position", pa.int32()), *[pa.field(name, pa.string()) for name in columns]]
    return spark.createDataFrame(pa.Table.from_pylist(listed, pa.schema(fields)))


def broadcast_listed(df: DataFrame, keys: Sequence) -> DataFrame:
    """Hint for broadcast a frame of at most one row per listed key, while the list is short."""
    return F.broadcast(df) if len(keys) <= MAX_BROADCAST_ROWS else df


def in_list_order(df: DataFrame, keys: Sequence) -> DataFrame:
    """Rows of a dimension join by position; a short list needs no distributed sort."""
    if len(keys) <= MAX_BROADCAST_ROWS:
        return df.coalesce(1).sortWithinPartitions("position")
    return df.orderBy("position")
