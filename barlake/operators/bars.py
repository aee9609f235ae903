"""Daily bars: response documents to bronze rows, bronze to silver, universe reports."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlake.dimensions import BAR_HISTORY_CAP, BAR_HISTORY_START, BAR_SOURCE
from barlake.functions import day_of_millis, millis_now, to_bigint_half_even, utc_date_text
from barlake.functions.times import MILLIS_PER_DAY
from barlake.operators.decode import parse_once
from barlake.operators.latest import top_per_key
from barlake.operators.quality import passes, require_valid, split_valid
from barlake.schemas import BAR_DOCUMENT
from barlake.session import run_folder

# Fields of a provider bar that must be present, with the column each one becomes.
REQUIRED_BAR_FIELDS = {
    "t": "timestamp_ms", "o": "open", "h": "high", "l": "low", "c": "close", "v": "volume"}

# A universe of so many symbols at most is sent to every executor, where a short symbol takes about 100 bytes.
SENT_SYMBOLS = 2_000_000

# Total order of one symbol's bars: time first, then every value, so that only identical rows tie.
_TIE_BREAK = ["open", "high", "low", "close", "volume", "vwap", "trade_count"]


def parse_bar_documents(documents: DataFrame) -> DataFrame:
    """Response texts (`symbol`, `value`) to their status and result list."""
    parsed = parse_once(documents, F.from_json("value", BAR_DOCUMENT), "document")
    return parsed.select("symbol", "document.*")


def bars_from_documents(documents: DataFrame, received_ms: Column | None = None,
                        strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Parsed bar documents to (bronze bars, rejected bars).

    A document with the status ERROR, or without results, has no bars.
    """
    fine = ~F.col("status").eqNullSafe(F.lit("ERROR"))
    bars = documents.filter(fine).select("symbol", F.explode("results").alias("bar"))
    rules = {name: F.col(f"bar.{field}").isNotNull()
             for field, name in REQUIRED_BAR_FIELDS.items()}
    valid, rejected = split_valid(bars, rules)
    if strict:
        valid = require_valid(bars, rules)
    return valid.select(
        "symbol",
        utc_date_text("bar.t").alias("date"),
        F.col("bar.o").alias("open"),
        F.col("bar.h").alias("high"),
        F.col("bar.l").alias("low"),
        F.col("bar.c").alias("close"),
        F.col("bar.v").alias("volume"),
        F.col("bar.vw").alias("vwap"),
        F.col("bar.n").alias("trade_count"),
        F.col("bar.t").alias("timestamp_ms"),
        (millis_now() if received_ms is None else received_ms).alias("ingested_at_ms"),
        F.lit(BAR_SOURCE).alias("source"),
        F.lit(True).alias("adjusted")), rejected


def silver_rules() -> dict[str, Column]:
    """What a bar must satisfy, tested on the values as landed and before any cast."""
    return {
        "close_positive": F.col("close") > 0,
        "volume_positive": F.col("volume") > 0,
        "open_positive": F.col("open") > 0,
        "high_not_below_low": F.col("high") >= F.col("low"),
        "symbol_present": F.col("symbol").isNotNull(),
    }


def silver_bars(bars: DataFrame) -> DataFrame:
    """Bronze bars that pass the rules, typed. Values that do not fit their type fail the job."""
    return bars.filter(passes(silver_rules())).select(
        "symbol",
        F.col("date").cast("date").alias("trade_date"),
        F.col("open").cast("double").alias("open"),
        F.col("high").cast("double").alias("high"),
        F.col("low").cast("double").alias("low"),
        F.col("close").cast("double").alias("close"),
        to_bigint_half_even("volume").alias("volume"),
        F.col("vwap").cast("double").alias("vwap"),
        F.col("trade_count").cast("int").alias("trade_count"),
        F.col("source").cast("string").alias("source"),
        F.col("adjusted").cast("boolean").alias("adjusted"),
        F.current_timestamp().alias("processed_at"))


def rejected_bars(bars: DataFrame) -> DataFrame:
    """Bronze bars that silver leaves out, with the rules they break."""
    return split_valid(bars, silver_rules())[1]


def in_universe(bars: DataFrame, universe: DataFrame) -> DataFrame:
    """Bars of the listed symbols only."""
    return bars.join(universe.select("symbol"), "symbol", "left_semi")


def in_counted_universe(documents: DataFrame, universe: DataFrame) -> DataFrame:
    """Documents of the listed symbols only; the symbols are counted first.

    A universe of at most SENT_SYMBOLS goes to the documents, as the shuffle of a join would store every
    document's text. Of a larger one the planner decides.
    """
    if universe.count() <= SENT_SYMBOLS:
        universe = F.broadcast(universe)
    return in_universe(documents, universe)


def missing_symbols(universe: DataFrame, bars: DataFrame) -> DataFrame:
    """Listed symbols without a single bar. Bars shrink to their symbols before the join."""
    seen = bars.select("symbol").distinct()
    return universe.select("symbol").distinct().join(seen, "symbol", "left_anti")


def bar_order() -> list[Column]:
    """Ascending time, ties by value."""
    return [F.col("timestamp_ms").asc(), *[F.col(name).asc_nulls_last() for name in _TIE_BREAK]]


def newest_silver_order() -> list[Column]:
    """Newest trade date first, ties by value."""
    return [F.col("trade_date").desc_nulls_last(),
            *[F.col(name).asc_nulls_last() for name in _TIE_BREAK]]


def _day_start_ms(day: str) -> int:
    return (date.fromisoformat(day) - date(1970, 1, 1)).days * MILLIS_PER_DAY


def capped_history(bars: DataFrame, first_day: str = BAR_HISTORY_START, last_day: str | None = None,
                   cap: int = BAR_HISTORY_CAP) -> DataFrame:
    """Bars from the first to the last day (today by default), both included, at most `cap` per
    symbol, oldest kept.

    Ranking whole symbols would sort a hot one in a single task. Counting bars per symbol and day
    instead shows on which day a symbol reaches the cap: earlier days are kept whole, later ones
    dropped, and only the bars of that one day are ranked. The counts read two columns and are taken
    once: at most one row per capped symbol is written to the run folder for both branches that follow.
    """
    last_day = last_day or datetime.now(timezone.utc).date().isoformat()
    first_ms, after_ms = _day_start_ms(first_day), _day_start_ms(last_day) + MILLIS_PER_DAY
    ranged = bars.filter((F.col("timestamp_ms") >= first_ms) & (F.col("timestamp_ms") < after_ms))
    dated = ranged.withColumn("day", day_of_millis("timestamp_ms"))
    per_day = dated.groupBy("symbol", "day").agg(F.count(F.lit(1)).alias("day_rows"))
    days = Window.partitionBy("symbol").orderBy("day")
    reached = F.sum("day_rows").over(days)
    last_days = (per_day.withColumn("reached", reached)
                 .filter((F.col("reached") > cap)
                         & (F.col("reached") - F.col("day_rows") <= cap))
                 .select(F.col("symbol").alias("capped_symbol"),
                         F.col("day").alias("last_day"),
                         (F.lit(cap) - F.col("reached") + F.col("day_rows")).alias("room"),
                         F.ceil(F.sqrt(F.col("day_rows") / cap)).alias("shares")))
    spark = bars.sparkSession
    place = run_folder(spark, "capped_history")
    last_days.write.parquet(place)
    last_days = spark.read.schema(last_days.schema).parquet(place)
    joined = dated.join(
        last_days, F.col("symbol").eqNullSafe(F.col("capped_symbol")), "left")
    columns = bars.columns
    before = joined.filter(F.col("last_day").isNull() | (F.col("day") < F.col("last_day")))
    on_last_day = joined.filter(F.col("day") == F.col("last_day"))
    # With this many shares, a share and the sum of their survivors hold about equally many rows.
    filling = top_per_key(on_last_day.select(*columns, "room", "shares"), ["symbol"],
                          bar_order(), cap, F.col("shares"))
    return before.select(*columns).unionByName(
        filling.filter(F.col("place") <= F.col("room")).select(*columns))
