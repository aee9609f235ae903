"""Time the operators that split hot symbols against plain plans, on rows a third of which share one.

`python skew_bench.py [ROWS]` derives that many bars (20 million by default) from a range of numbers and
prints seconds per plan as one JSON line. It is a measurement, not a query.
"""

from __future__ import annotations

import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from barlake.functions.times import MILLIS_PER_DAY
from barlake.operators import bars, candles, latest
from barlake.session import build_session


def skewed(spark: SparkSession, rows: int) -> DataFrame:
    number = F.xxhash64("id")
    symbol = F.when(F.col("id") % 3 == 0, "HOT").otherwise(
        F.concat(F.lit("S"), F.pmod(number, F.lit(5000))))
    return spark.range(rows).select(
        symbol.alias("symbol"), F.col("id").alias("trade_id"),
        (F.pmod(F.xxhash64(number), F.lit(2500)) * MILLIS_PER_DAY).alias("timestamp_ms"),
        *[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10_000)) / 100 + 1).alias(name)
          for k, name in enumerate(("open", "high", "low", "close", "volume", "vwap"))],
        F.lit(1).alias("trade_count"))


def main() -> None:
    rows = int(sys.argv[1]) if len(sys.argv) > 1 else 20_000_000
    spark = build_session("skew", "local[8]", {
        "spark.sql.shuffle.partitions": "64", "spark.driver.memory": "8g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    bar = skewed(spark, rows)
    tick = bar.select("symbol", F.col("open").alias("price"), F.col("volume").alias("quantity"), "trade_id",
                      F.col("timestamp_ms").alias("ingested_at_ms"))
    silver = bar.withColumn("trade_date", F.timestamp_millis("timestamp_ms").cast("date"))
    ties = [F.col(c) for c in ("open", "high", "low", "close", "volume", "vwap", "trade_count")]
    by_date = Window.partitionBy("symbol").orderBy("trade_date", *ties)
    by_time = Window.partitionBy("symbol").orderBy(*bars.bar_order())
    plans = {
        "candles_1h": lambda: candles.candles(tick, 3600),
        "previous_close": lambda: latest.previous_close(silver),
        "previous_close_plain": lambda: silver.withColumn("prev_close", F.lag("close").over(by_date)),
        "capped_history": lambda: bars.capped_history(bar, "1970-01-01", "1980-12-31"),
        "capped_history_plain": lambda: bar.withColumn(
            "place", F.row_number().over(by_time)).filter(F.col("place") <= 50_000),
    }
    seconds = {}
    for name, plan in plans.items():
        start = time.perf_counter()
        plan().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 1)
    print(json.dumps({"rows": rows, "seconds": seconds}))
    spark.stop()


if __name__ == "__main__":
    main()
