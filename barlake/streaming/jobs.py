"""The streaming queries over the tick topic.

Each query scans the topic by itself and keeps its own checkpoint, so archive and candles fail and
recover independently. File sinks commit together with the checkpoint: a lost executor or a
restarted query neither loses nor repeats rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from barlake.dimensions import SUBSCRIBED_SYMBOLS
from barlake.operators.candles import (
    arrival_order, candles, line_protocol, summary_lines, with_day,
)
from barlake.operators.decode import (
    CANDLE_FIELDS, archive_rows, decode_ticks, decode_trades, encode_ticks,
)
from barlake.sources.tables import table_writer
from barlake.sources.topics import topic_writer

# Fixed value: rows per append of the tick archive. Used as is this makes many small files; raise
# `maxOffsetsPerTrigger` and the trigger interval with the volume.
ARCHIVE_BATCH_ROWS = 500

# Fixed value: seconds between two progress reports.
REPORT_SECONDS = 10

METRICS = "ticks"


def archive_limits(rows: int | None = ARCHIVE_BATCH_ROWS, files: int | None = None,
                   size: str | None = None) -> dict[str, str]:
    """Reader options that bound a micro-batch: by rows for Kafka, by files or bytes (such as "1g") for
    topics of landed files. Of files and bytes a file source takes one."""
    if files is not None and size is not None:
        raise ValueError("bound a micro-batch by files or by bytes, not by both")
    limits = {"maxOffsetsPerTrigger": rows, "maxFilesPerTrigger": files, "maxBytesPerTrigger": size}
    return {name: str(limit) for name, limit in limits.items() if limit is not None}


def places(records: DataFrame) -> list[str]:
    """The columns that say where in the topic a record stands."""
    return [name for name in ("partition", "offset") if name in records.columns]


def observed(ticks: DataFrame) -> DataFrame:
    """Ticks with a running count and newest symbol and price in the query's progress."""
    order = arrival_order(ticks, "ingested_at_ms")
    return ticks.observe(
        METRICS,
        F.count(F.lit(1)).alias("ticks"),
        F.max_by("symbol", order).alias("latest_symbol"),
        F.max_by("price", order).alias("latest_price"))


def publish_writer(envelopes: DataFrame, format: str, options: dict[str, str], checkpoint: str,
                   symbols: Sequence[str] | None = SUBSCRIBED_SYMBOLS) -> DataStreamWriter:
    """Envelopes of the subscribed symbols (all, if None) decoded and published, keyed by symbol."""
    ticks, _ = decode_trades(envelopes, symbols=symbols)
    return (topic_writer(encode_ticks(observed(ticks)), format, options)
            .option("checkpointLocation", checkpoint).outputMode("append"))


def archived(records: DataFrame, strict: bool = False, distinct_within: str | None = None) -> DataFrame:
    """Every decodable tick as a bronze row. Ticks are not deduplicated unless `distinct_within`, such as
    "10 minutes", asks for it: then a symbol's trade id counts once within that time."""
    ticks, _ = decode_ticks(records, keep=places(records), strict=strict)
    ticks = observed(ticks)
    if distinct_within is not None:
        ticks = (ticks.withColumn("arrived", F.timestamp_millis("ingested_at_ms"))
                 .withWatermark("arrived", distinct_within)
                 .dropDuplicatesWithinWatermark(["symbol", "trade_id"]).drop("arrived"))
    return archive_rows(ticks)


def archive_writer(records: DataFrame, path: str, checkpoint: str, strict: bool = False,
                   format: str = "parquet", distinct_within: str | None = None) -> DataStreamWriter:
    """Bronze rows appended to files, partitioned by arrival day (see `archived`)."""
    return (archived(records, strict, distinct_within).writeStream.format(format)
            .option("path", path).option("checkpointLocation", checkpoint)
            .partitionBy("day").outputMode("append"))


def archive_table_writer(records: DataFrame, name: str, checkpoint: str, strict: bool = False,
                         distinct_within: str | None = None) -> DataStreamWriter:
    """Bronze rows appended to a catalog table; a batch that is run again adds nothing."""
    return table_writer(archived(records, strict, distinct_within), name, checkpoint)


def quarantine_writer(records: DataFrame, path: str, checkpoint: str,
                      format: str = "parquet") -> DataStreamWriter:
    """The messages the archive leaves out, with the reason."""
    _, rejected = decode_ticks(records)
    return (rejected.writeStream.format(format)
            .option("path", path).option("checkpointLocation", checkpoint).outputMode("append"))


def candle_stream(records: DataFrame, seconds: int = 60, time_basis: str = "arrival",
                  late_by: str = "10 seconds") -> DataFrame:
    """Closed candles of the topic. A candle needs symbol, price, quantity and its clock only."""
    clock = "ingested_at_ms" if time_basis == "arrival" else "timestamp_ms"
    ticks, _ = decode_ticks(records, required=[*CANDLE_FIELDS, clock], keep=places(records))
    return candles(ticks, seconds, time_basis, late_by)


def candle_writer(closed: DataFrame, path: str, checkpoint: str,
                  format: str = "parquet") -> DataStreamWriter:
    """Closed candles as table rows, partitioned by the day of their label."""
    return (with_day(closed).writeStream.format(format)
            .option("path", path).option("checkpointLocation", checkpoint)
            .partitionBy("day").outputMode("append"))


def line_protocol_writer(closed: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Closed candles as line-protocol text files."""
    return (line_protocol(closed).writeStream.format("text")
            .option("path", path).option("checkpointLocation", checkpoint).outputMode("append"))


def console_writer(closed: DataFrame) -> DataStreamWriter:
    """Closed candles as readable lines on the console."""
    return summary_lines(closed).writeStream.format("console").option("truncate", "false")


class RunLedger:
    """Counters of a whole run, added up batch by batch.

    A query keeps reports of its latest batches only. The ledger takes them over while the query runs,
    each batch once, and fails rather than count too little should a batch have slipped by unseen.
    """

    def __init__(self):
        self.batches: dict[int, tuple[int, int, int]] = {}
        self.newest: tuple[int, dict] | None = None
        self.run_id = None

    def take(self, query: StreamingQuery) -> RunLedger:
        """Add the reports that are not in the ledger yet."""
        if self.run_id not in (None, query.runId):
            raise ValueError("a ledger belongs to one run of a query")
        self.run_id = query.runId
        for progress in query.recentProgress:
            metrics = progress.observedMetrics.get(METRICS)
            ticks = metrics["ticks"] if metrics is not None else 0
            late = sum(state.numRowsDroppedByWatermark for state in progress.stateOperators)
            # A batch may be reported again without data; the report with the most rows is its own.
            known = self.batches.get(progress.batchId, (0, 0, 0))
            self.batches[progress.batchId] = tuple(
                map(max, known, (ticks, progress.numInputRows, late)))
            if ticks and (self.newest is None or progress.batchId >= self.newest[0]):
                self.newest = (progress.batchId, metrics.asDict())
        return self

    def missed(self) -> int:
        """Batches between the first and the last one that no report was seen of."""
        return max(self.batches) - min(self.batches) + 1 - len(self.batches) if self.batches else 0

    def totals(self) -> dict:
        """Ticks and input rows of all batches, rows that came too late, newest symbol and price."""
        if self.missed():
            raise RuntimeError(f"{self.missed()} batches were not seen; the totals are not whole")
        sums = [sum(column) for column in zip(*self.batches.values())] or [0, 0, 0]
        newest = self.newest[1] if self.newest else {}
        return {"ticks": sums[0], "input_rows": sums[1], "late_rows": sums[2],
                "latest_symbol": newest.get("latest_symbol"),
                "latest_price": newest.get("latest_price")}


def follow(query: StreamingQuery, every: float = 0.5, report: Callable[[dict], None] | None = None,
           report_seconds: float = REPORT_SECONDS, fail_when_late: bool = False) -> RunLedger:
    """Watch a running query to its end and return its ledger.

    `report` gets the totals so far every `report_seconds`. With `fail_when_late` the query is stopped
    and an error raised as soon as a row was dropped behind the watermark, so that no candle stays
    silently short.
    """
    ledger, told = RunLedger(), time.monotonic()
    while True:
        ended = query.awaitTermination(every)
        late = ledger.take(query).totals()["late_rows"]
        if fail_when_late and late:
            query.stop()
            raise RuntimeError(f"ticks arrived after their window was emitted ({late} partial rows)")
        if report is not None and time.monotonic() - told >= report_seconds:
            report(ledger.totals())
            told = time.monotonic()
        if ended:
            return ledger


def drain(writer: DataStreamWriter) -> RunLedger:
    """Process everything that is there, commit and stop; returns the counters of the whole run."""
    return follow(writer.trigger(availableNow=True).start(), every=0.05)


def drain_candles(writer: DataStreamWriter) -> RunLedger:
    """Drain, and fail if any candle lacks ticks that came too late.

    Replaying a topic whose partitions cover very different spans of time can outrun `late_by`.
    Fold such a backlog as a batch from the archive, or run with a larger `late_by`.
    """
    return follow(writer.trigger(availableNow=True).start(), every=0.05, fail_when_late=True)


def run_candles(writer: DataStreamWriter, report: Callable[[dict], None] | None = None) -> RunLedger:
    """Run a candle query until it is stopped; fail as soon as a tick came too late for its candle."""
    return follow(writer.start(), report=report, fail_when_late=True)
