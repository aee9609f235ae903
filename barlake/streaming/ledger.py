"""Counters of a streaming query that outlive its runs, kept next to its checkpoint.

A listener writes a small file per batch when Spark reports the batch; nothing is polled, and the totals
are read back by Spark. A batch that is run again after a failure replaces its file.
"""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from barlake.session import file_names, write_file

_BATCH = ("batch bigint, run string, ticks bigint, input_rows bigint, late_rows bigint, latest_symbol string, "
          "latest_price double")


class BatchLedger(StreamingQueryListener):
    """Writes the counters of every batch of one query below its checkpoint."""

    def __init__(self, spark: SparkSession, checkpoint: str, metrics: str):
        self.spark, self.folder, self.metrics = spark, f"{checkpoint}/ledger", metrics
        self.query_id = None
        self.early: list = []  # reports that come before the query's id is known
        self.seen: dict[int, tuple] = {}
        self.ended, self.lock = threading.Event(), threading.Lock()

    def follow(self, query: StreamingQuery) -> None:
        with self.lock:
            self.query_id = str(query.id)
            for progress in self.early:
                self.write(progress)
            self.early = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with self.lock:
            if self.query_id is None:
                self.early.append(event.progress)
            else:
                self.write(event.progress)

    def onQueryTerminated(self, event) -> None:
        if self.query_id in (None, str(event.id)):
            self.ended.set()

    def write(self, progress) -> None:
        if str(progress.id) != self.query_id:
            return
        observed = progress.observedMetrics.get(self.metrics)
        found = observed.asDict() if observed is not None else {}
        late = sum(state.numRowsDroppedByWatermark for state in progress.stateOperators)
        counts = (found.get("ticks") or 0, progress.numInputRows, late)
        # An idle batch may be reported once more under the same number, without its rows.
        if progress.batchId in self.seen and counts <= self.seen[progress.batchId]:
            return
        self.seen[progress.batchId] = counts
        line = {"batch": progress.batchId, "run": str(progress.runId), "ticks": counts[0],
                "input_rows": counts[1], "late_rows": counts[2],
                "latest_symbol": found.get("latest_symbol"), "latest_price": found.get("latest_price")}
        write_file(self.spark, f"{self.folder}/{progress.batchId:012d}.json", json.dumps(line).encode())


def run_counted(spark: SparkSession, writer: DataStreamWriter, checkpoint: str, metrics: str = "ticks",
                wait_seconds: float = 60) -> StreamingQuery:
    """Start a query, follow it to its end and leave the counters of its batches in the ledger."""
    ledger = BatchLedger(spark, checkpoint, metrics)
    spark.streams.addListener(ledger)
    try:
        query = writer.start()
        ledger.follow(query)
        try:
            query.awaitTermination()
        finally:
            # Reports come in order, the end last.
            if not ledger.ended.wait(wait_seconds):
                raise RuntimeError("the end of the query was not reported; its ledger may be incomplete")
        return query
    finally:
        spark.streams.removeListener(ledger)


def batches(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The ledger, a row per batch of all runs."""
    return spark.read.schema(_BATCH).json(f"{checkpoint}/ledger")


def totals(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Counters over all runs, as one row; newest symbol and price are those of the last batch with ticks.

    Fails if the ledger lacks a batch that the checkpoint says is committed, or one between others.
    """
    known = {int(name.partition(".")[0]) for name in file_names(spark, f"{checkpoint}/ledger") if name.endswith(".json")}
    committed = {int(name) for name in file_names(spark, f"{checkpoint}/commits") if name.isdigit()}
    lacking = sorted((committed | set(range(min(known, default=0), max(known, default=-1) + 1))) - known)
    if lacking:
        raise RuntimeError(f"the ledger lacks batches {lacking[:10]}; the totals are not whole")
    newest = F.when(F.col("ticks") > 0, F.col("batch"))
    return batches(spark, checkpoint).agg(
        F.count("*").alias("batches"), F.countDistinct("run").alias("runs"), F.sum("ticks").alias("ticks"),
        F.sum("input_rows").alias("input_rows"), F.sum("late_rows").alias("late_rows"),
        F.max_by("latest_symbol", newest).alias("latest_symbol"),
        F.max_by("latest_price", newest).alias("latest_price"))
