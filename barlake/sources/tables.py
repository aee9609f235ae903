"""Catalog tables: create if absent, append, full refresh."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from barlake.schemas import BRONZE_TICK_DDL
from barlake.session import file_names, settings, write_file

WRITER_FILE = "writer.txt"
# Partitions of a table that batches are appended to.
BATCH_PARTITIONS = ("day", "writer", "batch")


def batch_ddl(ddl: str = BRONZE_TICK_DDL) -> str:
    """The columns of a table that `append_batch` writes to."""
    return f"{ddl}, writer STRING, batch BIGINT"


def ensure_table(spark: SparkSession, name: str, ddl: str = BRONZE_TICK_DDL,
                 partition_by: Sequence[str] = ("day",), location: str | None = None,
                 format: str = "parquet") -> None:
    """Create the database and the table where they do not exist yet.

    Ticks are partitioned by day; symbols are too many, and too uneven, to partition by.
    """
    database, _, _ = name.rpartition(".")
    if database:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    parts = f"PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
    place = f"LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING {format} {parts} {place}")


def append_rows(df: DataFrame, name: str) -> None:
    """Append to an existing table, matching columns by name.

    Rows of a partition are gathered before they are written, in pieces of a size AQE chooses, so that
    a partition gets a few files of that size and not one from every task.
    """
    spark = df.sparkSession
    columns = df.sparkSession.table(name).columns
    parts = [column.name for column in spark.catalog.listColumns(name) if column.isPartition]
    rows = df.select(*columns)
    (rows.hint("rebalance", *parts) if parts else rows).write.insertInto(name)


def append_batch(df: DataFrame, name: str, writer: str, batch: int) -> None:
    """Append a micro-batch so that repeating it adds nothing.

    The table is partitioned by `writer` and `batch` besides its own partitions; a batch replaces exactly
    the partitions it wrote before, if it did. Who wrote them is part of the key, so that a query that
    begins anew does not replace an earlier one's batches.
    """
    spark = df.sparkSession
    columns = spark.table(name).columns
    parts = [column.name for column in spark.catalog.listColumns(name) if column.isPartition]
    rows = df.withColumns({"writer": F.lit(writer), "batch": F.lit(batch).cast("bigint")}).select(*columns)
    with settings(spark, {"spark.sql.sources.partitionOverwriteMode": "dynamic"}):
        rows.hint("rebalance", *parts).write.insertInto(name, overwrite=True)


def writer_of(spark: SparkSession, checkpoint: str) -> str:
    """The name under which a query with this checkpoint writes batches; made on its first start."""
    if WRITER_FILE not in file_names(spark, checkpoint):
        write_file(spark, f"{checkpoint}/{WRITER_FILE}", uuid.uuid4().hex.encode())
    return spark.read.text(f"{checkpoint}/{WRITER_FILE}").first()["value"]


def table_writer(rows: DataFrame, name: str, checkpoint: str) -> DataStreamWriter:
    """A streaming writer into a catalog table made with `batch_ddl`. A batch that is run again, because
    the job died between the append and the commit, replaces what it had appended."""
    writer = writer_of(rows.sparkSession, checkpoint)
    return (rows.writeStream.option("checkpointLocation", checkpoint).outputMode("append")
            .foreachBatch(lambda df, batch: append_batch(df, name, writer, batch)))


def with_compacted(fresh: DataFrame, compacted: DataFrame, partition_by: str = "day") -> DataFrame:
    """Every partition once: the compacted ones, and those of the stream's folder that are not yet."""
    done = F.broadcast(compacted.select(partition_by).distinct())  # a row per partition, that is per day
    return compacted.unionByName(fresh.join(done, partition_by, "left_anti").select(*compacted.columns))


def compact_partitions(rows: DataFrame, path: str, partition_by: str = "day",
                       format: str = "parquet") -> None:
    """Rewrite partitions that a stream left in many small files as a few large ones below `path`.

    `rows` are the closed partitions to compact, for example yesterday's, read from the stream's folder.
    Only the partitions they have are replaced, so a run may be repeated. The stream's own folder stays
    as it is, since its sink keeps a list of its files.
    """
    (rows.hint("rebalance", partition_by).write.format(format).partitionBy(partition_by)
     .option("partitionOverwriteMode", "dynamic").mode("overwrite").save(path))


def refresh_table(df: DataFrame, name: str, sort_by: Sequence[str] = (),
                  location: str | None = None, format: str = "parquet",
                  keep_seconds: float = 86_400) -> None:
    """Rebuild a table behind a view: write a new build, then point the view at it.

    Replacing the view is one catalog change, so readers see the old rows or the new ones and never
    none. Builds have the time they began in their names: those that began over `keep_seconds` ago are
    removed afterwards, but for the one before this, so that queries still reading an older build, and
    refreshes that run at the same time, keep their files. A build that fails is removed at once.
    `location` is the folder for the data, each build in a folder of its own. Rows are dealt by
    range of `sort_by` and sorted, which cuts a hot symbol into several files and lets a filter on a
    symbol skip the others.
    """
    spark = df.sparkSession
    database, _, table = name.rpartition(".")
    began = int(time.time() * 1000)
    build = f"{name}__{began:013d}_{uuid.uuid4().hex}"
    rows = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by) if sort_by else df
    writer = rows.write.format(format).mode("overwrite")
    if location:
        writer = writer.option("path", f"{location.rstrip('/')}/{build.rpartition('__')[2]}")
    try:
        writer.saveAsTable(build)
        if spark.catalog.tableExists(name) and spark.catalog.getTable(name).tableType != "VIEW":
            spark.sql(f"DROP TABLE {name}")  # made before builds stood behind views
        spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {build}")
    except BaseException:
        _remove_build(spark, build, location)
        raise
    builds = sorted(t.name for t in spark.catalog.listTables(database or None, f"{table}__*"))
    mine = builds.index(build.rpartition(".")[2].lower())
    for old in builds[:max(mine - 1, 0)]:
        if began - int(old.rpartition("__")[2].partition("_")[0]) >= keep_seconds * 1000:
            _remove_build(spark, f"{database}.{old}" if database else old, location)


def _remove_build(spark: SparkSession, build: str, location: str | None) -> None:
    """Drop a build and, where it lies in a folder of ours, its files."""
    spark.sql(f"DROP TABLE IF EXISTS {build}")
    if location:
        place = spark._jvm.org.apache.hadoop.fs.Path(
            f"{location.rstrip('/')}/{build.rpartition('__')[2]}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
