"""Helpers for operators on conversations: places of turns, digests, passes over sorted rows.

A conversation may hold a large part of all rows. Its turns are therefore numbered by a sort over ranges,
and everything that follows their order is done in blocks of BLOCK turns, then on one row per block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.llm.common import ship_library, stored

# Turns of a conversation that are handled together.
BLOCK = 4096


def digest(*columns: Column) -> Column:
    """128 bits of SHA-256 over the columns' texts, each but the last led by its length."""
    *lead, last = columns
    parts = [part for c in lead for part in (F.length(c).cast("string"), F.lit(":"), c)]
    return half(F.concat(*parts, last))


def half(content: Column) -> Column:
    """The first 16 bytes of the SHA-256."""
    return F.unhex(F.substring(F.sha2(content, 256), 1, 32))


def half_of(content: bytes) -> bytes:
    """What `half` gives, in Python."""
    return hashlib.sha256(content).digest()[:16]


def block_of(pos: str, block: int) -> Column:
    """The block of a place from 1 (0 counts as 1)."""
    return F.expr(f"(greatest(`{pos}`, 1) - 1) div {block}")


def each_block(rows: DataFrame, length: str, block: int) -> DataFrame:
    """A row for each block of a sequence of that length, so that joins meet at most a block per key."""
    return rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), block_of(length, block))))


def stream_pass(df: DataFrame, schema: str,
                run: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]) -> DataFrame:
    """Run a generator over the sorted Arrow batches of each task; it holds a batch at a time."""
    ship_library(df.sparkSession)
    return df.mapInArrow(run, schema)


def batched(rows: Iterable[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Rows gathered into batches."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, field.type) for column, field in zip(zip(*rows), schema)], schema=schema)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The batches row by row."""
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def numbered(rows: DataFrame, key: str, order: list[str], job: str) -> tuple[DataFrame, DataFrame]:
    """The rows, stored, with `pos`, their place from 1 among those of their key in the given order (nulls
    first); and one row per key with `n`, how many it has. The key must not be null.

    Rows are dealt by ranges of key and order, equal rows by chance, so a key with many rows is spread
    over several tasks. Each counts its own; only the key a task begins with can have rows before, so the
    numbers to add are at most one per task and are broadcast.
    """
    salted = rows.withColumn("__salt", F.xxhash64(F.monotonically_increasing_id()))
    dealt = (salted.repartitionByRange(key, *order, "__salt").sortWithinPartitions(key, *order)
             .drop("__salt").withColumn("__part", F.spark_partition_id()))
    place = dealt.columns.index(key)

    def count(batches):
        last, seen = None, 0
        for batch in batches:
            places = []
            for value in batch.column(place).to_pylist():
                seen = seen + 1 if value == last else 1
                last = value
                places.append(seen)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())],
                                             names=[*batch.schema.names, "__place"])

    schema = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in dealt.schema)
    dealt = stored(stream_pass(dealt, f"{schema}, __place bigint", count), job)
    runs = dealt.groupBy(key, "__part").agg(F.max("__place").alias("__n"))
    earlier = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (runs.withColumn("__before", F.sum("__n").over(earlier)).filter("__before is not null")
               .select(key, "__part", "__before"))
    result = (dealt.join(F.broadcast(offsets), [key, "__part"], "left")
              .withColumn("pos", F.col("__place") + F.coalesce("__before", F.lit(0)))
              .drop("__part", "__place", "__before"))
    return result, runs.groupBy(key).agg(F.sum("__n").alias("n"))
