"""Helpers the operators share: stored intermediates, Arrow passes, training splits, components."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.session import run_folder, ship_library

# Words are runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
# The same split for Python's str.translate: all ASCII white space becomes a space.
SPACES = {code: " " for code in range(9, 14)}


def words_of(text: str) -> list[str]:
    """The words of a text, as WORD finds them."""
    return [word for word in text.translate(SPACES).split(" ") if word]


def lower_ascii(text: str) -> str:
    """Lower-case A-Z only."""
    if text.isascii():
        return text.lower()
    return text.translate(_LOWER)


_LOWER = {code: code + 32 for code in range(ord("A"), ord("Z") + 1)}


def stored(df: DataFrame, job: str) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it back: later steps, and tasks that
    are repeated because an executor was lost, read the files and compute nothing again."""
    place = run_folder(df.sparkSession, f"llm-{job}")
    df.write.parquet(place)
    result = df.sparkSession.read.schema(df.schema).parquet(place)
    result.stored_place = place
    if _places is not None:
        _places.append(place)
    return result


# Folders of the frames that are stored while `recorded` is on.
_places: list[str] | None = None


@contextmanager
def recorded():
    """The folders of all frames that are stored inside and not discarded there."""
    global _places
    before, _places = _places, []
    try:
        yield _places
    finally:
        _places = before


def delete(spark: SparkSession, place: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*frames: DataFrame) -> None:
    """Delete the files of stored frames that no later result reads."""
    for frame in frames:
        delete(frame.sparkSession, frame.stored_place)
        if _places and frame.stored_place in _places:
            _places.remove(frame.stored_place)


def forget_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files and plans of steps that are done and stored. Spark deletes the files when
    the driver's garbage is collected, which on a roomy driver may be long after they have filled the disks.
    Frames that Python has not collected yet would keep both."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remainder(id_column: Column, modulus: int) -> Column:
    """crc32 of an id's text, modulo a number; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % modulus


def arrow_pass(df: DataFrame, schema: str,
               make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]],
               rows: int = 2000) -> DataFrame:
    """Run a function over the frame's Arrow batches, in slices of at most `rows` rows.

    `make` is called once per task, so that models and caches are built once and not per batch.
    """
    ship_library(df.sparkSession)

    def run(batches):
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                yield from work(batch.slice(start, rows))
        pa.default_memory_pool().release_unused()  # the worker lives on

    return df.mapInArrow(run, schema)


def running_totals(numbers: Column, width: int = 128) -> Column:
    """Sums of an array's beginnings: in pieces of a fixed width, then over the pieces, so that the work
    does not grow with the square of the length."""
    zero = F.lit(0).cast("bigint")

    def total(values: Column) -> Column:
        return F.aggregate(values, zero, lambda so_far, x: so_far + x)

    def totals(values: Column) -> Column:
        return F.aggregate(
            values, F.struct(zero.alias("total"), F.array().cast("array<bigint>").alias("sums")),
            lambda state, x: F.struct((state["total"] + x).alias("total"), F.concat(
                state["sums"], F.array(state["total"] + x)).alias("sums")),
            lambda state: state["sums"])

    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / width).cast("int")),
                         lambda i: F.slice(numbers, i * width + 1, width))
    sizes = F.transform(pieces, total)
    starts = F.zip_with(totals(sizes), sizes, lambda upto, size: upto - size)
    summed = F.zip_with(pieces, starts, lambda piece, start: F.transform(totals(piece), lambda x: start + x))
    return F.when(F.size(numbers) > 0, F.flatten(summed)).otherwise(F.array().cast("array<bigint>"))


def most_frequent(counts: DataFrame, most: int, n: str = "n") -> DataFrame:
    """The rows with the highest counts, at most `most` of them: those above a cut through the histogram
    of the counts' logarithms. Rows are neither sorted nor gathered, and equal counts stay together."""
    level = F.floor(F.log2(n) * 16)
    histogram = counts.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).collect()
    room, cut = most, None
    for row in sorted(histogram, key=lambda r: -r["level"]):  # a few hundred levels at most
        room -= row["rows"]
        if room < 0:
            break
        cut = row["level"]
    return counts.filter(F.lit(False) if cut is None else level >= cut)


def connected_components(edges: DataFrame, job: str, forget: bool = False) -> DataFrame:
    """Smallest id reachable from each node of undirected edges (a, b): columns node, component.

    Large-star and small-star rounds: each turns every edge towards the smallest neighbour of one of
    its ends, until nothing changes. The number of edges never grows, no neighbourhood is ever
    collected, and rounds grow with the logarithm of the nodes. Nodes without an edge to another node
    are left out. Each round is written to the shared folder; with `forget`, its shuffles and plans are let
    go of before the next one.
    """
    links = (edges.filter("a <> b")
             .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    links = stored(links, job)
    before, count = None, links.count()
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"),
                                      F.count("*").alias("ends"))
        # Nodes with more than a thousandth of the edges, of which there can be no more than 2,000, are
        # looked up from a broadcast, so the edges of a large class never meet in one task.
        hot = F.broadcast(least.filter(F.col("ends") > max(count // 1000, 1000)).select("a", "least"))
        upward = both.filter("b > a")
        # Large star: every larger neighbour of a node hangs on the node's smallest neighbour.
        known = upward.join(hot, "a").unionByName(
            upward.join(hot, "a", "left_anti").join(least.select("a", "least"), "a"))
        large = known.select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        # Small star: a node and its smaller neighbours hang on the smallest of them.
        small_least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = (large.join(small_least, "a")
                 .select(F.explode(F.array(
                     F.struct(F.col("a"), F.col("least").alias("b")),
                     F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("e"))
                 .select("e.a", "e.b").filter("a <> b").distinct())
        old, links = links, stored(small, job)
        discard(old)
        if forget:
            forget_shuffles(links.sparkSession)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, count = now, now[0]
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component")).distinct()
