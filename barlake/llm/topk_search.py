"""Exact top-k inner-product search as a Voronoi join.

Pivots cut the data into cells. Counts and radii of the cells bound every score from above; each query
is first solved against the cell that promises most, which gives it a score to beat, and is then sent
only to the cells whose bound reaches that score. Cells are solved locally.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlake.llm.common import arrow_pass, ship_library, stored

SCALE = 64


def quantized(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id and floor(64 x) of each component of the vectors that are neither null nor empty and hold
    only finite components."""
    return (vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("x"))
            .filter("id is not null and x is not null and size(x) > 0")
            .filter(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
            .select("id", F.transform("x", lambda c: F.floor(c * SCALE)).alias("v")))


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in floating point where all sums stay below 2**53."""
    most = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * left.shape[1]
    if most < 2 ** 53:
        return (left.astype(float) @ right.astype(float).T).astype(np.int64)
    return left @ right.T


def best_of(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int,
            ) -> tuple[np.ndarray, np.ndarray]:
    """Of scores that belong to rows, each row's k highest, ties to the smaller id: rows and places."""
    order = np.lexsort((ids, -scores, rows))
    sorted_rows = rows[order]
    begins = np.searchsorted(sorted_rows, sorted_rows, side="left")
    kept = np.arange(len(order)) - begins < k
    return sorted_rows[kept], order[kept]


class Cells:
    """Pivots with the count and the radius of their cells; bounds on scores of queries."""

    def __init__(self, pivots: np.ndarray, counts: np.ndarray, radii: np.ndarray):
        self.pivots, self.counts, self.radii = pivots, counts, radii

    def promises(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score with each pivot, and the most that any vector of its cell can score."""
        centre = queries.astype(float) @ self.pivots.T
        norm = np.sqrt((queries.astype(float) ** 2).sum(axis=1))
        reach = norm[:, None] * self.radii[None, :]
        return centre, (centre + reach) * (1 + 1e-12) + np.abs(centre) * 1e-9 + 1e-6


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow column of equally long lists as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def search(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", k: int = 20,
           query_every: int = 20, pivots: int = 256, block_rows: int = 4096) -> DataFrame:
    """Each query's k highest scores: query_id, rank (from 1), vec_id, score.

    Queries are the rows whose id is divisible by `query_every`, candidates all rows but the query's own
    id; the score is the inner product of the quantized vectors; ties go to the smaller id. A repeated
    query id is one query, with the smallest of its vectors; repeated candidate rows count as often as
    they are there. A query with fewer candidates gets all of them. Vectors that are null or empty or hold
    null or non-finite components take no part, nor do those of another length than most (of two equally
    frequent lengths, than the longer). A table without queries or candidates
    gives an empty result; other columns are ignored. Quantized components and scores are 64-bit integers:
    components of over about 1.4e17 in size saturate, and scores beyond 64 bits wrap around.

    The pivots (vectors picked by hash, one for half a block and at most `pivots`) and one row per cell
    are all that reaches the driver. Rows of a cell are dealt by their place in the table to blocks of
    about `block_rows`, and the queries that a cell is asked by to parts of about as many, so a group
    holds about that many rows of either side even where cells are wide, hot or full of copies; a block
    returns at most k rows per query.
    """
    ship_library(vectors.sparkSession)
    data = quantized(vectors, id_column, vector)
    lengths = data.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"))
    common = lengths.orderBy(F.desc("rows"), F.desc("n")).first()
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    if common is None:
        return vectors.sparkSession.createDataFrame([], schema)
    data = data.filter(F.size("v") == common["n"])
    pivots = max(1, min(pivots, 2 * common["rows"] // block_rows))
    some = (data.withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(pivots)
            .select("v").distinct().collect())
    centres = np.unique(np.array([r["v"] for r in some], float), axis=0)

    def assign():
        own = (centres ** 2).sum(axis=1)

        def work(batch: pa.RecordBatch):
            rows = matrix(batch.column(1)).astype(float)
            apart = own[None, :] - 2 * rows @ centres.T
            cell = apart.argmin(axis=1)
            away = np.sqrt(((rows - centres[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, pa.int32()), pa.array(away)], ["id", "v", "cell", "away"])
        return work

    placed = stored(arrow_pass(data, "id bigint, v array<bigint>, cell int, away double", assign)
                    .withColumn("row", F.monotonically_increasing_id()), "search-cells")
    counts, radii = np.zeros(len(centres), int), np.zeros(len(centres))
    for row in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect():
        counts[row["cell"]], radii[row["cell"]] = row["n"], row["r"]
    cells = Cells(centres, counts, radii)
    blocks = np.maximum(1, -(-counts // block_rows))
    of_cell = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), F.col("cell") + 1)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("row"), of_cell).cast("int")).drop("away", "row")
    # A repeated query row is one query in both passes; its own id is never a candidate.
    queries = stored(placed.filter(F.col("id") % query_every == 0).groupBy("id").agg(F.min("v").alias("v")),
                     "search-queries")

    def needed(batch: pa.RecordBatch, first: bool) -> tuple[np.ndarray, np.ndarray]:
        """Queries (by place in the batch) and the cells they need: at first the most promising cells that
        hold k others for sure, later every cell whose bound reaches the query's score to beat."""
        centre, bound = cells.promises(matrix(batch.column(1)))
        if not first:
            beat = np.array([-np.inf if x is None else x for x in batch.column(2).to_pylist()])
            return np.nonzero((bound >= beat[:, None]) & (cells.counts > 0)[None, :])
        order = np.argsort(-centre, axis=1, kind="stable")
        inside = np.cumsum(cells.counts[order], axis=1)
        row, place = np.nonzero(inside - cells.counts[order] < 2 * k + 1)
        return row, order[row, place]

    def tally(first: bool):
        """How many queries need each cell."""
        def make():
            def work(batch: pa.RecordBatch):
                cell, n = np.unique(needed(batch, first)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(n, pa.int64())],
                                                 ["cell", "n"])
            return work
        return make

    def route(first: bool, slice_rows: int = 8192):
        """Send queries to all blocks of the cells they need, a slice at a time."""
        def make():
            def work(batch: pa.RecordBatch):
                number, cell = needed(batch, first)
                ends = np.cumsum(blocks[cell])
                for start in range(0, int(ends[-1]) if len(ends) else 0, slice_rows):
                    copy = np.arange(start, min(start + slice_rows, ends[-1]))
                    at = np.searchsorted(ends, copy, side="right")
                    take = pa.array(number[at], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(i).take(take) for i in range(3)), pa.array(cell[at], pa.int32()),
                         pa.array(copy - ends[at] + blocks[cell[at]], pa.int32())],
                        ["id", "v", "floor", "cell", "block"])
            return work
        return make

    sent = "id bigint, v array<bigint>, floor bigint, cell int, block int"

    def solve(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found = [np.zeros((3, 0), np.int64)]
        if len(asked) and len(held):
            left, right = np.stack(asked["v"].to_numpy()), np.stack(held["v"].to_numpy())
            names, queries = held["id"].to_numpy(), asked["id"].to_numpy()
            floors = asked["floor"].astype(float).fillna(-np.inf).to_numpy()
            for start in range(0, len(left), 512):
                part = slice(start, start + 512)
                scores = products(left[part], right)
                fit = (scores >= floors[part, None]) & (names[None, :] != queries[part, None])
                row, column = np.nonzero(fit)
                row, best = best_of(row, scores[row, column], names[column], k)
                found.append(np.stack([queries[part][row], names[column[best]],
                                       scores[row, column[best]]]))
        query, name, score = np.concatenate(found, axis=1)
        return pd.DataFrame({"query_id": query, "vec_id": name, "score": score})

    def solved(asked: DataFrame, first: bool) -> DataFrame:
        parts = np.zeros(len(centres), int)
        for row in (arrow_pass(asked, "cell int, n bigint", tally(first))
                    .groupBy("cell").agg(F.sum("n").alias("n")).collect()):
            parts[row["cell"]] = -(-row["n"] // block_rows)
        in_parts = F.element_at(F.array(*[F.lit(int(n)) for n in parts]), F.col("cell") + 1)
        left = arrow_pass(asked, sent, route(first)).withColumn(
            "part", F.pmod(F.xxhash64("id", F.lit(2)), in_parts).cast("int"))
        right = placed.filter(in_parts > 0).withColumn("part", F.explode(F.sequence(F.lit(0), in_parts - 1)))
        keys = ["cell", "block", "part"]
        return (left.groupBy(*keys).cogroup(right.groupBy(*keys))
                .applyInPandas(solve, "query_id bigint, vec_id bigint, score bigint"))

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    trial = solved(queries.withColumn("floor", F.lit(None).cast("bigint")), True)
    floors = (trial.withColumn("rank", rank).filter(F.col("rank") == k)
              .select(F.col("query_id").alias("id"), F.col("score").alias("floor")))
    asked = queries.join(floors, "id", "left").select("id", "v", "floor")
    answers = solved(stored(asked, "search-floors"), False)
    return (answers.withColumn("rank", rank).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int"), "vec_id", "score"))
