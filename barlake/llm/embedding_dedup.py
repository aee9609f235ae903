"""Near-duplicate embeddings: PCA-ordered tiled comparison.

Vectors are turned so that leading dimensions carry most of the variance. Tiles of vectors that lie near
each other there are compared dimension block by dimension block: what the remaining dimensions can
still add is bounded by the norms of the remaining parts, and a pair is dropped once its cosine cannot
reach the threshold.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import arrow_pass, connected_components, discard, ship_library, stored

# Dimensions compared before each check of the bound.
STEPS = (8, 16, 32, 64, 128, 256, 512, 1024, 4096, 1 << 30)


def turned_axes(reps: DataFrame) -> dict[int, np.ndarray]:
    """Per vector length, the axes of the unit vectors' second moments, strongest first (as columns).

    Each task adds up its own moments; sums per matrix entry are the only thing that is gathered.
    """
    def make():
        def work(batch: pa.RecordBatch):
            sums: dict[int, np.ndarray] = {}
            for x in batch.column(0).to_pylist():
                unit = unit_rows(np.array([x]))[0]
                sums.setdefault(len(x), []).append(unit)
            for size, rows in sums.items():
                both = np.array(rows)
                moments = both.T @ both
                yield pa.RecordBatch.from_arrays(
                    [pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()),
                     pa.array(list(moments), pa.list_(pa.float64()))], ["size", "i", "row"])
        return work

    parts = arrow_pass(reps.select("x"), "size int, i int, row array<double>", make, rows=5000)
    lines = (parts.select("size", "i", F.posexplode("row").alias("j", "value"))
             .groupBy("size", "i", "j").agg(F.sum("value").alias("value"))
             .groupBy("size", "i").agg(F.array_sort(F.collect_list(F.struct("j", "value"))).alias("row"))
             .select("size", "i", F.col("row.value").alias("row")).collect())  # one matrix per vector length
    axes: dict[int, np.ndarray] = {}
    for line in lines:
        axes.setdefault(line["size"], np.zeros((line["size"],) * 2))[line["i"]] = line["row"]
    return {size: np.linalg.eigh((m + m.T) / 2)[1][:, ::-1] for size, m in axes.items()}


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of norm 1; scaled first, so that neither large nor small components overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def linked_pairs(left: np.ndarray, right: np.ndarray, axes: np.ndarray, least: float, same: bool,
                 ) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of unit rows with a cosine of at least `least`; each pair once if `same`."""
    a, b = left @ axes, right @ axes
    size = a.shape[1]
    done = min(STEPS[0], size)
    rest = [np.sqrt(np.maximum((m * m)[:, ::-1].cumsum(axis=1)[:, ::-1], 0)) for m in (a, b)]
    sums = a[:, :done] @ b[:, :done].T
    slack = 1e-9
    bound = sums if done == size else sums + np.outer(rest[0][:, done], rest[1][:, done])
    i, j = np.nonzero(bound >= least - slack)
    if same:
        i, j = i[i < j], j[i < j]
    sums = sums[i, j]
    for step in STEPS[1:]:
        if done == size or not len(i):
            break
        step = min(step, size)
        keep_i, keep_j, keep_s = [], [], []
        for start in range(0, len(i), 200_000):
            p, q = i[start:start + 200_000], j[start:start + 200_000]
            s = sums[start:start + 200_000] + np.einsum("nd,nd->n", a[p, done:step], b[q, done:step])
            more = s if step == size else s + rest[0][p, step] * rest[1][q, step]
            kept = more >= least - slack
            keep_i.append(p[kept])
            keep_j.append(q[kept])
            keep_s.append(s[kept])
        i, j, sums, done = np.concatenate(keep_i), np.concatenate(keep_j), np.concatenate(keep_s), step
    sure = [np.einsum("nd,nd->n", left[i[s:s + 200_000]], right[j[s:s + 200_000]]) >= least
            for s in range(0, len(i), 200_000)]
    kept = np.concatenate(sure) if sure else np.zeros(0, bool)
    return i[kept], j[kept]


def forest(i: np.ndarray, j: np.ndarray) -> list[tuple]:
    """Edges that connect what the given edges connect, at most one less than there are nodes."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    for a, b in zip(i.tolist(), j.tolist()):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            edges.append((a, b))
    return edges


def near_duplicates(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding",
                    label: str = "label", least: float = 0.98, tile_rows: int = 1024) -> DataFrame:
    """One row per vector: the id, n_links, component_id and kept.

    Vectors of equal, non-null label are linked when their cosine in double precision is at least
    `least`. n_links counts the other rows linked directly, component_id is the smallest id reachable by
    links, and kept says that the row's id is that one. Vectors that are null, empty or zero, hold null
    or non-finite components or have no label link with nothing, nor do vectors of different length. An
    id stands for one vector; its repeated rows are copies and linked as such. A null id counts as larger
    than any other: rows without one are linked and counted like the rest, and component_id is null where
    no linked vector has an id. An empty table gives an empty one; other columns are ignored.

    Equal vectors are compared once, with their number as weight, under a number of their own. Cells are as wide in the two leading
    dimensions as two linked vectors can be apart, so that a vector meets those of its own and of
    neighbouring cells only; cells with many vectors are cut into tiles that meet pair by pair. A tile
    pair returns a weighted number of links per vector and a forest of its links, never all of them.
    """
    ship_library(vectors.sparkSession)
    x = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(id_column).alias("id"), F.col(label).alias("label"), x.alias("x"))
    valid = (F.col("label").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)
             & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
             & F.exists("x", lambda c: c != 0))
    rows = stored(rows.withColumn("valid", F.coalesce(valid, F.lit(False))), "dedup-rows")
    reps = stored(rows.filter("valid").groupBy("label", "x")
                  .agg(F.min("id").alias("least"), F.count("*").alias("copies"))
                  .withColumn("rep", F.monotonically_increasing_id()), "dedup-reps")
    axes = turned_axes(reps)
    width = float(np.sqrt(2 - 2 * least)) * (1 + 1e-9) + 1e-12

    def place():
        def work(batch: pa.RecordBatch):
            xs = batch.column(1).to_pylist()
            cells = []
            for row in xs:
                turned = unit_rows(np.array([row]))[0] @ axes[len(row)][:, :2]
                cell = np.floor(turned / width).astype(int).tolist()
                cells.append((cell + [0])[:2])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([c[0] for c in cells], pa.int32()),
                 pa.array([c[1] for c in cells], pa.int32())], ["label", "x", "rep", "copies", "u", "v"])
        return work

    label_type = reps.schema["label"].dataType.simpleString()
    spots = stored(arrow_pass(
        reps.select("label", "x", "rep", "copies"),
        f"label {label_type}, x array<double>, rep bigint, copies bigint, u int, v int", place), "dedup-cells")
    placed = spots.withColumn("dim", F.size("x"))

    # Tiles per cell, so that every cell knows how many its neighbours have.
    cell = ["label", "dim", "u", "v"]
    tiles = (placed.groupBy(*cell).agg(F.count("*").alias("n"))
             .withColumn("tiles", F.ceil(F.col("n") / tile_rows).cast("int")).drop("n"))
    homes = (placed.join(tiles, cell)
             .withColumn("tile", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("tiles")).cast("int")))
    # A pair of cells is named by the first and the step to the second; a vector is on side 0 of the
    # pairs its cell begins and on side 1 of those it ends. Every tile of one side meets every other's.
    steps = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]
    other = tiles.select("label", "dim", F.col("u").alias("ou"), F.col("v").alias("ov"),
                         F.col("tiles").alias("others"))
    begins = homes.withColumn("step", F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps])))
    sides = []
    for side, sign in ((0, 1), (1, -1)):
        moved = begins if side == 0 else begins.filter("step.a <> 0 or step.b <> 0")
        moved = (moved.withColumn("ou", F.col("u") + sign * F.col("step.a"))
                 .withColumn("ov", F.col("v") + sign * F.col("step.b")))
        met = moved.join(other, ["label", "dim", "ou", "ov"])  # neighbours without vectors go
        first = (F.col("u"), F.col("v")) if side == 0 else (F.col("ou"), F.col("ov"))
        own = (F.col("step.a") == 0) & (F.col("step.b") == 0)
        met = met.withColumn("meets", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
        mine, theirs = ("tile", "meets") if side == 0 else ("meets", "tile")
        sides.append(met.select(
            "label", "dim", first[0].alias("fu"), first[1].alias("fv"),
            F.col("step.a").alias("sa"), F.col("step.b").alias("sb"),
            # Within one cell, tiles meet in order; a tile is side 0 of the pair it is the smaller of.
            F.when(own, F.least("tile", "meets")).otherwise(F.col(mine)).alias("t0"),
            F.when(own, F.greatest("tile", "meets")).otherwise(F.col(theirs)).alias("t1"),
            F.when(own, (F.col("tile") > F.col("meets")).cast("int")).otherwise(F.lit(side)).alias("side"),
            "rep", "copies", "x"))
    met = sides[0].unionByName(sides[1])

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        one, two = frame[frame["side"] == 0], frame[frame["side"] == 1]
        first = frame.iloc[0]
        same = (first["sa"], first["sb"]) == (0, 0) and first["t0"] == first["t1"]
        if same:
            two = one
        if not len(one) or not len(two):
            return pd.DataFrame({"a": [], "b": [], "links": []})
        a = unit_rows(np.stack(one["x"].to_numpy()))
        b = a if same else unit_rows(np.stack(two["x"].to_numpy()))
        i, j = linked_pairs(a, b, axes[a.shape[1]], least, same)
        names = [one["rep"].to_numpy(), two["rep"].to_numpy()]
        weight = [one["copies"].to_numpy(), two["copies"].to_numpy()]
        left = np.bincount(i, weight[1][j], len(one)).astype(int)
        right = np.bincount(j, weight[0][i], len(two)).astype(int)
        edges = forest(names[0][i], names[1][j])
        out = [pd.DataFrame({"a": names[0][left > 0], "b": None, "links": left[left > 0]}),
               pd.DataFrame({"a": names[1][right > 0], "b": None, "links": right[right > 0]}),
               pd.DataFrame({"a": [e[0] for e in edges], "b": [e[1] for e in edges], "links": 0})]
        return pd.concat([x for x in out if len(x)]) if any(map(len, out)) else out[0]

    found = stored(met.groupBy("label", "dim", "fu", "fv", "sa", "sb", "t0", "t1").applyInPandas(
        compare, "a bigint, b bigint, links bigint"), "dedup-links")
    discard(spots)
    links = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    components = connected_components(found.filter("b is not null").select("a", "b"), "dedup-components")
    known = (reps.join(links, "rep", "left")
             .join(components.withColumnRenamed("node", "rep"), "rep", "left")
             .select("label", "x", "copies", "least", F.coalesce("links", F.lit(0)).alias("links"), "component"))
    heads = known.filter("component is not null").groupBy("component").agg(F.min("least").alias("head"))
    known = known.join(heads, "component", "left").select(
        "label", "x", "copies", "links",
        F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("head")).alias("component"))
    joined = (rows.filter("valid").join(known, ["label", "x"])
              .select("id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component"))
    alone = rows.filter("not valid").select("id", F.lit(0).cast("bigint").alias("n_links"),
                                            F.col("id").alias("component"))
    return joined.unionByName(alone).select(
        F.col("id").alias(id_column), "n_links", F.col("component").alias("component_id"),
        (F.col("id").eqNullSafe(F.col("component"))).alias("kept"))
