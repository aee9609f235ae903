"""N-gram Jaccard join with Bayesian candidate pruning.

Documents that share a band of MinHash values meet; their signatures are compared a few values at a time
and a pair is dropped as soon as the posterior probability that its similarity reaches the threshold
falls below a tolerance. What is left is verified exactly on the shingle sets.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barlake.llm.common import (
    arrow_pass, connected_components, discard, forget_shuffles, ship_library, stored,
)
from barlake.llm.embedding_dedup import forest

BANDS, BAND_ROWS = 21, 3
VALUES, STEP = 96, 16
MIX = np.uint64(0x9E3779B97F4A7C15)
# Pairs whose signatures, and shingles whose owners, are looked at in one go; bounds memory.
PAIRS, SHINGLES = 100_000, 1_000_000
# Shingles of a tile's documents, on average; more of them make more tiles.
TILE_SHINGLES = 1_000_000


def multipliers(count: int, seed: int) -> np.ndarray:
    """Odd 64-bit numbers."""
    return np.random.default_rng(seed).integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of a word, remembered; emptied when it holds `most` words."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        import xxhash

        self.most, self.digest = most, xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.digest(word)
        return value


class Shingler:
    """Texts to sorted arrays of the 64-bit hashes of their distinct shingles."""

    def __init__(self, size: int):
        self.size, self.hashes = size, WordHashes()
        self.weights = multipliers(size, 1)

    def shingles(self, body: bytes) -> np.ndarray:
        """Runs of `size` words, A-Z in lower case; a shorter text is one shingle, an empty one none."""
        words = body.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        values = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        runs = max(len(words) - self.size + 1, 1)
        sums = np.full(runs, np.uint64(min(len(words), self.size)))
        for place in range(min(self.size, len(words))):
            sums += values[place:place + runs] * self.weights[place]
        return np.unique(scrambled(sums))


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash values, by multiply and shift; `shingles` must not be empty."""
    least = np.full(len(a), np.uint64(0xFFFFFFFFFFFFFFFF))
    for start in range(0, len(shingles), 2048):
        part = shingles[start:start + 2048, None] * a[None, :]
        part += b[None, :]
        np.minimum(least, part.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def least_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(n, m): after n values a pair with fewer than m matches is dropped.

    With a uniform prior the similarity after m matches of n is Beta(m + 1, n - m + 1) distributed, and
    the probability that it reaches t is that of at most m successes in n + 1 draws of chance t.
    """
    found = []
    for n in range(STEP, VALUES + 1, STEP):
        chance, m = 0.0, -1
        while chance < tolerance:
            m += 1
            chance += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        found.append((n, m))
    return found


def likely_pairs(left: np.ndarray, right: np.ndarray, same: bool, least: list[tuple[int, int]],
                 ) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of signatures that no step drops."""
    done, needed = least[0]
    counts = np.zeros((len(left), len(right)), np.uint8)
    for k in range(done):
        counts += left[:, k, None] == right[None, :, k]
    i, j = np.nonzero(counts >= needed)
    if same:
        i, j = i[i < j], j[i < j]
    kept = [later_steps(left, right, i[k:k + PAIRS], j[k:k + PAIRS], counts, least)
            for k in range(0, len(i), PAIRS)]
    return (np.concatenate([p for p, _ in kept]), np.concatenate([q for _, q in kept])) if kept else (i, j)


def later_steps(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, counts: np.ndarray,
                least: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that the steps after the first leave."""
    matches, done = counts[i, j].astype(int), least[0][0]
    for n, needed in least[1:]:
        if not len(i):
            break
        matches += (left[i, done:n] == right[j, done:n]).sum(axis=1)
        kept = matches >= needed
        i, j, matches, done = i[kept], j[kept], matches[kept], n
    return i, j


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sorted sets, one range of values after the other."""
    size, total = len(sets), np.zeros((len(sets), len(sets)), np.float32)
    parts = max(1, -(-sum(map(len, sets)) // SHINGLES))
    edges = [np.uint64((k << 64) // parts) for k in range(1, parts)]
    cuts = [[0, *np.searchsorted(s, np.array(edges, np.uint64)).tolist(), len(s)] for s in sets]
    for k in range(parts):
        total += common_within([s[cut[k]:cut[k + 1]] for s, cut in zip(sets, cuts)], size)
    return total


def common_within(sets: list[np.ndarray], size: int) -> np.ndarray:
    """The same for sets that are few enough, from the elements that several of them share."""
    every, owner = np.concatenate(sets), np.repeat(np.arange(size, dtype=np.int32), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, int)
    often = np.diff(np.append(first, len(every)))
    owner = owner[np.repeat(often > 1, often)]
    often = often[often > 1]
    number, ends = np.repeat(np.arange(len(often)), often), np.append(0, np.cumsum(often))
    total = np.zeros((size, size), np.float32)
    width = max(1, 4_000_000 // size)
    for start in range(0, len(often), width):
        low, high = ends[start], ends[min(start + width, len(often))]
        hot = np.zeros((size, min(width, len(often) - start)), np.float32)
        hot[owner[low:high], number[low:high] - start] = 1
        total += hot @ hot.T
    return total


def groups_of(frame: pd.DataFrame, keys: list[str]):
    """Row numbers of each group of a frame, by sorting once (cheaper than a groupby of many groups)."""
    columns = [frame[k].to_numpy() for k in keys]
    order = np.lexsort(columns[::-1])
    if not len(order):
        return
    changed = np.zeros(len(order) - 1, bool)
    for column in columns:
        changed |= column[order][1:] != column[order][:-1]
    for rows in np.split(order, np.flatnonzero(changed) + 1):
        yield rows


def tiled(df: DataFrame, group: str, size: str, node: str, tile_rows: int) -> DataFrame:
    """Deal the rows of a group to tiles of about `tile_rows` by hash, and to every pair of tiles: columns
    t0 <= t1 name the pair and `side` says which of the two a row belongs to."""
    tiles = F.ceil(F.col(size) / tile_rows).cast("int")
    own = F.pmod(F.xxhash64(node, F.lit(7)), tiles).cast("int")
    met = (df.withColumn("own", own)
           .withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1))))
    return (met.withColumn("t0", F.least("own", "other")).withColumn("t1", F.greatest("own", "other"))
            .withColumn("side", (F.col("own") > F.col("other")).cast("int")).drop("own", "other"))


def bundled(df: DataFrame, keys: list[str], rows: int = 8000) -> DataFrame:
    """Groups by hash into bundles, so that a call of a function gets many small groups at once."""
    bundles = max(12, df.count() // rows)
    return df.withColumn("bundle", F.pmod(F.xxhash64(*keys), F.lit(bundles)))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
                    keep: list[str] | None = None, words: int = 5, threshold: float = 0.8,
                    tolerance: float = 1e-6, tile_rows: int = 1024) -> DataFrame:
    """One row per document: the kept columns (the id by default), class_id, n_links, kept.

    Documents are linked when the Jaccard similarity of their sets of `words`-word shingles (A-Z in lower
    case) is at least `threshold`. n_links counts the other documents linked directly, class_id is the
    smallest id reachable by links, itself included, and `kept` holds for one document of each class,
    which has that id. Null and empty texts have no shingles and link with nothing; a text of fewer words
    is one shingle. Repeated rows are copies of each other, of which one is kept. A null id counts as
    larger than others. An empty table gives an empty one; other columns are ignored.

    Documents with the same shingles are one node with a weight. Bands of three values meet with a chance
    of over 1 - 1e-6 at the threshold. In a bucket, all pairs are compared locally and only a forest of
    the likely pairs leaves the task; a bucket with the same members as another is skipped. Within the
    clusters that these forests make, all pairs are verified exactly, again locally: a weighted number of
    links per node and a forest of links is what comes out. Buckets and clusters beyond `tile_rows` are
    cut into tiles that meet pair by pair.
    """
    spark = docs.sparkSession
    ship_library(spark)
    keep = [id_column] if keep is None else keep
    names = [f"__k{i}" for i in range(len(keep))]
    carried = ["id", *names]
    slim = docs.select(F.col(id_column).alias("id"), *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)],
                       *([] if text in keep else [F.col(text).alias("body")]))
    body_at = 1 + keep.index(text) if text in keep else len(carried)

    def sign():
        shingler = Shingler(words)
        a, b = multipliers(VALUES, 2), multipliers(VALUES, 3)
        import xxhash

        def work(batch: pa.RecordBatch):
            keys, signs, counts = [], [], []
            for body in batch.column(body_at).cast(pa.binary()).to_pylist():
                found = shingler.shingles(body or b"")
                keys.append(xxhash.xxh3_128_hexdigest(found) if len(found) else None)
                signs.append(signature(found, a, b).tobytes() if len(found) else None)
                counts.append(len(found))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(carried)], pa.array(keys, pa.string()), pa.array(signs, pa.binary()),
                 pa.array(counts, pa.int64())], [*carried, "node", "sign", "shingles"])
        return work

    schema = StructType(list(slim.select(*carried).schema.fields)).add("node", "string").add("sign", "binary").add(
        "shingles", "long")
    signed = stored(arrow_pass(slim, schema, sign).withColumn("row", F.monotonically_increasing_id()),
                    "join-signed")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row")))
    nodes = stored(signed.filter("node is not null").groupBy("node")
                   .agg(first.alias("first"), F.count("*").alias("copies"), F.max("shingles").alias("shingles"))
                   .select("node", "copies", "shingles", "first.none", "first.id", "first.row"), "join-nodes")
    signs = stored(signed.select("row", "sign").join(nodes.select("row", "node"), "row")
                   .select("node", "sign"), "join-signs")

    verify_rows = min(tile_rows, 512)

    # Buckets of nodes with the same band; of buckets with the same members one is enough.
    def bands():
        weights = multipliers(BAND_ROWS, 4)

        def work(batch: pa.RecordBatch):
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, VALUES)
            parts = values[:, :BANDS * BAND_ROWS].reshape(-1, BANDS, BAND_ROWS).astype(np.uint64)
            keys = (parts * weights).sum(axis=2, dtype=np.uint64)
            keys = scrambled(keys + np.arange(1, BANDS + 1, dtype=np.uint64) * MIX)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel().view(np.int64)),
                 batch.column(0).take(pa.array(np.repeat(np.arange(len(values)), BANDS)))],
                ["bucket", "node"])
        return work

    met = arrow_pass(signs, "bucket bigint, node string", bands)
    buckets = (met.groupBy("bucket").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("s"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x"))
        .filter("n > 1").groupBy("n", "s", "x").agg(F.min("bucket").alias("bucket")))
    members = stored(met.join(buckets.select("bucket", "n"), "bucket"), "join-members")
    least = least_matches(threshold, tolerance)

    def candidates(frame: pd.DataFrame) -> pd.DataFrame:
        values = np.frombuffer(b"".join(frame["sign"]), np.uint32).reshape(-1, VALUES)
        names, sides = frame["node"].to_numpy(), frame["side"].to_numpy()
        tile = frame["t0"].to_numpy() == frame["t1"].to_numpy()
        edges = []
        for rows in groups_of(frame, ["bucket", "t0", "t1"]):
            same = bool(tile[rows[0]])
            one = rows if same else rows[sides[rows] == 0]
            two = one if same else rows[sides[rows] == 1]
            i, j = likely_pairs(values[one], values[two], same, least)
            edges += forest(names[one][i], names[two][j])
        return pd.DataFrame(edges, columns=["a", "b"], dtype=object)

    dealt = tiled(members, "bucket", "n", "node", tile_rows)
    likely = (bundled(dealt, ["bucket", "t0", "t1"]).join(signs, "node").groupBy("bundle")
              .applyInPandas(candidates, "a string, b string"))
    clusters = stored(connected_components(likely, "join-clusters", forget=True), "join-clustered")
    discard(members, signs)
    forget_shuffles(spark)
    # A cluster counts as larger if its documents are long, so that its tiles hold bounded sets.
    clustered = clusters.join(nodes, "node")
    sizes = clustered.groupBy("component").agg(F.greatest(
        F.count("*"), F.ceil(F.sum("shingles") * verify_rows / TILE_SHINGLES)).alias("n"))
    clustered = clustered.drop("shingles").join(sizes, "component")

    # Shingles of the clustered nodes: a semi-join on their ids picks the rows worth reading again.
    def again():
        shingler = Shingler(words)
        import xxhash

        def work(batch: pa.RecordBatch):
            keys, sets = [], []
            for body in batch.column(0).cast(pa.binary()).to_pylist():
                found = shingler.shingles(body)
                if len(found):
                    keys.append(xxhash.xxh3_128_hexdigest(found))
                    sets.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sets, pa.binary())],
                                             ["node", "shingles"])
        return work

    texts = docs.select(F.col(id_column).alias("id"), F.col(text).alias("body")).filter("body is not null")
    asked = clustered.select(F.col("id").alias("asked")).distinct()
    texts = texts.join(asked, F.col("id").eqNullSafe(F.col("asked")), "left_semi").select("body")
    read_again = arrow_pass(texts, "node string, shingles binary", again)
    held = stored(read_again.join(clustered.select("node", "component", "n", "copies"), "node")
                  .groupBy("node", "component", "n", "copies").agg(F.first("shingles").alias("shingles")),
                  "join-shingles")
    forget_shuffles(spark)
    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.uint64) for x in frame["shingles"]]
        names, weight = frame["node"].to_numpy(), frame["copies"].to_numpy()
        sides, counts = frame["side"].to_numpy(), np.array([len(s) for s in sets])
        tile = frame["t0"].to_numpy() == frame["t1"].to_numpy()
        out = []
        for rows in groups_of(frame, ["component", "t0", "t1"]):
            common = common_counts([sets[k] for k in rows])
            either = counts[rows][:, None] + counts[rows][None, :] - common
            linked = common >= threshold * either - 1e-9
            if tile[rows[0]]:
                i, j = np.nonzero(np.triu(linked, 1))
            else:
                i, j = np.nonzero(linked & (sides[rows][:, None] < sides[rows][None, :]))
            if not len(i):
                continue
            degree = (np.bincount(i, weight[rows][j], len(rows))
                      + np.bincount(j, weight[rows][i], len(rows))).astype(int)
            out += [(names[k], None, d) for k, d in zip(rows, degree.tolist()) if d]
            out += [(a, b, 0) for a, b in forest(names[rows][i], names[rows][j])]
        return pd.DataFrame(out, columns=["a", "b", "links"]).astype({"links": "int64"})

    tiles = tiled(held, "component", "n", "node", verify_rows)
    found = stored(bundled(tiles, ["component", "t0", "t1"], 1000).groupBy("bundle")
                   .applyInPandas(verify, "a string, b string, links bigint"), "join-links")
    discard(held, clusters)
    forget_shuffles(spark)
    links = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    classes = connected_components(found.filter("b is not null").select("a", "b"), "join-classes", forget=True)
    placed = (nodes.join(classes, "node", "left").join(links, "node", "left")
              .withColumn("component", F.coalesce("component", "node")))
    heads = placed.groupBy("component").agg(
        F.min(F.struct("none", "id", "row")).alias("head"))
    known = placed.join(heads, "component").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.col("head.id").alias("class_id"), F.col("head.row").alias("head_row"))
    joined = signed.drop("sign", "shingles").join(known, "node", "left")
    alone = F.col("n_links").isNull()
    return joined.select(
        *[F.col(n).alias(c) for c, n in zip(keep, names)],
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        (alone | (F.col("row") == F.col("head_row"))).alias("kept"))
