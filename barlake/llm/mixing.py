"""Mixing sources to target weights: subset-sum budget fitting.

Documents are counted by exact length. Each source's budget is filled with whole repeats of all its
documents, then with the same share of every length but for a few, and what is left is fitted by a
bounded-knapsack dynamic programme over the lengths that still have documents. Which documents of a length are taken
follows a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.llm.common import WORD, ship_library, stored

MOST_TIMES = 3


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def cyclic_weights(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Add `weight` to a frame with a `source` per row: the cycle in code-point order, null last."""
    ranked = sources.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex()
    names = sources.columns
    rows = ranked.map(lambda pair: (*pair[0], cycle[pair[1] % len(cycle)]))
    schema = sources.select(*names, F.lit(0).alias("weight")).schema
    return sources.sparkSession.createDataFrame(rows, schema)


def with_targets(sources: DataFrame, most_times: int = MOST_TIMES) -> DataFrame:
    """Add `target` to (source, source_size, weight): the sizes' sum shared by weight, but nowhere above
    `most_times` the source's size; the excess is shared again by weight until no target is above.

    Each round fixes the sources that are above and shares the rest among the others; only sums reach
    the driver. There are at most as many rounds as sources, and in practice a few.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    limit = F.col("source_size") * most_times
    share, fixed = F.lit(0.0), -1
    state = sources.withColumn("__full", F.lit(False))
    while True:
        sums = state.agg(
            F.sum(F.when(F.col("__full"), limit)).alias("held"),
            F.sum(F.when(~F.col("__full"), F.col("weight"))).alias("weights"),
            F.count(F.when(F.col("__full"), 1)).alias("full")).first()
        if sums["full"] == fixed or not sums["weights"]:
            break
        fixed = sums["full"]
        share = F.lit(float(total - (sums["held"] or 0)) / float(sums["weights"]))
        state = sources.withColumn("__full", F.col("weight") * share >= limit)
    target = F.when(F.col("__full"), limit.cast("double")).otherwise(F.col("weight") * share)
    return state.withColumn("target", target.cast("double")).drop("__full")


# Documents of each length that are given back for the programme to choose from, and sums it looks at at least.
GIVEN_BACK, LEAST_WINDOW = 8, 50_000


def fit_budget(lengths: list[int], counts: list[int], budget: float) -> list[int]:
    """How many documents of each length to take so that their lengths' sum comes closest to the budget.

    First the same share of each length, but for a few documents; the rest by dynamic programming over the
    reachable sums. The programme works with the shortest lengths that hold twice the rest, so a length far
    above the others does not widen its sums: it is taken first if the others cannot fill the rest. Of
    two equally near sums the smaller is taken.
    """
    whole = sum(n * c for n, c in zip(lengths, counts))
    if whole == 0 or budget <= 0:
        return [0] * len(lengths)
    share = min(budget / whole, 1.0)
    taken = [max(int(c * share) - GIVEN_BACK, 0) for c in counts]
    rest = budget - sum(n * t for n, t in zip(lengths, taken))
    left = [c - t for c, t in zip(counts, taken)]
    order = sorted(range(len(lengths)), key=lambda i: lengths[i])
    room, programme = 0, []
    for i in order:
        programme.append(i)
        room += left[i] * lengths[i]
        if room >= 2 * rest + LEAST_WINDOW:
            break
    longest = lengths[programme[-1]]
    window = max(4 * longest, LEAST_WINDOW)
    for i in reversed(programme):  # long to short, down to a rest that the programme fits exactly
        if rest <= window:
            break
        more = min(left[i], int((rest - window) // lengths[i]))
        if more > 0:
            taken[i] += more
            left[i] -= more
            rest -= more * lengths[i]
    goal = max(int(round(rest)), 0)
    top = goal + longest
    bits, first = 1, np.full(top + 1, -1, np.int32)  # first: the place in `used` that first reaches a sum
    used = []
    mask = (1 << (top + 1)) - 1
    for i in programme:
        if lengths[i] > top or not left[i] or bits >> goal & 1:
            continue
        before, most, step = bits, min(left[i], top // lengths[i]), 1
        while most > 0:  # binary splitting of the bounded count
            part = min(step, most)
            bits |= bits << part * lengths[i] & mask
            most -= part
            step *= 2
        new = np.frombuffer((bits & ~before).to_bytes(top // 8 + 1, "little"), np.uint8)
        first[np.flatnonzero(np.unpackbits(new, bitorder="little")[:top + 1])] = len(used)
        used.append(i)
    best = min((abs(s - rest), s) for s in (_at_most(bits, goal), _at_least(bits, goal)) if s >= 0)[1]
    while best:
        at = first[best]
        while first[best] == at:
            taken[used[at]] += 1
            best -= lengths[used[at]]
    return taken


def _at_most(bits: int, goal: int) -> int:
    return (bits & (1 << goal + 1) - 1).bit_length() - 1


def _at_least(bits: int, goal: int) -> int:
    above = bits >> goal
    return goal + (above & -above).bit_length() - 1 if above else -1


def units_of(docs: DataFrame, id_column: str, text: str, source: str, *more: str) -> DataFrame:
    """Every row's id, source, size and `mark`, a hash of its text: rows that share all four are alike."""
    return docs.select(*more, F.col(id_column).alias("id"), F.col(source).alias("source"),
                       word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("mark"))


def mix(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source",
        seed: int = 7, most_times: int = MOST_TIMES, bucket_rows: int = 100_000) -> DataFrame:
    """How often the mix takes each document: id, source, size, mark, rows, source_size, target, times, more.

    Rows are documents of their own length; those alike in id, source, size and text (`mark` is its hash)
    are one line, `rows` says how many there are. Each of them is taken `times` times, and `more` of them
    once more; nothing is taken over `most_times` times. Null sources are one source, null texts have
    size 0. A document without words is taken once per whole repeat. An empty table gives an empty one;
    other columns are ignored; runs agree.

    Nothing but ids, sizes and hashes is shuffled. The lines of a length are split by hash into buckets,
    all but one of which are taken or left whole; their number follows the table, so that even a length
    that holds all documents has buckets of about `bucket_rows` lines, and no more than that is ever
    ranked together. Of a line with many rows only their number counts.
    """
    ship_library(docs.sparkSession)
    units = stored(units_of(docs, id_column, text, source).groupBy("id", "source", "size", "mark")
                   .agg(F.count("*").alias("rows")), "mix-units")
    buckets = 64 + units.count() // bucket_rows
    units = (units.withColumn("order", F.xxhash64(F.lit(seed), F.col("id").cast("string"), "mark"))
             .withColumn("bucket", F.pmod(F.xxhash64("order", F.lit(seed)), F.lit(buckets))))
    sources = stored(units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size")),
                     "mix-sources")
    sources = stored(with_targets(cyclic_weights(sources), most_times), "mix-targets")

    # Documents per source, length and bucket; then per length; the fit works on lengths alone.
    per_bucket = stored(units.groupBy("source", "size", "bucket").agg(F.sum("rows").alias("n")), "mix-buckets")
    per_length = per_bucket.groupBy("source", "size").agg(F.sum("n").alias("n"))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        size, target = int(frame["source_size"].iloc[0]), float(frame["target"].iloc[0])
        lengths, counts = frame["size"].astype(int).tolist(), frame["n"].astype(int).tolist()
        repeats = min(int(target // size), most_times) if size else 1
        some = [k for k, length in enumerate(lengths) if length]
        extra = [0] * len(lengths)
        if some and repeats < most_times:
            for k, n in zip(some, fit_budget([lengths[k] for k in some], [counts[k] for k in some],
                                             target - repeats * size)):
                extra[k] = n
        return pd.DataFrame({"source": frame["source"], "size": lengths, "repeats": repeats,
                             "extra": extra, "source_size": size, "target": target})

    same = F.col("l.source").eqNullSafe(F.col("s.source"))
    fitted = (per_length.alias("l").join(sources.alias("s"), same)
              .select("l.source", "l.size", "l.n", "s.source_size", "s.target")
              .groupBy("source").applyInPandas(
                  fit, f"source {docs.schema[source].dataType.simpleString()}, size bigint, "
                       "repeats bigint, extra bigint, source_size bigint, target double"))
    fitted = stored(fitted, "mix-fit")

    # How many documents of each bucket of a length are taken: all, none, or in one bucket some.
    before = F.sum("n").over(Window.partitionBy("source", "size").orderBy("bucket")) - F.col("n")
    cut = per_bucket.withColumn("before", before)
    cut = (cut.alias("b").join(fitted.alias("f"), F.col("b.source").eqNullSafe(F.col("f.source"))
                               & (F.col("b.size") == F.col("f.size")))
           .select("b.source", "b.size", "b.bucket", "f.repeats", "f.source_size", "f.target",
                   F.least(F.greatest(F.col("f.extra") - F.col("b.before"), F.lit(0)),
                           F.col("b.n")).alias("quota")))
    upto = F.sum("rows").over(Window.partitionBy("source", "size", "bucket").orderBy("order", "id", "mark")
                              .rowsBetween(Window.unboundedPreceding, 0))
    return (units.withColumn("before", upto - F.col("rows")).alias("u")
            .join(cut.alias("c"), F.col("u.source").eqNullSafe(F.col("c.source"))
                  & (F.col("u.size") == F.col("c.size")) & (F.col("u.bucket") == F.col("c.bucket")))
            .select(F.col("u.id").alias(id_column), F.col("u.source").alias(source), "u.size", "u.mark",
                    "u.rows", "c.source_size", "c.target", F.col("c.repeats").alias("times"),
                    F.least(F.greatest(F.col("c.quota") - F.col("u.before"), F.lit(0)), F.col("u.rows"))
                    .alias("more")))


def mixed_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
                    source: str = "source", share_rows: int = 10_000, **options) -> DataFrame:
    """The mix itself: every document as many times as `mix` takes it, with all its columns.

    Where some but not all rows that are alike are taken once more, those rows are dealt to shares of about
    `share_rows`, which are taken in turn, so that no task ranks them all.
    """
    chosen = mix(docs, id_column, text, source, **options).filter("times > 0 or more > 0").select(
        F.col(id_column).alias("__id"), F.col(source).alias("__source"), F.col("size").alias("__size"),
        F.col("mark").alias("__mark"), F.col("rows").alias("__rows"), F.col("times").alias("__times"),
        F.col("more").alias("__more"))
    kept = [F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(docs.columns)]
    sized = units_of(docs, id_column, text, source, *kept)
    joined = sized.join(chosen, sized["id"].eqNullSafe(F.col("__id")) & sized["source"].eqNullSafe(F.col("__source"))
                        & (F.col("size") == F.col("__size")) & (F.col("mark") == F.col("__mark")))
    split = (F.col("__more") > 0) & (F.col("__more") < F.col("__rows"))
    plain = joined.filter(~split).withColumn("__taken", F.col("__times") + (F.col("__more") > 0).cast("bigint"))
    # A row's place among the rows alike: the rows of the shares before its own, and its place in its share.
    shares = F.ceil(F.col("__rows") / share_rows)
    key = ["__id", "__source", "__size", "__mark"]
    parts = stored(joined.filter(split).withColumn(
        "__share", F.pmod(F.xxhash64(F.monotonically_increasing_id()), shares)), "mix-split")
    sizes = parts.groupBy(*key, "__share").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*key).orderBy("__share")) - F.col("__n")
    sizes = sizes.withColumn("__before", before)
    place = F.row_number().over(Window.partitionBy(*key, "__share").orderBy(F.lit(1)))
    ranked = parts.withColumn("__place", place).alias("p").join(
        sizes.drop("__n").alias("s"), F.col("p.__id").eqNullSafe(F.col("s.__id"))
        & F.col("p.__source").eqNullSafe(F.col("s.__source")) & (F.col("p.__size") == F.col("s.__size"))
        & (F.col("p.__mark") == F.col("s.__mark")) & (F.col("p.__share") == F.col("s.__share")))
    some = ranked.withColumn("__taken", F.col("__times") + (
        F.col("__before") + F.col("__place") <= F.col("__more")).cast("bigint"))
    names = [f"__c{i}" for i in range(len(docs.columns))]
    every = plain.select(*names, "__taken").unionByName(some.select(*[F.col(f"p.{n}") for n in names], "__taken"))
    return (every.filter("__taken > 0").withColumn(
        "__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__taken"))))
        .select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)]))
