"""Quality classification: hierarchical empirical Bayes.

A classifier on a document's own text gives evidence. Evidence and labels are added up per site and per
path of a site; a path's rate is shrunk towards its site's and a site's towards the rate of all documents,
the more the fewer documents it has. How strongly is estimated from the spread between sites themselves.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import WORD, stored


def features(text: Column) -> list[Column]:
    """What the classifier sees of a text, each about 0 to 1; built-in functions only."""
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.greatest(F.regexp_count(text, F.lit(WORD)), F.lit(1)).cast("double")

    def share(pattern: str, of: Column) -> Column:
        return F.least(F.regexp_count(text, F.lit(pattern)) / of, F.lit(1.0))

    parts = F.split(text, r"[\x20\x09-\x0D]+")
    return [
        share(r"\p{L}", chars), share(r"\p{Lu}", chars), share(r"[0-9]", chars),
        share(r"[^\p{L}\p{N}\s.,;:'\"()-]", chars), share(r"[.!?]", words), share(r",", words),
        share(r"\|", words), share(r"([#$%&*!])\1+", words), share(r"\n", words),
        F.least(F.size(F.array_distinct(parts)) / words, F.lit(1.0)),
        F.least(chars / words / 12, F.lit(1.5)), F.log1p(words) / 10,
    ]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Weights (the last for the constant) by Newton's method with a ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    weights = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (y - p) - ridge * len(y) * weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.eye(len(weights))
        move = np.linalg.solve(curve, gradient)
        weights += move
        if np.abs(move).max() < 1e-8:
            break
    return weights


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def squashed(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def strength(groups: DataFrame, rate: str, n: str, around: str, floor: float, most: float) -> float:
    """How many documents a prior is worth: the ratio of the variance expected inside groups to that
    between their true rates, by the method of moments over all groups."""
    inside = F.col(around) * (1 - F.col(around))
    row = groups.filter(f"{n} > 1").agg(
        F.sum(F.col(n) * (F.col(rate) - F.col(around)) ** 2).alias("spread"),
        F.sum(inside).alias("inside"), F.sum(F.col(n) * inside).alias("weighted"),
        F.sum(n).alias("n")).first()
    if not row["n"]:
        return most
    between = max(row["spread"] - row["inside"], 0.0) / row["n"]
    within = row["weighted"] / row["n"]
    return float(min(max(within / between if between > 0 else most, floor), most))


def classify(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text",
             host: Column | None = None, path: Column | None = None, label: str = "quality",
             label_id: str = "doc_id", keep: list[str] | None = None, sample_rows: int = 20_000,
             threshold: float = 0.5) -> DataFrame:
    """Every document's posterior probability of quality: the kept columns (the id by default), evidence
    (the classifier's own probability), host_rate, path_rate, probability and kept (at least `threshold`).

    `host` and `path` say which site and which path of it a document is from (the source, and its language
    within the source, by default); nulls are a site and a path of their own. The classifier learns from
    at most `sample_rows` labelled documents, picked by hash; sums per path and site cover all documents,
    and count a labelled one by its label. A path's rate is (its sum + s2 * its site's rate) /
    (its documents + s2), a site's the same towards the rate of all with s1; s1 and s2 follow from the
    spread between sites and between paths. The probability moves the evidence by the path's log odds
    over those of all documents.

    Null labels do not count; of several labels of an id their mean does. A null or empty text is no
    document of quality: probability 0 and not kept. With no usable label, or labels all alike, evidence
    is the share of good labels (1 without any). Repeated rows each count and get the same result; an
    empty table gives an empty one; other columns are ignored.
    """
    keep = [id_column] if keep is None else keep
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    names = [f"__k{i}" for i in range(len(keep))]
    body = F.coalesce(F.col(text), F.lit(""))
    measured = stored(docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(id_column).alias("__id"),
        host.cast("string").alias("__host"), path.cast("string").alias("__path"),
        F.regexp_like(body, F.lit(WORD)).alias("__some"),
        F.array(*[f.cast("double") for f in features(body)]).alias("__x")), "quality-features")
    judged = (labels.filter(F.col(label).isNotNull() & F.col(label_id).isNotNull())
              .groupBy(F.col(label_id).alias("__label_id")).agg(F.avg(F.col(label)).alias("__y")))
    labelled = stored(measured.join(judged, F.col("__id") == F.col("__label_id"), "left")
                      .drop("__label_id"), "quality-labelled")

    usable = labelled.filter("__y is not null and __some")
    known = usable.count()
    part = min(1.0, sample_rows / known) if known else 0.0
    picked = F.pmod(F.xxhash64(F.col("__id").cast("string"), F.lit(9)), F.lit(1_000_000))
    sample = usable.filter(picked < int(part * 1_000_000)).select("__x", "__y").limit(sample_rows).collect()
    y = np.array([r["__y"] for r in sample])
    if len(y) and 0 < y.mean() < 1:
        weights = fit_logistic(np.array([r["__x"] for r in sample]), y)
        score = F.lit(float(weights[-1]))
        for k, w in enumerate(weights[:-1]):
            score = score + F.col("__x")[k] * float(w)
        evidence = squashed(F.least(F.greatest(score, F.lit(-12.0)), F.lit(12.0)))
    else:
        evidence = F.lit(float(y.mean()) if len(y) else 1.0)
        evidence = F.least(F.greatest(evidence, F.lit(1e-5)), F.lit(1 - 1e-5))
    scored = labelled.withColumn("__e", evidence)
    counted = F.when(F.col("__some"), F.coalesce("__y", "__e"))

    paths = stored(scored.groupBy("__host", "__path").agg(
        F.sum(counted).alias("good"), F.count(counted).alias("n")), "quality-paths")
    hosts = paths.groupBy("__host").agg(F.sum("good").alias("hgood"), F.sum("n").alias("hn"))
    whole = paths.agg(F.sum("good"), F.sum("n")).first()
    base = min(max((whole[0] or 0.0) / whole[1], 1e-4), 1 - 1e-4) if whole[1] else 0.5
    hosts = hosts.withColumn("raw", F.when(F.col("hn") > 0, F.col("hgood") / F.col("hn")).otherwise(base))
    s1 = strength(hosts.withColumn("base", F.lit(base)), "raw", "hn", "base", 5.0, 1e6)
    hosts = hosts.withColumn("host_rate", (F.coalesce("hgood", F.lit(0.0)) + s1 * base) / (F.col("hn") + s1))
    joined = stored(paths.join(hosts.select(F.col("__host").alias("h"), "host_rate"),
                               F.col("__host").eqNullSafe(F.col("h"))).drop("h")
                    .withColumn("raw", F.when(F.col("n") > 0, F.col("good") / F.col("n"))
                                .otherwise(F.col("host_rate"))), "quality-hosts")
    s2 = strength(joined, "raw", "n", "host_rate", 5.0, 1e6)
    rates = joined.select(
        F.col("__host").alias("h"), F.col("__path").alias("p"), "host_rate",
        ((F.coalesce("good", F.lit(0.0)) + s2 * F.col("host_rate")) / (F.col("n") + s2)).alias("path_rate"))
    final = scored.join(rates, F.col("__host").eqNullSafe(F.col("h")) & F.col("__path").eqNullSafe(F.col("p")))
    shift = logit(F.least(F.greatest("path_rate", F.lit(1e-4)), F.lit(1 - 1e-4))) - float(np.log(base / (1 - base)))
    probability = F.when(F.col("__some"), squashed(logit(F.col("__e")) + shift)).otherwise(F.lit(0.0))
    return (final.withColumn("probability", probability)
            .select(*[F.col(n).alias(c) for c, n in zip(keep, names)], F.col("__e").alias("evidence"),
                    "host_rate", "path_rate", "probability",
                    (F.col("probability") >= threshold).alias("kept")))
