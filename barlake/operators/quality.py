"""Split rows into valid and rejected by named rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def passes(rules: dict[str, Column]) -> Column:
    """True when every rule is true; a rule that is null counts as failed."""
    return reduce(lambda a, b: a & b, rules.values())


def broken_rules(rules: dict[str, Column]) -> Column:
    """Names of the rules a row breaks, comma separated, in the order given."""
    return F.concat_ws(",", *[
        F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): the valid rows unchanged, the others with a reason column.

    Every row is in exactly one of the two. Both are plain filters, so each is pushed towards the
    scan and works on streams too.
    """
    accepted = passes(rules)
    rejected = df.filter(~F.coalesce(accepted, F.lit(False)))
    return df.filter(accepted), rejected.withColumn("reason", broken_rules(rules))


def require_valid(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The same rows, but the job fails on the first one that breaks a rule."""
    guard = F.when(F.coalesce(passes(rules), F.lit(False)), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("row breaks: "), broken_rules(rules))).cast("boolean"))
    return df.filter(guard)
