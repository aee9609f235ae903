"""Secrets in texts, found through a trigram index. DataFrame functions only.

From every rule's regular expression a Boolean query over trigrams is derived, which any text with a match
satisfies. The trigrams that queries ask for are indexed (an inverted index: trigram, row); intersecting
their postings gives the rules that may match a row, and only those are run on its text. Rules without a
mandatory trigram are run on every text.
"""

from __future__ import annotations

from re import _constants as node
from re import _parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import running_totals, stored


class Rule(NamedTuple):
    """A kind of secret: matches of the pattern whose group has at least that many characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE_RULES = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                   r"([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18),
    # The same as runs of any length of which the shorter ones are dropped.
    Rule("hex", "[0-9a-f]{16,}"),
]
# Published forms of credentials.
MORE_RULES = [
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", "[rs]k_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"://[^\s/:@]+:[^\s/:@]+@"),
]

# Queries are sets of clauses, any of which suffices; a clause is a set of trigrams, all of which are needed.
Query = frozenset
ANYTHING = Query([frozenset()])
# Sets of strings and of clauses beyond this size are given up for a weaker query.
MOST = 64


def needs(strings: set[str]) -> Query:
    """The trigrams of one of these strings."""
    return simplified(frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings)


def simplified(clauses) -> Query:
    """Clauses that another one implies are left out."""
    clauses = set(clauses)
    return Query(c for c in clauses if not any(other < c for other in clauses))


def both(one: Query, other: Query) -> Query:
    if len(one) * len(other) > MOST:
        return min(one, other, key=len)
    return simplified(a | b for a in one for b in other)


def characters(items) -> set[str] | None:
    """The characters of a class, in lower case, if they are few."""
    found: set[str] = set()
    for kind, value in items:
        if kind is node.LITERAL:
            found.add(chr(value).lower())
        elif kind is node.RANGE and value[1] - value[0] < 8:
            found.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return None
    return found if len(found) <= 8 else None


def trigram_query(pattern: str) -> Query:
    """What the lower-case form of any text with a match must contain."""
    strings, query = _sequence(_parser.parse(pattern))
    return query if strings is None else both(query, needs(strings))


def _sequence(items) -> tuple[set[str] | None, Query]:
    """All strings a sequence can be, if they are few, and the query of the rest."""
    strings, query, whole = {""}, ANYTHING, True
    for kind, value in _unrolled(items):
        some, more = _element(kind, value)
        query = both(query, more)
        if some is not None and len(strings) * len(some) <= MOST:
            strings = {a + b for a in strings for b in some}
        else:
            query, whole = both(query, needs(strings)), False
            strings = {""} if some is None else some
    return (strings, query) if whole else (None, both(query, needs(strings)))


def _unrolled(items):
    """Repeats as their first rounds, and something unknown if there can be more."""
    for kind, value in items:
        if kind in (node.MAX_REPEAT, node.MIN_REPEAT, node.POSSESSIVE_REPEAT) and value[:2] != (0, 1):
            least, most, body = value
            for _ in range(min(least, 3)):
                yield from _unrolled(body)
            if most > min(least, 3):
                yield node.ANY, None
        else:
            yield kind, value


def _element(kind, value) -> tuple[set[str] | None, Query]:
    if kind is node.LITERAL:
        return {chr(value).lower()}, ANYTHING
    if kind is node.IN:
        return characters(value), ANYTHING
    if kind is node.SUBPATTERN:
        return _sequence(value[-1])
    if kind in (node.AT, node.ASSERT, node.ASSERT_NOT):
        return {""}, ANYTHING
    if kind in (node.MAX_REPEAT, node.MIN_REPEAT, node.POSSESSIVE_REPEAT):  # once or not at all
        strings, _ = _sequence(value[2])
        return None if strings is None else strings | {""}, ANYTHING
    if kind is node.BRANCH:
        parts = [_sequence(branch) for branch in value[1]]
        if all(strings is not None for strings, _ in parts):
            return set().union(*(strings for strings, _ in parts)), ANYTHING
        clauses = [query if strings is None else both(query, needs(strings)) for strings, query in parts]
        return None, simplified(c for query in clauses for c in query)
    return None, ANYTHING


SPAN = "struct<start:bigint,kind:int,end:bigint>"


def spans_of(text: Column, rule: Rule, kind: int) -> Column:
    """The rule's spans (start, kind, end) in code points, leftmost and not overlapping.

    What matches and what stands between makes up the text, so the lengths add up to the places.
    """
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    sizes = F.transform(matches, lambda m: F.length(m).cast("bigint"))
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.length(g).cast("bigint"))
    valued = sizes if rule.group == 0 else F.transform(
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda g: F.length(g).cast("bigint"))
    ends = running_totals(F.zip_with(sizes, F.slice(gaps, 1, F.greatest(F.size(sizes), F.lit(0))),
                                     lambda size, gap: size + gap))
    spans = F.zip_with(F.zip_with(ends, sizes, lambda end, size: F.struct(
        (end - size).alias("start"), F.lit(kind).alias("kind"), end.alias("end"))), valued,
        lambda span, n: F.when(n >= rule.least, span))
    return F.coalesce(F.filter(spans, lambda s: s.isNotNull()), F.array().cast(f"array<{SPAN}>"))


def literal_rows(df_of, rows: list[tuple], names: list[str]) -> DataFrame:
    """A few fixed rows, made without Python workers."""
    items = [F.struct(*[F.lit(value).alias(name) for value, name in zip(row, names)]) for row in rows]
    return df_of.range(1).select(F.explode(F.array(*items)).alias("row")).select("row.*")


def candidates(postings: DataFrame, clauses: dict[int, list[tuple[int, ...]]]) -> DataFrame:
    """Rows with the rules that may match them: for each clause of a rule's query the postings of its
    trigrams are intersected, and the clauses of a rule united. `clauses` are lists of trigram numbers."""
    flat = [(rule, c, trigram, len(clause)) for rule, alternatives in clauses.items()
            for c, clause in enumerate(alternatives) for trigram in clause]
    wanted = literal_rows(postings.sparkSession, flat, ["rule", "clause", "trigram", "needed"])
    met = (postings.join(F.broadcast(wanted), "trigram")  # as many rows as the rules have trigrams
           .groupBy("__row", "rule", "clause", "needed").agg(F.count("*").alias("met")).filter("met = needed"))
    return met.groupBy("__row").agg(F.collect_set("rule").alias("rules"))


def find_secrets(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text",
                 keep: list[str] | None = None) -> DataFrame:
    """Secrets of every whole text: the kept columns (all but the text by default) and `secrets`, an array
    of (start, kind, end) in order of start and kind; `kind` is the rule's number, places are in code
    points, the end is exclusive.

    Matches of one rule are leftmost and do not overlap; those of different rules may. A null text counts
    as empty and has none. Rows are kept one by one, repeated rows included; an empty table gives an empty
    one. No kept column may be called `secrets`.

    Only texts that hold one of the indexed trigrams are written to the shared folder, and only those of
    candidates are shuffled.
    """
    rules = BASE_RULES + MORE_RULES if rules is None else rules
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    queries = {k: trigram_query(rule.pattern) for k, rule in enumerate(rules)}
    full = [k for k, query in queries.items() if query == ANYTHING]
    vocabulary = sorted({t for query in queries.values() for clause in query for t in clause})
    number = {t: n for n, t in enumerate(vocabulary)}
    none = F.array().cast(f"array<{SPAN}>")

    def scanned(text_column: Column, k: int) -> Column:
        return F.when(text_column.rlike(rules[k].pattern), spans_of(text_column, rules[k], k)).otherwise(none)

    kept = [F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(keep)]
    rows = docs.select(*kept, F.coalesce(text, F.lit("")).alias("__text")).withColumn(
        "__row", F.monotonically_increasing_id()).withColumn("__folded", F.lower("__text"))
    held = [F.when(F.col("__folded").contains(t), F.lit(n)) for t, n in number.items()]
    trigrams = F.array_compact(F.array(*held)) if held else F.array().cast("array<int>")
    rows = rows.withColumn("__trigrams", trigrams).withColumn(
        "__scanned", F.concat(none, *[scanned(F.col("__text"), k) for k in full])).drop("__folded")
    rows = stored(rows.withColumn("__text", F.when(F.size("__trigrams") > 0, F.col("__text"))), "secret-rows")
    postings = stored(
        rows.select("__row", F.explode("__trigrams").alias("trigram"))
        .repartitionByRange("trigram", "__row").sortWithinPartitions("trigram", "__row"), "secret-index")
    clauses = {k: [tuple(sorted(number[t] for t in clause)) for clause in sorted(query, key=sorted)]
               for k, query in queries.items() if k not in full}
    narrow = rows.drop("__text", "__trigrams")
    if any(clauses.values()):
        checked = rows.select("__row", "__text").join(candidates(postings, clauses), "__row").select(
            "__row", F.concat(none, *[
                F.when(F.array_contains("rules", k), scanned(F.col("__text"), k)).otherwise(none)
                for k in clauses]).alias("__verified")).filter(F.size("__verified") > 0)
        narrow = narrow.join(checked, "__row", "left")
    else:
        narrow = narrow.withColumn("__verified", none)
    return narrow.select(
        *[F.col(f"__{i}").alias(c) for i, c in enumerate(keep)],
        F.array_sort(F.concat("__scanned", F.coalesce("__verified", none))).alias("secrets"))


def spans_text(spans: Column, rules: list[Rule]) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(rule.kind) for rule in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
