"""Personal data: patterns, then bootstrapped contextual extraction. DataFrame functions only.

What the base patterns find are the seeds. The words around seeds induce lexical patterns; patterns and
the identifiers that occur with them form a graph, in which patterns are scored by the known identifiers
they surround and identifiers by the patterns that surround them, in turns. Patterns of high confidence
then discover identifiers that no base pattern matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import running_totals, stored

KINDS = ("email", "ip", "card", "phone")
# The base patterns, written so that no run of characters is tried again from each of its places: a
# match begins at the start of a run or where the match before ended (\G), and what can't be given back
# is possessive. They match what the plain patterns match.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HOLDS_EMAIL = r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.[A-Za-z0-9-]"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
# What a text must hold for a base pattern to match; spares the others the search for places.
NEEDED = {"email": r"@[A-Za-z0-9-]+\.", "ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?+[0-9]){12}",
          "phone": r"\+[0-9]"}
# Identifiers that patterns may discover: whole runs of identifier characters with '@' or a digit, behind
# anything else (a label, a bracket, a quote, white space); groups of digits may stand one space apart.
CANDIDATE = (r"(?<![A-Za-z0-9@._/+-])(?=[A-Za-z._()/+-]*+[0-9@])[(+]?[A-Za-z0-9][A-Za-z0-9@._()/+-]*[A-Za-z0-9]"
             r"(?:(?<=[0-9])\)?\x20[(]?[0-9][0-9()./-]*[0-9])*+(?![A-Za-z0-9])")
CANDIDATE_NEEDED = r"[0-9](?:[^\s0-9]*+\x20?[0-9]){5}|@"
# Characters of context that are looked at on either side.
REACH = 40


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def passes_luhn(number: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    places = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(
        i % 2 == 0, d.try_cast("int")).otherwise(
        F.when(d.try_cast("int") * 2 > 9, d.try_cast("int") * 2 - 9).otherwise(d.try_cast("int") * 2)))
    return F.aggregate(places, F.lit(0), lambda total, x: total + F.coalesce(x, F.lit(0))) % 10 == 0


def is_valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"\A{PART}(?:\.{PART}){{3}}\z")
    if kind == "card":
        number = digits(match)
        return F.when(F.length(number).between(13, 19), passes_luhn(number)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(match)).between(9, 15)
    return F.lit(True)


SPANS = "array<struct<start:bigint,end:bigint,value:string>>"


def all_matches(text: Column, pattern: str) -> Column:
    """Every match with its place in code points: array of (start, end, value).

    The parts between the matches and the matches themselves make up the text, so their lengths add up
    to the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.transform(found, lambda value: F.length(value).cast("bigint"))
    gaps = F.transform(F.split(text, pattern, -1), lambda gap: F.length(gap).cast("bigint"))
    ends = running_totals(F.zip_with(sizes, F.slice(gaps, 1, F.greatest(F.size(sizes), F.lit(0))),
                                     lambda size, gap: size + gap))
    return F.zip_with(ends, found, lambda end, value: F.struct(
        (end - F.length(value)).alias("start"), end.alias("end"), value.alias("value"))).cast(SPANS)


def base_spans(text: Column, kind: str) -> Column:
    """Valid matches of one kind's base pattern, in order of place."""
    found = F.filter(all_matches(text, PATTERNS[kind]), lambda m: is_valid(kind, m["value"]))
    return F.when(text.rlike(NEEDED[kind]), found).otherwise(F.array().cast(SPANS))


def with_context(text: Column, span: Column, kind: Column) -> Column:
    """A span with its kind (null for a candidate) and what stands before and behind it."""
    start, end = span["start"].cast("int"), span["end"].cast("int")
    first = F.greatest(start - REACH, F.lit(0))
    return F.struct(kind.alias("kind"), span["start"].alias("start"), span["end"].alias("end"),
                    F.lower(span["value"]).alias("value"),
                    F.substring(text, first + 1, start - first).alias("left"),
                    F.substring(text, end + 1, F.lit(REACH)).alias("right"))


def kept_names(keep: list[str]) -> list[str]:
    """Names for kept columns that clash with none of the operator's own."""
    return [f"__k{i}" for i in range(len(keep))]


def found_spans(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The kept columns under `kept_names`, `spans` (base spans in order of kind and place) and `candidates`
    (identifier-like strings outside all base spans), both with their context; and `row`, a number for
    every row."""
    body = F.col("__text")

    def of_kind(kind: str) -> Column:
        return F.transform(base_spans(body, kind), lambda s: with_context(body, s, F.lit(kind)))

    kinds = F.concat(*map(of_kind, KINDS))
    slim = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, kept_names(keep))],
                       F.coalesce(text, F.lit("")).alias("__text"))
    slim = slim.withColumn("__spans", kinds)
    # What holds an address overlaps a base span for sure; only the others are compared with all spans.
    likely = F.filter(
        F.filter(all_matches(body, CANDIDATE), lambda c: ~c["value"].rlike(HOLDS_EMAIL) & (
            c["value"].contains("@") | (F.length(digits(c["value"])) >= 6))),
        lambda c: ~F.exists("__spans", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])))
    candidates = F.when(body.rlike(CANDIDATE_NEEDED), F.transform(
        likely, lambda c: with_context(body, c, F.lit(None).cast("string"))))
    return slim.withColumn("__candidates", candidates).drop("__text").withColumn(
        "__row", F.monotonically_increasing_id())


def induced_patterns(left: Column, right: Column) -> Column:
    """Lexical patterns around a place: two words before it; the words before and behind it; a label."""
    word = r"\p{L}{1,30}"
    two = F.regexp_extract(left, rf"({word}[^\p{{L}}0-9]{{1,3}}{word})[^\p{{L}}0-9]{{0,3}}\z", 1)
    one = F.regexp_extract(left, rf"({word})[^\p{{L}}0-9]{{0,3}}\z", 1)
    after = F.regexp_extract(right, rf"\A[^\p{{L}}0-9]{{0,3}}({word})", 1)
    label = F.regexp_extract(left, rf"({word}\s?[:=#])\s?\z", 1)
    made = F.array(F.when(two != "", F.concat(two, F.lit(" _"))),
                   F.when((one != "") & (after != ""), F.concat(one, F.lit(" _ "), after)),
                   F.when(label != "", F.concat(label, F.lit("_"))))
    return F.transform(F.filter(made, lambda p: p.isNotNull()), lambda p: F.lower(p))


def discovered(occurrences: DataFrame, least_seeds: int, least_confidence: float, rounds: int,
               ) -> DataFrame:
    """Identifiers that confident patterns surround: value, kind.

    Each round scores a pattern for a kind by the share of its distinct identifiers known to be of that
    kind (one more counts against it), if at least `least_seeds` are; and an identifier by the chance
    that not all of its patterns err. Identifiers that reach `least_confidence` count as known in the
    next round, with that score.
    """
    edges = stored(
        occurrences.select("value", "kind", F.explode(induced_patterns(F.col("left"), F.col("right")))
                           .alias("pattern"))
        .groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "pii-graph")
    known = edges.filter("kind is not null").groupBy("value").agg(
        F.max("kind").alias("kind"), F.lit(1.0).alias("score"))
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    new = None
    for _ in range(rounds):
        support = (edges.select("pattern", "value").join(known, "value").groupBy("pattern", "kind")
                   .agg(F.sum("score").alias("weight"), F.count("*").alias("seeds"))
                   .filter(F.col("seeds") >= least_seeds))
        confidence = (support.join(sizes, "pattern")
                      .select("pattern", "kind", (F.col("weight") / (F.col("n") + 1)).alias("confidence"))
                      .filter(F.col("confidence") > 0.5))
        new = (edges.filter("kind is null").select("pattern", "value").join(confidence, "pattern")
               .groupBy("value", "kind")
               .agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score"))
               .filter(F.col("score") >= least_confidence)
               .groupBy("value").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"),
                                     F.max("score").alias("score")))
        new = stored(new, "pii-round")
        seeds = edges.filter("kind is not null").groupBy("value").agg(
            F.max("kind").alias("kind"), F.lit(1.0).alias("score"))
        known = seeds.unionByName(new).groupBy("value").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"),
                                           F.max("score").alias("score"))
    return new.select("value", "kind") if new is not None else known.select("value", "kind").limit(0)


def find_personal_data(docs: DataFrame, text: str = "text", keep: list[str] | None = None,
                       **options) -> DataFrame:
    """Personal data of every whole text: the kept columns (all but the text by default), `base` and
    `spans`, arrays of (kind, start, end) in order of kind, start and end; places in code points.

    `base` holds the valid matches of the base patterns, leftmost and non-overlapping per kind; `spans`
    also what bootstrapped patterns discover (see `discovered` for the options), which never overlaps a
    base span. A null text counts as empty and has no spans. Rows are kept one by one, repeated rows
    included; without any seed nothing is discovered; an empty table gives an empty one. Kept columns that
    are called `base` or `spans` are left out.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    keep = [c for c in keep if c not in ("base", "spans")]
    found = spans_of_rows(docs, text, keep, **options)
    return found.select(*[F.col(n).alias(c) for c, n in zip(keep, kept_names(keep))], "base", "spans")


def spans_of_rows(docs: DataFrame, text: str, keep: list[str], least_seeds: int = 8,
                  least_confidence: float = 0.9, rounds: int = 3) -> DataFrame:
    """The kept columns under `kept_names`, `base` and `spans`."""
    rows = stored(found_spans(docs, text, keep), "pii-rows")
    every = rows.select("__row", F.explode(F.concat("__spans", F.coalesce(
        "__candidates", F.expr("slice(__spans, 1, 0)")))).alias("o")).select("__row", "o.*")
    values = discovered(every, least_seeds, least_confidence, rounds)
    more = (every.filter("kind is null").select("__row", "value", "start", "end").join(values, "value")
            .groupBy("__row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("__more")))
    plain = F.transform("__spans", lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    joined = rows.join(more, "__row", "left").withColumn("base", plain)
    ordered = F.transform(F.array_sort(F.transform(
        F.concat("base", F.coalesce("__more", F.expr("slice(base, 1, 0)"))),
        lambda s: F.struct(order[s["kind"]].alias("k"), s["start"].alias("start"), s["end"].alias("end"),
                           s["kind"].alias("kind")))),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return joined.withColumn("spans", ordered).select(*kept_names(keep), "base", "spans")


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents with every span replaced by its kind in brackets, such as [EMAIL].

    Of spans that overlap, the first names the replacement, which covers them all. Null texts stay null.
    """
    found = spans_of_rows(docs, text, docs.columns, **options)
    names = kept_names(docs.columns)
    body = F.col(names[docs.columns.index(text)])
    by_place = F.array_sort(F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    cut = "array<struct<from:bigint,start:bigint,kind:string>>"
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(cut).alias("cuts"))
    # What is replaced: spans that begin where none before reaches, with the end of what was before.
    cuts = F.aggregate(
        by_place, start,
        lambda state, s: F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(s["start"] >= state["at"], F.concat(state["cuts"], F.array(F.struct(
                state["at"].alias("from"), s["start"].alias("start"), s["kind"].alias("kind")))))
            .otherwise(state["cuts"]).alias("cuts")))

    def part(begin: Column, end: Column) -> Column:
        return F.substring(body, (begin + 1).cast("int"), (end - begin).cast("int"))

    pieces = F.transform(cuts["cuts"], lambda c: F.concat(
        part(c["from"], c["start"]), F.lit("["), F.upper(c["kind"]), F.lit("]")))
    clean = F.concat(F.array_join(pieces, ""), part(cuts["at"], F.length(body).cast("bigint")))
    replaced = F.when(F.size("spans") > 0, clean).otherwise(body)
    return found.select(*[(replaced if c == text else F.col(n)).alias(c) for c, n in zip(docs.columns, names)])
