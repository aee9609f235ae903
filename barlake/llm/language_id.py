"""Language identification: word-first backoff.

Known words are scored by their log frequency per language. A word the lexicon does not know is scored
by the character n-grams that cover it: the longest known ones first, then shorter and shorter ones.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barlake.llm.common import arrow_pass, forget_shuffles, stored

UNDETERMINED = "und"
# Words are runs of letters.
LETTERS = re.compile(r"[^\W\d_]+")
# Entries a task's counter holds before it is emptied into the shuffle.
FLUSH = 200_000


def grams_of(word: str, longest: int) -> list[str]:
    """The n-grams of a word, with its ends marked, from 1 to `longest` characters."""
    marked = f"<{word}>"
    return [marked[i:i + n] for n in range(1, longest + 1) for i in range(len(marked) - n + 1)]


def count_words(labelled: DataFrame, text: str, lang: str) -> DataFrame:
    """Occurrences of each lower-cased word per language over all rows: lang, word, n.

    Every task adds up its own words, so that the shuffle carries one row per task, language and word
    (more only when a task sees more distinct words than FLUSH).
    """
    def make():
        def work(batch: pa.RecordBatch):
            counts: dict[str, Counter] = {}
            for body, language in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.setdefault(language, Counter()).update(LETTERS.findall(body.lower()))
                if sum(map(len, counts.values())) > FLUSH:
                    yield _counts(counts)
                    counts = {}
            yield _counts(counts)
        return work

    slim = (labelled.select(F.col(text).alias("__text"), F.col(lang).alias("__lang"))
            .filter("__text is not null and __lang is not null"))
    partial = arrow_pass(slim, "lang string, word string, n bigint", make, rows=20_000)
    return partial.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _counts(counts: dict[str, Counter]) -> pa.RecordBatch:
    languages = [language for language, found in counts.items() for _ in range(len(found))]
    return pa.RecordBatch.from_arrays(
        [pa.array(languages, pa.string()),
         pa.array([word for found in counts.values() for word in found], pa.string()),
         pa.array([n for found in counts.values() for n in found.values()], pa.int64())],
        ["lang", "word", "n"])


def count_grams(words: DataFrame, longest: int) -> DataFrame:
    """Occurrences of each n-gram per language, from the counts of words: lang, gram, n."""
    def make():
        def work(batch: pa.RecordBatch):
            counts: dict[str, Counter] = {}
            once: dict[str, list[str]] = {}  # grams of words seen once are counted in one go
            for language, word, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if n == 1:
                    once.setdefault(language, []).extend(grams_of(word, longest))
                    continue
                found = counts.setdefault(language, Counter())
                for gram in grams_of(word, longest):
                    found[gram] += n
            for language, grams in once.items():
                counts.setdefault(language, Counter()).update(grams)
            yield _counts(counts)
        return work

    partial = arrow_pass(words, "lang string, word string, n bigint", make, rows=20_000)
    return partial.groupBy("lang", F.col("word").alias("gram")).agg(F.sum("n").alias("n"))


class Entries:
    """Counts of words or n-grams per language, without an object for each count: the sorted keys, and for
    every count the place of its key, its language's place and the count itself."""

    def __init__(self, keys: list[str], at: np.ndarray, place: np.ndarray, counts: np.ndarray):
        self.keys, self.at, self.place, self.counts = keys, at, place, counts

    @classmethod
    def of_table(cls, table: pa.Table, languages: list[str]) -> Entries:
        """From columns of keys, languages and counts."""
        column = table.column(0).combine_chunks().dictionary_encode()
        order = np.array(pc.array_sort_indices(column.dictionary))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        place = pc.index_in(table.column(1), pa.array(languages, pa.string())).to_numpy()
        return cls(column.dictionary.take(pa.array(order)).to_pylist(), rank[column.indices.to_numpy()],
                   place, table.column(2).to_numpy())

    @classmethod
    def of_dict(cls, entries: dict[str, dict[str, int]], place: dict[str, int]) -> Entries:
        rows = [(number, place[language], n) for number, found in enumerate(entries.values())
                for language, n in found.items()]
        return cls(list(entries), *np.array(rows, np.int64).reshape(-1, 3).T)


class BackoffModel:
    """Log frequencies per language of known words and of n-grams: a number of a table's row for each.

    Every row is shifted so that its best language has 0; only differences between languages count.
    """

    def __init__(self, languages: list[str], words: dict[str, dict[str, int]] | Entries,
                 grams: dict[str, dict[str, int]] | Entries, word_totals: list[int], longest: int,
                 gram_totals: dict[int, list[int]] | None = None, word_kinds: int | None = None,
                 gram_kinds: dict[int, int] | None = None):
        self.languages, self.longest = languages, longest
        place = self.place = {language: i for i, language in enumerate(languages)}
        words, grams = (x if isinstance(x, Entries) else Entries.of_dict(x, place) for x in (words, grams))
        known = len(words.keys)
        table = np.full((known + len(grams.keys), len(languages)), 0.5)
        table[words.at, words.place] += words.counts
        table[grams.at + known, grams.place] += grams.counts
        # Words share their totals; n-grams share those of their length.
        self.word_totals = np.asarray(word_totals, float) + 0.5 * ((word_kinds or known) + 1)
        table[:known] /= self.word_totals
        lengths = np.fromiter(map(len, grams.keys), np.int64, len(grams.keys))
        for length in set(lengths.tolist()):
            rows = np.flatnonzero(lengths == length) + known
            table[rows] /= table[rows].sum(axis=0) if gram_totals is None else (
                np.asarray(gram_totals[length], float) + 0.5 * (gram_kinds[length] + 1))
        np.log(table, out=table)
        table -= table.max(axis=1, keepdims=True)
        self.table = table.astype(np.float32)
        self.words = {word: number for number, word in enumerate(words.keys)}
        self.grams = {gram: number for number, gram in enumerate(grams.keys, known)}

    def better_known(self, words: list[str], rows: np.ndarray, languages: list[str], counts: np.ndarray,
                     ) -> np.ndarray:
        """What the scores of words as words of the lexicon are above those by n-grams. `rows` says which
        word each (language, count) belongs to."""
        found = np.full((len(words), len(self.languages)), 0.5)
        np.add.at(found, (rows, [self.place[language] for language in languages]), counts)
        scores = np.log(found / self.word_totals)
        return scores - scores.max(axis=1, keepdims=True) - self.means([self.cover(word) for word in words])

    def means(self, covers: list[list[int]]) -> np.ndarray:
        """Mean scores of the rows of each list; 0 for an empty one."""
        sizes = np.array([len(cover) for cover in covers])
        grams = np.array([row for cover in covers for row in cover], np.int64)
        sums = np.zeros((len(sizes), len(self.languages)))
        np.add.at(sums, np.repeat(np.arange(len(sizes)), sizes), self.table[grams])
        return sums / np.maximum(sizes, 1)[:, None]

    def cover(self, word: str) -> list[int]:
        """Rows of the n-grams that cover the word, each the longest known one at its place."""
        marked, at, found, known = f"<{word}>", 0, [], self.grams.get
        while at < len(marked):
            for end in range(min(at + self.longest, len(marked)), at, -1):
                row = known(marked[at:end])
                if row is not None:
                    found.append(row)
                    at = end
                    break
            else:
                at += 1
        return found


class WordRows(dict):
    """Word to the row of its scores; rows of unseen words are added when first met, `room` at a time."""

    def __init__(self, model: BackoffModel, room: int = 150_000):
        super().__init__(model.words)
        self.model, self.room = model, room
        self.next = self.first = len(model.table)
        self.table = np.concatenate([model.table, np.zeros((room, len(model.languages)), np.float32)])
        self.todo: list[tuple[int, list[int]]] = []

    def __missing__(self, word: str) -> int:
        cover = self.model.cover(word)
        row = self.next
        self.todo.append((row, cover))
        self.next += 1
        self[word] = row
        return row

    def scores(self, texts: list[list[str]]) -> tuple[np.ndarray, list[str], list[int]]:
        """Sums of each text's words' scores per language; the words that the lexicon lacks, text by text,
        and where each text's end."""
        result = np.zeros((len(texts), len(self.model.languages)))
        lacking, ends = [], [0]
        for number, words in enumerate(texts):
            for start in range(0, len(words), 50_000):
                part = words[start:start + 50_000]
                if self.next + len(part) > self.first + self.room:
                    self.clear()
                    self.update(self.model.words)
                    self.next = self.first
                rows = np.fromiter(map(self.__getitem__, part), np.int64, len(part))
                if self.todo:
                    self._fill()
                result[number] += self.table[rows].sum(axis=0, dtype=np.float64)
                lacking += map(part.__getitem__, np.flatnonzero(rows >= self.first).tolist())
            ends.append(len(lacking))
        return result, lacking, ends

    def _fill(self) -> None:
        """Rows of new words: the means of the n-grams that cover them."""
        self.table[[row for row, _ in self.todo]] = self.model.means([cover for _, cover in self.todo])
        self.todo.clear()


def quotas(rows: dict[str, int], most: int) -> dict[str, int]:
    """How many of its rows each language may keep: equal parts; what small languages leave goes to others."""
    left, result = most, {}
    for number, language in enumerate(sorted(rows, key=lambda k: (rows[k], k))):
        result[language] = min(rows[language], left // (len(rows) - number))
        left -= result[language]
    return result


def frequent_per_language(counts: DataFrame, key: str, most: int) -> DataFrame:
    """The most frequent entries of every language, about `most` in all, as distinct values of `key`.

    Per language a cut goes through the histogram of the counts' logarithms; of the counts on the cut a
    part is kept, by hash. Rows are neither sorted nor gathered.
    """
    level = F.floor(F.log2("n") * 16)
    histogram: dict[str, dict[int, int]] = {}
    for row in counts.groupBy("lang", level.alias("level")).agg(F.count("*").alias("rows")).collect():
        histogram.setdefault(row["lang"], {})[row["level"]] = row["rows"]  # a few hundred levels a language
    cuts = []
    for language, room in quotas({k: sum(v.values()) for k, v in histogram.items()}, most).items():
        cut, part = -1, 0.0
        for at in sorted(histogram[language], reverse=True):
            if histogram[language][at] > room:
                cut, part = at, room / histogram[language][at]
                break
            room -= histogram[language][at]
        cuts.append((language, cut, part))
    spark = counts.sparkSession
    limits = F.broadcast(spark.createDataFrame(cuts, "lang string, cut long, part double"))  # a row a language
    on_cut = (level == F.col("cut")) & (F.pmod(F.xxhash64(key), F.lit(10_000)) < F.col("part") * 10_000)
    return counts.join(limits, "lang").filter((level > F.col("cut")) | on_cut).select(key).distinct()


def listed(matrix: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as an Arrow column of lists."""
    ends = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(matrix.ravel()))


def learn(labelled: DataFrame, text: str, lang: str, lexicon: int = 100_000, gram_entries: int = 60_000,
          longest: int = 4) -> tuple[BackoffModel, DataFrame] | None:
    """Fit the model on all rows with a text and a language; None if there is no such row.

    Counts cover every word of every row. The model holds about `lexicon` words and `gram_entries`
    n-grams, shared equally between the languages, the most frequent ones of each, with their counts in
    all languages: that bounds what is sent to executors. The second result has all other words (word,
    better): what their scores as known words are above those by n-grams, per language.
    """
    words = stored(count_words(labelled, text, lang), "language-words")
    totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return None
    languages = sorted(totals)
    forget_shuffles(words.sparkSession)
    grams = stored(count_grams(words, longest), "language-grams")
    forget_shuffles(words.sparkSession)
    lengths: dict[int, list[int]] = {}
    for row in grams.groupBy("lang", F.length("gram").alias("length")).agg(F.sum("n").alias("n")).collect():
        lengths.setdefault(row["length"], [0] * len(languages))[languages.index(row["lang"])] = row["n"]

    word_kinds = words.select("word").distinct().count()
    gram_kinds = {row["length"]: row["count"] for row in grams.select(
        "gram", F.length("gram").alias("length")).distinct().groupBy("length").count().collect()}

    def table(counts: DataFrame, key: str, most: int) -> tuple[DataFrame, Entries]:
        kept = stored(frequent_per_language(counts, key, most), f"language-kept-{key}")
        # `most` entries, an entry a language: as Arrow, since a Row for each would be most of the driver's Python
        found = counts.join(F.broadcast(kept), key, "left_semi").select(key, "lang", "n").toArrow()
        forget_shuffles(counts.sparkSession)
        return kept, Entries.of_table(found, languages)

    kept, known = table(words, "word", lexicon)
    model = BackoffModel(languages, known, table(grams, "gram", gram_entries)[1],
                         [totals[language] for language in languages], longest, lengths, word_kinds, gram_kinds)
    shared = words.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def work(batch: pa.RecordBatch):
            counts = batch.column(1)
            rows = np.repeat(np.arange(batch.num_rows), np.diff(counts.offsets.to_numpy()))
            found = counts.flatten()
            better = own.better_known(batch.column(0).to_pylist(), rows, found.field("lang").to_pylist(),
                                      found.field("n").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), listed(better)], ["word", "better"])
        return work

    others = (words.join(F.broadcast(kept), "word", "left_anti").groupBy("word")
              .agg(F.collect_list(F.struct("lang", "n")).alias("counts")))  # an entry a language
    result = stored(arrow_pass(others, "word string, better array<double>", make), "language-others")
    shared.destroy()  # what it was needed for is stored
    forget_shuffles(words.sparkSession)
    return model, result


def predict(docs: DataFrame, learned: tuple[BackoffModel, DataFrame] | None, text: str = "text",
            lang_out: str = "lang_pred", score_out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Add the predicted language and its score (0 to 1) to the kept columns (all by default) of every row,
    reading nothing but its text.

    A null text, one without a letter, and every text when nothing was learned give `und` and 0. The
    score is the share of the winner when the languages' scores per word are compared, sharpened by the
    number of words up to ten; ties go to the first language in order. Rows are independent, so repeated
    rows get repeated results, and an empty table gives an empty one. A column of the result's names
    that the frame already has is replaced.

    One pass adds up the scores of the words that the model holds and of the n-grams of the others. Those
    others that were learned all the same are then looked up by a join, whatever their number.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (lang_out, score_out)]
    if learned is None:
        return docs.select(*keep, F.lit(UNDETERMINED).alias(lang_out), F.lit(0.0).alias(score_out))
    model, others = learned
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"__k{i}" for i in range(len(keep))]
    slim = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)],
                       *([] if text in keep else [F.col(text).alias("__text")]))
    text_at = keep.index(text) if text in keep else len(keep)
    schema = StructType([*slim.select(*names).schema.fields, *StructType.fromDDL(
        "__n bigint, __sums array<double>, __lacking array<string>").fields])

    def make():
        rows = WordRows(shared.value)

        def work(batch: pa.RecordBatch):
            texts = [LETTERS.findall(body.lower()) if body else [] for body in batch.column(text_at).to_pylist()]
            sums, lacking, ends = rows.scores(texts)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(list(map(len, texts)), pa.int64()), listed(sums),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(lacking, pa.string()))],
                [*names, "__n", "__sums", "__lacking"])
        return work

    scored = stored(arrow_pass(slim, schema, make, rows=500).withColumn(
        "__row", F.monotonically_increasing_id()), "language-scored")
    shared.destroy()
    places = range(len(model.languages))
    found = (scored.select("__row", F.explode("__lacking").alias("word")).join(others, "word").groupBy("__row")
             .agg(F.array(*[F.sum(F.col("better")[i]) for i in places]).alias("__more")))
    joined = scored.drop("__lacking").join(found, "__row", "left")
    more = F.coalesce("__more", F.array(*[F.lit(0.0) for _ in places]))
    means = F.zip_with("__sums", more, lambda a, b: (a + b) / F.greatest(F.col("__n"), F.lit(1)))
    judged = joined.withColumn("__means", means).withColumn("__best", F.array_max("__means"))
    weight = F.least(F.col("__n"), F.lit(10))
    share = 1 / F.aggregate("__means", F.lit(0.0), lambda total, x: total + F.exp((x - F.col("__best")) * weight))
    winner = F.element_at(F.array(*map(F.lit, model.languages)),
                          F.array_position("__means", F.col("__best")).cast("int"))
    some = F.col("__n") > 0
    return judged.select(
        *[F.col(n).alias(c) for c, n in zip(keep, names)],
        F.when(some, winner).otherwise(UNDETERMINED).alias(lang_out), F.when(some, share).otherwise(0.0).alias(score_out))


def identify(docs: DataFrame, training: Column, text: str = "text", lang: str = "lang",
             keep: list[str] | None = None, **sizes) -> DataFrame:
    """Learn from the rows where `training` holds and predict every row (see `learn` and `predict`)."""
    labelled = docs.filter(training).select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    return predict(docs, learn(labelled, "t", "l", **sizes), text, keep=keep)
