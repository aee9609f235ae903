"""Operators on texts against brute force, round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import struct
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from barlake.llm import byte_bpe, html_extraction, language_id, lm_scoring, mixing, pii, quality
from barlake.llm.common import remainder

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# Mixing

def mixed(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target int")
    return mixing.mix(docs, **options).collect()


def test_mix_comes_near_its_targets(spark):
    draw = random.Random(1)
    rows = [(k, " ".join("w" * draw.randint(1, 60)), draw.choice("aaabcd"), 0, 0) for k in range(400)]
    rows += [(1000 + k, "one two three", None, 0, 0) for k in range(150)]  # a hot length, no source
    rows += [(2000, None, "a", 0, 0), (2001, "", "e", 0, 0)]
    got = mixed(spark, rows, bucket_rows=50)
    again = mixed(spark, rows, bucket_rows=50)
    assert sorted((r["doc_id"], r["times"], r["more"]) for r in got) == sorted(
        (r["doc_id"], r["times"], r["more"]) for r in again)
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    total = sum(r["size"] for r in got)
    per = {}
    for r in got:
        assert r["size"] == len((next(x for x in rows if x[0] == r["doc_id"])[1] or "").split())
        assert r["rows"] == 1 and 0 <= r["times"] + r["more"] <= 3
        part = per.setdefault(r["source"], [0, r["source_size"], r["target"], 0])
        part[0] += r["size"]
        part[3] += r["size"] * (r["times"] + r["more"])
    for size, told, target, taken in per.values():
        assert size == told and target <= 3 * size + 1e-9
        assert abs(taken - target) <= 1
    assert math.isclose(sum(part[2] for part in per.values()), total)


def test_targets_above_the_limit_are_shared_again(spark):
    sources = spark.createDataFrame([("a", 100), ("b", 10), ("c", 1), (None, 900)], "source string, source_size long")
    got = {r["source"]: (r["weight"], r["target"])
           for r in mixing.with_targets(mixing.cyclic_weights(sources)).collect()}
    assert {k: w for k, (w, _) in got.items()} == {"a": 1, "b": 2, "c": 3, None: 1}
    assert got["b"][1] == 30 and got["c"][1] == 3
    assert got["a"][1] == 300 and math.isclose(got[None][1], 678)


def test_mix_of_nothing_and_of_texts_without_words(spark):
    assert mixed(spark, []) == []
    assert [r["times"] for r in mixed(spark, [(1, "", "a", 0, 0), (2, None, "b", 0, 0)])] in ([0, 0], [1, 1])


def test_rows_alike_are_documents_of_their_own(spark):
    rows = [(1, "a b c", "s", 0, 0)] * 3 + [(2, "a", "s", 0, 0), (3, "a b", "t", 0, 0)]
    got = {(r["doc_id"], r["rows"]): r["rows"] * r["times"] + r["more"] for r in mixed(spark, rows)}
    assert set(got) == {(1, 3), (2, 1), (3, 1)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target int")
    assert Counter(r["doc_id"] for r in mixing.mixed_documents(docs).collect()) == Counter(
        {i: n for (i, _), n in got.items() if n})
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_a_source_with_many_rows_alike_hits_its_target(spark):
    text = " ".join(["w"] * 50)
    rows = [(k if k >= 200 else None, text + (" x" if k % 2 and k < 100 else ""), "s", 0, 0) for k in range(600)]
    rows = [(i, t[:99], s, a, b) for i, t, s, a, b in rows]  # 50 words each, two texts with a null id
    rows += [(5000 + k, "w " * 10, "t", 0, 0) for k in range(130)]
    for copies in (rows, rows + [(None, text, "s", 0, 0)] * 100):
        docs = spark.createDataFrame(copies, "doc_id long, text string, source string, size int, target int")
        per = {r["source"]: r for r in mixing.mix(docs, bucket_rows=20).groupBy("source").agg(
            F.max("target").alias("target"), F.max("source_size").alias("source_size"),
            F.sum(F.col("size") * (F.col("rows") * F.col("times") + F.col("more"))).alias("taken")).collect()}
        for source, words in (("s", 50), ("t", 10)):
            assert abs(per[source]["taken"] - per[source]["target"]) <= words / 2
        taken = mixing.mixed_documents(docs, share_rows=7, bucket_rows=20).groupBy("source").count().collect()
        assert {r["source"]: r["count"] for r in taken} == {s: per[s]["taken"] // w for s, w in (("s", 50), ("t", 10))}


def test_a_giant_among_short_texts_is_fitted():
    lengths = [*range(1, 4001), 2_000_000]
    taken = mixing.fit_budget(lengths, [20] * 4000 + [1], 77_777_777.4)
    assert sum(n * t for n, t in zip(lengths, taken)) == 77_777_777
    assert all(0 <= t <= c for t, c in zip(taken, [20] * 4000 + [1]))


@pytest.mark.parametrize("seed", range(8))
def test_budget_fit_is_the_nearest_sum(seed):
    draw = random.Random(seed)
    lengths = sorted(draw.sample(range(1, 40), 5))
    counts = [draw.randint(1, 4) for _ in lengths]
    budget = draw.uniform(0, sum(n * c for n, c in zip(lengths, counts)))
    taken = mixing.fit_budget(lengths, counts, budget)
    assert all(0 <= t <= c for t, c in zip(taken, counts))
    sums = {0}
    for n, c in zip(lengths, counts):
        sums = {s + n * k for s in sums for k in range(c + 1)}
    reached = sum(n * t for n, t in zip(lengths, taken))
    assert abs(reached - budget) == min(abs(s - budget) for s in sums)


# Byte-pair coding

@pytest.fixture(scope="module")
def public_encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                             mergeable_ranks=byte_bpe.read_ranks(RANKS))


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.PrefixBpe(byte_bpe.read_ranks(RANKS))


def odd_texts():
    draw = random.Random(2)
    letters = "abcdefgh thing ionstr\n\t '漢é🙂.1 "
    return ["", " ", "  x", "a\n b  c", "the" * 3000, "x" * 20000, " " * 3000 + "y", "don't DON'T 12345",
            "　a\x1c b\x00", "é" * 500,
            *("".join(draw.choice(letters) for _ in range(draw.randint(1, 80))) for _ in range(300))]


def test_encoding_equals_the_public_one(spark, public_encoding):
    texts = odd_texts()
    rows = [(k, t, [1]) for k, t in enumerate(texts)] + [(-1, None, None), (0, "", [1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>")
    got = byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN, with_ids=True).collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[r["doc_id"]] if r["doc_id"] >= 0 else ""
        ids = public_encoding.encode_ordinary(text)
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    back = byte_bpe.decode_documents(
        byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN, with_ids=True), RANKS)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {**dict(enumerate(texts)), -1: ""}
    assert byte_bpe.encode_documents(docs.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []


def test_prefixes_append_and_edit_exactly(bpe):
    draw = random.Random(5)
    data = "Therefore the retitioning, ándale 漢字 of things 12.".encode() * 6
    last = bpe.prefixes(data)
    for end in range(0, len(data), 7):
        assert bpe.tokens(last[:end + 1]) == bpe.merged(data[:end])
        assert bpe.prefixes(data, bpe.prefixes(data[:end])) == last
    for _ in range(60):
        at = draw.randrange(len(data))
        until = min(len(data), at + draw.randrange(6))
        changed, fresh, computed = bpe.edited(data, last, at, until, b"new "[:draw.randrange(5)])
        assert fresh == bpe.prefixes(changed)
        assert computed <= len(changed) - at
    changed, fresh, computed = bpe.edited(data, last, 3, 4, b"x")
    assert computed < len(data) / 2


# Quality

def judged(spark, docs, labels):
    table = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, quality int")
    return quality.classify(table, spark.createDataFrame(labels, "doc_id long, quality int"))


def test_quality_finds_junk_and_leans_on_the_site(spark):
    draw = random.Random(3)
    docs, truth = [], {}
    for k in range(600):
        bad = draw.random() < (0.9 if k % 3 == 0 else 0.1)
        words = [draw.choice(["house", "walks", "under", "yellow", "often"]) for _ in range(30)]
        text = " ".join(w + "%%%" for w in words) if bad else " ".join(words) + "."
        docs.append((k, text, "junk" if k % 3 == 0 else "fine", "en", 0))
        truth[k] = not bad
    docs += [(700, "house walks under", "junk", "en", 0), (701, "house walks under", "fine", "en", 0),
             (702, None, None, None, 0), (703, "", "new", "en", 0), (701, "house walks under", "fine", "en", 0)]
    labels = [(k, int(truth[k])) for k in range(0, 600, 2)] + [(1, None), (None, 1)]
    got = judged(spark, docs, labels).collect()
    assert len(got) == len(docs)
    by_id = {r["doc_id"]: r for r in got}
    held = [k for k in range(1, 600, 2)]
    assert sum(by_id[k]["kept"] == truth[k] for k in held) / len(held) > 0.97
    assert by_id[700]["probability"] < by_id[701]["probability"]
    assert by_id[700]["path_rate"] < 0.4 < by_id[701]["path_rate"]
    assert by_id[702]["probability"] == by_id[703]["probability"] == 0.0
    assert not by_id[703]["kept"]


def test_quality_shrinks_small_sites_to_the_whole(spark):
    docs = [(k, "plain words here", f"site{k % 20}" if k < 400 else "tiny", "en", 0) for k in range(402)]
    labels = [(k, int(k % 20 < 10)) for k in range(400)] + [(400, 0), (401, 0)]
    got = {r["doc_id"]: r for r in judged(spark, docs, labels).collect()}
    assert got[0]["host_rate"] > 0.75 and got[19]["host_rate"] < 0.25
    assert got[19]["host_rate"] < got[400]["host_rate"] < 0.5


def plain_features(text):
    """The classifier's features of an ASCII text, by plain loops."""
    words, chars = [w for w in re.split(r"[ \t-\r]+", text) if w], max(len(text), 1)
    n = max(len(words), 1)
    runs = re.findall(r"(([#$%&*!])\2+)", text)
    pieces = re.split(r"[ \t-\r]+", text)
    count = lambda test: sum(map(test, text))
    return [min(v, 1.0) for v in (
        count(str.isalpha) / chars, count(str.isupper) / chars, count(str.isdigit) / chars,
        count(lambda c: not (c.isalnum() or c.isspace() or c in ".,;:'\"()-")) / chars,
        count(lambda c: c in ".!?") / n, text.count(",") / n, text.count("|") / n, len(runs) / n,
        text.count("\n") / n, len(set(pieces)) / n)] + [min(chars / n / 12, 1.5), math.log1p(n) / 10]


def plain_quality(docs, labels):
    """(evidence, host_rate, path_rate, probability) per row."""
    given = {}
    for k, y in labels:
        if k is not None and y is not None:
            given.setdefault(k, []).append(y)
    label = {k: sum(ys) / len(ys) for k, ys in given.items()}
    some = [bool((text or "").split()) for _, text, *_ in docs]
    x = [plain_features(text or "") + [1.0] for _, text, *_ in docs]
    train = [(x[i], label[d[0]]) for i, d in enumerate(docs) if some[i] and d[0] in label]
    a, b = np.array([t[0] for t in train]), np.array([t[1] for t in train])
    weights = np.zeros(a.shape[1])
    for _ in range(60):  # Newton's method on the ridged loss
        p = 1 / (1 + np.exp(-a @ weights))
        weights += np.linalg.solve((a.T * (p * (1 - p))) @ a + 1e-3 * len(b) * np.eye(len(weights)),
                                   a.T @ (b - p) - 1e-3 * len(b) * weights)
    evidence = 1 / (1 + np.exp(-np.clip(np.array(x) @ weights, -12, 12)))
    value = [label.get(d[0], evidence[i]) if some[i] else None for i, d in enumerate(docs)]

    def rates(keys, towards, floor=5.0, most=1e6):
        """Rates of groups shrunk towards others', by the method of moments."""
        sums = {}
        for key, v in zip(keys, value):
            good, n = sums.get(key, (0.0, 0))
            sums[key] = (good + v, n + 1) if v is not None else (good, n)
        many = {k: (g / n, n, towards(k)) for k, (g, n) in sums.items() if n > 1}
        total = sum(n for _, n, _ in many.values())
        spread = sum(n * (r - t) ** 2 for r, n, t in many.values())
        inside = sum(t * (1 - t) for _, _, t in many.values())
        between = max(spread - inside, 0) / total
        within = sum(n * t * (1 - t) for _, n, t in many.values()) / total
        s = min(max(within / between if between > 0 else most, floor), most)
        return {k: (g + s * towards(k)) / (n + s) for k, (g, n) in sums.items()}

    counted = [v for v in value if v is not None]
    base = sum(counted) / len(counted)
    hosts = rates([d[2] for d in docs], lambda k: base)
    paths = rates([(d[2], d[3]) for d in docs], lambda k: hosts[k[0]])
    odds = lambda p: math.log(p / (1 - p))
    out = []
    for i, d in enumerate(docs):
        path = paths[d[2], d[3]]
        chance = 1 / (1 + math.exp(-(odds(evidence[i]) + odds(path) - odds(base)))) if some[i] else 0.0
        out.append((d[0], float(evidence[i]), hosts[d[2]], path, chance))
    return sorted(out, key=str)


def test_quality_equals_plain_loops(spark):
    draw = random.Random(12)
    docs = []
    for k in range(400):
        site = draw.choice(["a", "a", "b", "c", "d", None])
        bad = draw.random() < {"a": 0.2, "b": 0.8, "c": 0.5, "d": 0.3, None: 0.6}[site]
        words = [draw.choice(["House", "walks,", "under", "yellow", "often.", "x|y", "12"]) for _ in range(draw.randint(1, 30))]
        docs.append((k, " ".join(w + "%%!!" * bad for w in words), site, draw.choice(["en", "fr", None]), 0))
    docs += [(400, None, "a", "en", 0), (401, " ", "e", "en", 0), (5, docs[5][1], docs[5][2], docs[5][3], 0)]
    labels = [(k, int("%" not in docs[k][1])) for k in range(0, 400, 3)] + [(3, 0), (9, None), (None, 1), (401, 1)]
    got = sorted(((r["doc_id"], r["evidence"], r["host_rate"], r["path_rate"], r["probability"])
                  for r in judged(spark, docs, labels).collect()), key=str)
    expected = plain_quality(docs, labels)
    assert [g[0] for g in got] == [e[0] for e in expected]
    assert all(math.isclose(u, v, rel_tol=1e-5, abs_tol=1e-7) for g, e in zip(got, expected) for u, v in zip(g[1:], e[1:]))


def test_quality_without_labels_or_rows(spark):
    docs = [(1, "some words", "a", "en", 0), (2, None, "a", "en", 0)]
    got = {r["doc_id"]: r for r in judged(spark, docs, []).collect()}
    assert got[1]["kept"] and not got[2]["kept"]
    assert judged(spark, [], [(1, 1)]).collect() == []


# Language identification

LANGUAGES = {"aa": "alpha avenue arbor acorn amber", "bb": "bravo bottle basket bridge bubble",
             "cc": "сова снег слон свет север"}


def test_languages_of_known_and_unseen_words(spark):
    draw = random.Random(4)
    rows = [(k, " ".join(draw.choices(LANGUAGES[lang].split(), k=12)).title(), lang, "x", 0.5)
            for k, lang in enumerate(draw.choices(list(LANGUAGES), k=120))]
    rows += [(200, "ambers arbors acorns", None, "x", 0.5), (201, "bubbles bridged", None, "x", 0.5),
             (202, None, "aa", "x", 0.5), (203, "12 + 3!", "bb", "x", 0.5), (204, "", "bb", "x", 0.5),
             (205, "снега слоны", None, "x", 0.5), (0, rows[0][1], rows[0][2], "x", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    held_out = remainder(F.col("doc_id"), 3) == 1
    got = language_id.identify(docs, ~held_out).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    held = [r for r in rows if r[0] < 200 and zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert held and all(by_id[r[0]]["lang_pred"] == r[2] for r in held)
    assert [by_id[k]["lang_pred"] for k in range(200, 206)] == ["aa", "bb", "und", "und", "und", "cc"]
    assert all(0 <= r["score"] <= 1 for r in got) and by_id[203]["score"] == 0


def test_languages_do_not_see_labels_of_held_out_rows(spark):
    rows = [(k, LANGUAGES["aa"], "aa") for k in range(30)]
    changed = [(k, t, "zz" if zlib.crc32(str(k).encode()) % 3 == 1 else lang) for k, t, lang in rows]
    training = remainder(F.col("doc_id"), 3) != 1
    for table in (rows, changed):
        docs = spark.createDataFrame(table, "doc_id long, text string, lang string")
        assert {r["lang_pred"] for r in language_id.identify(docs, training).collect()} == {"aa"}
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identify(nothing, training).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), training).collect() == []


def brute_languages(rows, held_out, longest=4):
    """(language, score) per row by plain counting."""
    words, grams = {}, {}
    for k, text, lang in rows:
        if not held_out(k) and text and lang:
            for word in re.findall(r"[^\W\d_]+", text.lower()):
                words.setdefault(lang, Counter())[word] += 1
                marked = f"<{word}>"
                for n in range(1, longest + 1):
                    grams.setdefault(lang, Counter()).update(marked[i:i + n] for i in range(len(marked) - n + 1))
    names = sorted(words)
    lexicon = {w for c in words.values() for w in c}
    known_grams = {g for c in grams.values() for g in c}
    sizes = Counter(map(len, known_grams))

    def log_shares(counts, entry, totals):
        found = [math.log((counts[n][entry] + 0.5) / totals[n]) for n in names]
        return np.array(found) - max(found)

    def of_word(word):
        if word in lexicon:
            return log_shares(words, word, {n: sum(words[n].values()) + 0.5 * (len(lexicon) + 1) for n in names})
        marked, at, cover = f"<{word}>", 0, []
        while at < len(marked):
            piece = next((marked[at:e] for e in range(min(at + longest, len(marked)), at, -1)
                          if marked[at:e] in known_grams), None)
            at += len(piece) if piece else 1
            if piece:
                cover.append(log_shares(grams, piece, {
                    n: sum(c for g, c in grams[n].items() if len(g) == len(piece)) + 0.5 * (sizes[len(piece)] + 1)
                    for n in names}))
        return np.mean(cover, axis=0) if cover else np.zeros(len(names))

    out = {}
    for k, text, _ in rows:
        found = re.findall(r"[^\W\d_]+", (text or "").lower())
        if not found:
            out[k] = ("und", 0.0)
            continue
        means = sum(map(of_word, found)) / len(found)
        shares = np.exp((means - means.max()) * min(len(found), 10))
        out[k] = (names[int(means.argmax())], float(shares.max() / shares.sum()))
    return out


def test_language_scores_equal_plain_counting_however_few_words_are_shared(spark):
    draw = random.Random(6)
    makers = {"aa": "abcde", "bb": "cdefg", "cc": "efghi"}
    rows = []
    for k in range(150):
        lang = draw.choice(["aa", "aa", "aa", "bb", "cc"])
        text = " ".join("".join(draw.choices(makers[lang], k=draw.randint(1, 4))) for _ in range(draw.randint(1, 12)))
        rows.append((k, text, lang if k % 9 else None))
    rows += [(200, None, "aa"), (201, "12 !", "bb"), (202, "Zzz qqq", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    expected = brute_languages(rows, lambda k: zlib.crc32(str(k).encode()) % 3 == 1)
    for lexicon in (60_000, 12):
        got = language_id.identify(docs, remainder(F.col("doc_id"), 3) != 1, lexicon=lexicon).collect()
        assert len(got) == len(rows)
        for r in got:
            lang, score = expected[r["doc_id"]]
            assert math.isclose(r["score"], score, rel_tol=1e-3), (lexicon, r)
            assert r["lang_pred"] == lang or math.isclose(r["score"], 0.5, rel_tol=0.01)


def test_a_small_language_keeps_its_words_beside_a_large_one(spark):
    counts = spark.createDataFrame([("large", f"w{k}", 3) for k in range(7000)]
                                   + [("small", f"s{k}", 1) for k in range(30)], "lang string, word string, n long")
    kept = {r["word"] for r in language_id.frequent_per_language(counts, "word", 600).collect()}
    assert sum(w[0] == "s" for w in kept) == 30 and 500 < len(kept) < 640
    assert language_id.quotas({"a": 5, "b": 100, "c": 1000}, 300) == {"a": 5, "b": 100, "c": 195}


def test_unseen_words_fall_back_to_shorter_grams():
    model = language_id.BackoffModel(
        ["aa", "bb"], {"abc": {"aa": 5}}, {"ab": {"aa": 9}, "x": {"bb": 3}, "a": {"aa": 1}}, [5, 1], 3)
    names = {row: gram for gram, row in model.grams.items()}
    assert [names[row] for row in model.cover("abxa")] == ["ab", "x", "a"]
    assert model.cover("zz") == []


def test_the_driver_collects_no_row_object_for_a_shared_word(spark, monkeypatch):
    draw = random.Random(8)
    words = {lang: ["".join(draw.choices(letters, k=6)) for _ in range(1500)]
             for lang, letters in (("aa", "abcdef"), ("bb", "defghi"))}
    docs = spark.createDataFrame([(" ".join(words[lang][k:k + 50]), lang) for lang in words
                                  for k in range(0, 1500, 50)], "text string, lang string")
    sizes, kind = [], type(docs)
    plain = kind.collect

    def collect(frame):
        rows = plain(frame)
        sizes.append(len(rows))
        return rows

    monkeypatch.setattr(kind, "collect", collect)
    model, others = language_id.learn(docs, "text", "lang")
    assert sizes and max(sizes) < 500  # levels of a histogram; there are about 3,000 words
    counts = Counter((lang, word) for lang in words for word in words[lang])
    assert list(model.words) == sorted({word for _, word in counts})
    for word, row in model.words.items():
        logs = [math.log((counts[lang, word] + 0.5) / model.word_totals[k]) for k, lang in enumerate(["aa", "bb"])]
        assert np.allclose(model.table[row], np.array(logs) - max(logs), atol=1e-5)
    monkeypatch.undo()
    assert others.collect() == []


# Personal data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(number):
    total = 0
    for k, digit in enumerate(reversed(number)):
        value = int(digit) * (2 if k % 2 else 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def valid(kind, match):
    number = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(part) <= 255 for part in match.split("."))
    if kind == "card":
        return 13 <= len(number) <= 19 and luhn(number)
    return 9 <= len(number) <= 15 if kind == "phone" else True


def plain_spans(text):
    return [(kind, m.start(), m.end()) for kind in PLAIN for m in re.finditer(PLAIN[kind], text or "")
            if valid(kind, m.group())]


def test_base_spans_equal_the_plain_patterns(spark):
    draw = random.Random(7)
    parts = ["a@b.c", ".", "+", "1", "25", "255", "256", "4111 1111 1111 1111", "378282246310005", " ", "-",
             "@", "x.y", "(", ")", "0", "🙂", "é", "\n", "+49 151 2345678", "10.0.0.1", "00010.2.3.4"]
    texts = ["".join(draw.choices(parts, k=draw.randint(1, 14))) for _ in range(400)]
    texts += ["5" * 30000, "a" * 60000, "a.b" * 9000 + "@x.y", "1." * 8000, "+" * 5000, "", None,
              "a@b.c.d+e@f.g 1.2.3.4.5 1-2-3"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id int, text string, value string")
    got = pii.find_personal_data(docs, keep=["doc_id", "value"]).collect()
    assert len(got) == len(texts)
    for r in got:
        assert [tuple(s) for s in r["base"]] == plain_spans(texts[r["doc_id"]]), texts[r["doc_id"]][:200]
        assert set(map(tuple, r["base"])) <= set(map(tuple, r["spans"]))
    assert pii.find_personal_data(docs.limit(0), keep=["doc_id"]).collect() == []


def test_patterns_discover_unseen_identifiers(spark):
    rows = [(k, f"Please call hotline: +1 555 010 {1000 + k} today") for k in range(30)]
    rows += [(100, "Please call hotline: 555-010-7777 today"), (101, "Order number 555-010-8888 shipped"),
             (102, "nothing here"), (103, "We ship item 12345678 to you")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r["doc_id"]: r for r in pii.find_personal_data(docs).collect()}
    assert [tuple(s) for s in got[100]["spans"]] == [("phone", 21, 33)] and got[100]["base"] == []
    assert got[101]["spans"] == got[102]["spans"] == got[103]["spans"] == []
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(docs).collect()}
    assert clean[100] == "Please call hotline: [PHONE] today" and clean[0] == clean[100]
    assert clean[102] == "nothing here"


def test_identifiers_behind_labels_brackets_and_quotes_are_discovered(spark):
    rows = [(k, f"Write to email: bob{k}@mail.org now, or phone: +1 555 010 {1000 + k} now") for k in range(60)]
    forms = ["email:bob2@localhost", "email: <bob3@localhost>", 'email: "bob4@localhost"', "email=x",
             "phone:5550102233", "phone: 030 1234 567", "phone: (030) 1234567", "phone: " + "5" * 200]
    rows += [(100 + k, f"Write to {form} now") for k, form in enumerate(forms)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id int, text string, base int, spans string")
    got = {r["doc_id"]: [dict(rows)[r["doc_id"]][s["start"]:s["end"]] for s in r["spans"]]
           for r in pii.find_personal_data(docs).collect() if r["doc_id"] >= 100}
    assert got == {100: ["bob2@localhost"], 101: ["bob3@localhost"], 102: ["bob4@localhost"], 103: [],
                   104: ["5550102233"], 105: ["030 1234 567"], 106: ["(030) 1234567"], 107: ["5" * 200]}
    clean = {r["doc_id"]: r for r in pii.redacted(docs).collect()}
    assert clean[101]["text"] == "Write to email: <[EMAIL]> now" and clean[101]["base"] == 1


def test_a_text_with_thousands_of_addresses(spark):
    text = " ".join(f"é a{k}@b.org" for k in range(6000))
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert [tuple(s) for s in pii.find_personal_data(docs).first()["spans"]] == plain_spans(text)
    assert pii.redacted(docs).first()["text"] == " ".join(["é [EMAIL]"] * 6000)


def test_redaction_covers_overlaps_and_keeps_nulls(spark):
    docs = spark.createDataFrame([(1, "x a@1.2.3.4 🙂 y", 0), (2, None, 0), (2, None, 0)],
                                 "doc_id int, text string, spans int")
    got = sorted(((r["doc_id"], r["text"]) for r in pii.redacted(docs).collect()), key=str)
    assert got == [(1, "x [EMAIL] 🙂 y"), (2, None), (2, None)]


# Language-model scoring

def test_unigram_scores_and_counts(spark):
    draw = random.Random(8)
    rows = [(k, " ".join(draw.choice("ABCDEFG") * draw.randint(1, 3) for _ in range(draw.randint(0, 30))), 1.0)
            for k in range(120)] + [(200, None, 1.0), (201, "", 1.0), (202, "neverseen É x", 1.0)]
    rows.append(rows[0])
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = lm_scoring.score_documents(docs, remainder(F.col("doc_id"), 7) == 2, head_words=6, rounds=1).collect()
    assert len(got) == len(rows)

    def tokens(text):
        return [*(w.decode() for w in (text or "").encode().lower().split()), "\n"]

    counts = Counter()
    for k, text, _ in rows:
        if zlib.crc32(str(k).encode()) % 7 != 2:
            counts.update(tokens(text))
    whole, kinds, texts = sum(counts.values()), len(counts), {r[0]: r[1] for r in rows}
    for r in got:
        found = tokens(texts[r["doc_id"]])
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert (r["n_tokens"], r["train_tokens"]) == (len(found), whole)
        assert r["n_known"] == sum(counts[w] > 0 for w in found)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (whole + kinds + 1)) for w in found))
        assert r["score"] < 0
    assert lm_scoring.score_documents(docs.limit(0), F.lit(False)).collect() == []


def test_training_improves_on_shares_and_gradients_are_right():
    draw = np.random.default_rng(2)
    stream = np.tile(np.array([2, 3, 4, 5, 0], np.int32), 5000)
    network = lm_scoring.Gru(np.bincount(stream, minlength=8).astype(float))
    documents = [np.array([2, 3, 4, 5, 0], np.int32)] * 3
    before = network.score(documents)[0]
    after = network.train(stream, lanes=8, window=16).score(documents)[0]
    assert after > before / 2
    states = draw.normal(size=(6, lm_scoring.HIDDEN))
    tokens = np.array([0, 1, 2, 3, 7, 0])
    _, back, grads = network.log_shares(states, tokens, gradient=True)

    def loss():
        return -network.log_shares(states, tokens).mean()

    for array, grad, place in ((states, back, (2, 5)), (network.to_class, grads["to_class"], (3, 0)),
                               (network.to_word, grads["to_word"], (0, 4, 2))):
        old, step = array[place], 1e-2
        array[place] = old + step
        up = loss()
        array[place] = old - step
        slope = (up - loss()) / (2 * step)
        array[place] = old
        assert math.isclose(slope, grad[place], rel_tol=0.05, abs_tol=2e-4)


def test_weights_in_place_move_as_plain_adam_moves_them():
    draw = np.random.default_rng(6)
    weights = draw.normal(size=40_000).astype(np.float32)
    plain, first, second = weights.astype(float), 0.0, 0.0
    adam = lm_scoring.Adam(weights, 0.01)
    for turn in range(1, 6):
        gradient = draw.normal(size=40_000) * (10 if turn == 2 else 1e-4)
        g = gradient * min(1.0, 1 / np.sqrt((gradient ** 2).sum()))
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        plain -= 0.01 / (1 - 0.9 ** turn) * first / (np.sqrt(second / (1 - 0.99 ** turn)) + 1e-7)
        adam.step(gradient.astype(np.float32), turn)
        assert np.allclose(weights, plain, atol=1e-5)


def test_sums_of_tokens_class_by_class():
    draw = np.random.default_rng(9)
    network = lm_scoring.Gru(np.ones(150))
    tokens = np.sort(draw.choice([0, 1, 63, 64, 149], 700))
    rows = draw.normal(size=(700, 3 * lm_scoring.HIDDEN)).astype(np.float32)
    plain = np.zeros((150, 3 * lm_scoring.HIDDEN))
    np.add.at(plain, tokens, rows)
    assert np.allclose(network.sums_of_tokens(tokens, rows), plain, atol=1e-4)


def test_one_window_moves_the_network_along_the_slope_of_its_loss():
    draw = np.random.default_rng(12)
    stream = draw.choice([0, 2, 3, 4, 5], 40, p=[0.1, 0.3, 0.3, 0.2, 0.1])

    def loss(network):
        state, total = np.zeros((1, lm_scoring.HIDDEN)), 0.0
        for token in stream:
            total -= network.log_shares(state, np.array([token]))[0]
            given, carried = network.inputs[token], state @ network.recurrent
            update, reset = (1 / (1 + np.exp(-(given + carried)[0, k * 32:k * 32 + 32])) for k in (0, 1))
            fresh = np.tanh(given[64:] + reset * carried[0, 64:])
            state = (update * state + (1 - update) * fresh) * (token != 0)
        return total / len(stream)

    seen = {}
    network, plain = (lm_scoring.Gru(np.ones(6)) for _ in range(2))
    for name in network.NAMES:
        setattr(plain, name, getattr(plain, name).astype(float))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(lm_scoring.Adam, "step", lambda self, gradient, turn: seen.update(all=gradient))
        network.train(stream, lanes=1, window=40)
    at = 0
    for name in network.NAMES:
        weights = getattr(plain, name)
        own, at = seen["all"][at:at + weights.size].reshape(weights.shape), at + weights.size
        place = np.unravel_index(np.abs(own).argmax(), own.shape)
        for k in (1e-5, -2e-5):
            weights[place] += k
            seen[k] = loss(plain)
        weights[place] += 1e-5
        assert np.isclose((seen[1e-5] - seen[-2e-5]) / 2e-5, own[place], rtol=1e-3, atol=1e-6), name


def test_state_is_carried_across_windows_and_lanes():
    draw = np.random.default_rng(3)
    network = lm_scoring.Gru(np.ones(150))
    documents = [np.append(draw.integers(1, 150, draw.integers(0, 90)), 0).astype(np.int32) for _ in range(40)]
    one = network.score(documents, lanes=7, window=5)
    alone = [network.score([d], window=1000)[0] for d in documents]
    assert np.allclose(one, alone, rtol=1e-4)
    shares = [np.exp(network.score([np.array([k, 0], np.int32)])[0]
                     - 0) for k in range(1, 3)]
    assert all(0 < s < 1 for s in shares)
    every = np.exp(network.log_shares(np.zeros((150, lm_scoring.HIDDEN), np.float32), np.arange(150)))
    assert math.isclose(every.sum(), 1, rel_tol=1e-4)


def test_every_training_token_trains_the_network(spark):
    draw = random.Random(4)
    rows = [(k, " ".join(draw.choice("abcdefgh") for _ in range(draw.randint(0, 60)))) for k in range(400)]
    rows += [rows[0]] * 50 + [(None, None), (None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts, totals, vocabulary = lm_scoring.fit(docs, "text")
    index = vocabulary.place
    passed = spark.createDataFrame(
        [(k, number, np.array([*(index[w.encode()] + 2 for w in (text or "").split()), 0], "<u2").tobytes())
         for number, (k, text) in enumerate(rows)], "id long, row long, tokens binary")
    whole = sum(len((text or "").split()) + 1 for _, text in rows)
    for rounds in (1, 3):
        network, trained = lm_scoring.fit_network(passed, totals, vocabulary, trainer_tokens=700, rounds=rounds)
        assert trained == totals["tokens"] == whole


def test_no_token_of_a_stream_is_left_out():
    # 64 lanes of 32 tokens and 63 more: those of the last, the only ones of their kind, are learned too.
    stream = np.append(np.full(64 * 32, 2), np.full(63, 5)).astype(np.int32)
    network = lm_scoring.Gru(np.ones(8))
    before = network.inputs[5].copy()
    network.train(stream, lanes=64, window=32)
    assert not np.allclose(network.inputs[5], before)


def test_logits_are_worked_on_in_blocks_and_are_exact():
    draw = np.random.default_rng(14)
    network, n = lm_scoring.Gru(draw.integers(1, 900, 300).astype(float)), 40_000
    states = draw.uniform(-1, 1, (n, lm_scoring.HIDDEN)).astype(np.float32)
    tokens = np.minimum(draw.geometric(0.02, n), 299)
    tracemalloc.start()
    found = network.log_shares(states, tokens)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < n * lm_scoring.PER_CLASS * 4  # never the logits of all rows
    for factor in (1, 40):  # large weights need the largest logit of a row taken off
        for name in ("to_class", "to_word"):
            setattr(network, name, getattr(network, name).astype(float) * factor)
        found, back, grads = network.log_shares(states[:3000].astype(float), tokens[:3000], gradient=True)
        classes, places = np.divmod(tokens[:3000], lm_scoring.PER_CLASS)
        for place, weights, bias in ((classes, network.to_class[None], network.class_bias[None]),
                                     (places, network.to_word[classes], network.word_bias[classes])):
            logits = np.einsum("nh,nhk->nk", states[:3000], np.broadcast_to(weights, (3000, *weights.shape[1:]))) + bias
            logits -= logits.max(axis=1, keepdims=True)
            shares = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
            found = found - np.log(shares[np.arange(3000), place])
            shares[np.arange(3000), place] -= 1
            back = back - np.einsum("nk,nhk->nh", shares, np.broadcast_to(weights, (3000, *weights.shape[1:]))) / 3000
            name = "class" if place is classes else "word"
            plain = np.zeros_like(grads[f"to_{name}"].reshape(-1, *weights.shape[1:]), dtype=float)
            np.add.at(plain, classes if name == "word" else 0 * classes, states[:3000, :, None] * shares[:, None] / 3000)
            assert np.allclose(plain.reshape(grads[f"to_{name}"].shape), grads[f"to_{name}"], atol=1e-6)
        assert np.abs(found).max() < 1e-3 and np.abs(back).max() < 1e-5


def test_a_bias_far_below_its_class_gives_finite_gradients():
    network = lm_scoring.Gru(np.ones(150))
    network.word_bias[0, 5] = network.class_bias[2] = -300
    states, tokens = np.full((4, lm_scoring.HIDDEN), 0.5, np.float32), np.array([5, 130, 6, 70])
    with np.errstate(divide="raise", over="raise", invalid="raise"):
        found, back, grads = network.log_shares(states, tokens, gradient=True)
    assert np.isfinite(found).all() and np.isfinite(back).all() and (found < 0).all()
    assert all(np.isfinite(grad).all() for grad in grads.values())


def test_words_of_many_rows_are_those_of_each():
    texts = ["".join(f"{chr(k)}aB" for k in range(128)), "", " ", "\n x  y\t", "É Q z\x1cK\x85 b\u2003c", "  A"]
    plain = [[w.decode() for w in text.encode().lower().split()] for text in texts]
    for some in (slice(0, 6), slice(1, 3), slice(2, 5), slice(0, 0)):
        words, lengths = lm_scoring.words_of_rows(pa.array(texts, pa.string())[some])
        assert lengths.tolist() == [len(row) for row in plain[some]]
        assert words.to_pylist() == [word for row in plain[some] for word in row]


# Pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head>
<body class="page-header"><header id="top"><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, really, many, of them.</p></div>
<div id="wrap"><div class="sidebar"><p>Side, text, with, many, commas, in, it, for, points.</p></div>
%s
<div id="comments"><p>I disagree, strongly, with all, of this, and more, of it.</p></div></div>
<form><p>Subscribe, now, please.</p><input></form><footer><p>&copy; 2020, all, rights.</p></footer></body></html>"""
BODY = ("<h2>A &amp; B</h2><p>First <b>bold</b> text,\n with   commas, and a <a href=x>link</a>.<br>Next line.<p>Second "
        "&eacute;&#233;&nbsp;x &lt;i&gt;<ul><li>one<li>two</ul><blockquote>quoted</blockquote>")
TEXT = "A & B\nFirst bold text, with commas, and a link. Next line.\nSecond éé x <i>\none\ntwo\nquoted"


@pytest.mark.parametrize("article", ["<article>%s</article>", "<div class='post'>%s</div>",
                                     "<main><section>%s</section></main>"])
def test_article_is_found_among_furniture(article):
    assert html_extraction.main_text(PAGE % (article % BODY)) == TEXT


def test_layout_classes_around_an_article_do_not_hide_it():
    page = ("<div class='layout with-sidebar'><article><div class='post-header'><h1>Title</h1></div><p>Text, here."
            "<div class='ad'>Buy, this.</div><p>More.</article><article class='comment'><p>No, not, at, all."
            "</article><div class='sidebar'><p>x, y, z</div></div>")
    assert html_extraction.main_text(page) == "Title\nText, here.\nMore."


@pytest.mark.parametrize("article", ["<article>%s</article>", "<div class='post'>%s</div>"])
def test_slugs_in_an_article_hide_nothing(article):
    long = "Words, of the section, that go on, and on, and on, until they are, by far, more than a label has."
    body = (f"<h2 id='related-work'>Related</h2><p class='notice'>One, two, {long}</p><h3 id='social-impact'>Impact</h3>"
            f"<p>A <span class='search-term'>term</span>, <a id='reply-2'>here</a>, {long}</p>"
            f"<section id='discussion'><h2>Discussion</h2><p>{long}</p></section><div class='share'>Share, it</div>")
    assert html_extraction.main_text(PAGE % (article % body)).split("\n") == [
        "Related", f"One, two, {long}", "Impact", f"A term, here, {long}", "Discussion", long]


def test_what_stands_between_kept_siblings_is_kept():
    text = "<p>Text, with, many, commas, in, it, for, points, and, more, of, them.</p>"
    page = (f"<body><div>{text * 3}</div><h3>Next</h3><ul><li>one<li>two</ul><table><tr><td>x</table>"
            f"<p>Last, of, all.</p><ul><li>after</ul>")
    assert html_extraction.main_text(page).split("\n")[3:] == ["Next", "one", "two", "x", "Last, of, all."]


@pytest.mark.parametrize("page", [
    "<html><head><title>T</title><body><p>One, two.</p>", "<head><style>p{}</style><div><p>One, two.</div>"])
def test_an_unclosed_head_ends_where_the_body_begins(page):
    assert html_extraction.main_text(page) == "One, two."


def test_pages_one_by_one(spark):
    deep = "<div>" * 3000 + "<p>deep, text</p>" + "</div>" * 3000
    rows = [(1, "u", PAGE % ("<article>" + BODY + "</article>"), 0), (1, "u", "<p>x", 0), (2, None, None, 0),
            (3, "u", "", 0), (4, "u", "<nav>a</nav>", 0), (5, "u", "plain text", 0), (6, "u", deep, 0),
            (7, "u", "<article><p>cut off, he", 0), (8, "u", "<article><p>open tag <a hre", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in
                  html_extraction.extract_main_text(pages).collect()), key=str)
    texts = [(1, TEXT), (1, "x"), (2, ""), (3, ""), (4, ""), (5, "plain text"), (6, "deep, text"),
             (7, "cut off, he"), (8, "open tag")]
    assert got == sorted(((i, t, len(t)) for i, t in texts), key=str)
    assert html_extraction.extract_main_text(pages.limit(0)).collect() == []


def test_long_articles_are_kept_whole():
    parts = [f"Paragraph {k}, with some words" + ", and more" * (k % 7) for k in range(2000)]
    page = PAGE % ("<article>" + "".join(f"<p>{p}</p>" for p in parts) + "</article>")
    assert html_extraction.main_text(page) == "\n".join(parts)


WRAPPERS = ["", "class='post-with-comments'", "class='wrap content-sidebar'", "class='elementor-widget'",
            "id='main-search'", "class='container banner-top'", "class='share-layout search-page'",
            "class='page layout'", "role='banner'"]
BOXES = ["<div class='sidebar'><p>%s</p></div>", "<aside><p>%s</p></aside>", "<nav><a href='#'>%s</a></nav>",
         "<div class='share'><a href='#'>%s</a></div>", "<ul class='menu'><li><a href='/'>%s</a></li></ul>",
         "<footer><p>%s</p></footer>", "<form><p>%s</p><input></form>", "<div class='promo'><p>%s</p></div>",
         "<script>var x = '%s';</script>"]
COMMENTS = "<div class='comments'>%s</div>"


def made_page(draw):
    """A page and the text of its article, by construction."""
    def words(n):
        return " ".join("".join(draw.choices("abcdefghij", k=draw.randint(3, 9))) for _ in range(n))

    def around():
        return "".join(box % words(3) for box in draw.sample(BOXES, draw.randint(0, 3)))

    paragraphs = [f"{words(draw.randint(15, 40))}, {words(draw.randint(5, 20))}, {words(6)}."
                  for _ in range(draw.randint(3, 8))]
    article = "<div class='text'>%s</div>" % "".join(f"<p>{p}</p>" for p in paragraphs)
    if draw.random() < 0.5:
        article += COMMENTS % "".join(f"<p>{words(12)}, {words(8)}.</p>" for _ in range(draw.randint(1, 20)))
    for _ in range(draw.randint(1, 3)):
        article = f"{around()}<div {draw.choice(WRAPPERS)}>{around()}{article}{around()}</div>{around()}"
    if draw.random() < 0.3:  # one form around the whole page, as some servers make them
        article = article.replace("<form><p>", "<div class='login'><p>").replace("<input></form>", "</div>")
        article = f"<form action='/'>{article}<input type='hidden'></form>"
    return f"<html><head><title>{words(2)}</title></head><body>{article}</body></html>", "\n".join(paragraphs)


def test_articles_in_wrappers_named_like_furniture():
    draw = random.Random(11)
    for _ in range(600):
        page, text = made_page(draw)
        assert html_extraction.main_text(page) == text, page


def test_comments_longer_than_the_article_stay_out():
    page, text = made_page(random.Random(5))
    comments = COMMENTS % ("<p>Very long comment, of a reader, who goes on and on.</p>" * 200)
    assert html_extraction.main_text(page.replace("</body>", comments + "</body>")) == text
