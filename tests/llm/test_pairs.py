"""Joins and searches against brute force, with copies, hot groups, nulls and clashing column names."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlake.llm import embedding_dedup, ngram_join, topk_search
from barlake.llm.common import connected_components, most_frequent

TEXTS = "doc_id long, text string, node string, sign string, row int, n_links int"


def as_docs(spark, rows):
    """Rows of (id, text) with further columns named as the operator's own."""
    return spark.createDataFrame([(i, t, "x", "y", 1, -1) for i, t in rows], TEXTS)


def classes_of(links, ids):
    parent = {i: i for i in ids}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def shingles(text, n=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[k:k + n]) for k in range(max(len(words) - n + 1, 1))} if words else set()


def brute_force(rows, threshold=0.8):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
             if sets[a] and sets[b]
             and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    return links, classes_of(links, ids)


def near_copies(draw, words, copies, edits):
    """Texts that differ from one another in a few words."""
    made = []
    for _ in range(copies):
        text = list(words)
        for _ in range(draw.randint(0, edits)):
            text[draw.randrange(len(text))] = f"w{draw.randrange(10 ** 6)}"
        made.append(" ".join(text))
    return made


def test_ngram_join_equals_brute_force(spark):
    draw = random.Random(3)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = []
    for size, copies, edits in ((300, 60, 6), (120, 25, 3), (40, 12, 2), (8, 6, 1), (6, 4, 1)):
        texts += near_copies(draw, draw.choices(vocabulary, k=size), copies, edits)
    passage = " ".join(draw.choices(vocabulary, k=60))
    texts += [passage + " " + " ".join(draw.choices(vocabulary, k=60)) for _ in range(30)]
    texts += ["one two", "ONE  two", "", " \n", "same text here of five", "same text here of five"]
    rows = list(enumerate(texts))
    draw.shuffle(rows)
    links, classes = brute_force(rows)
    got = ngram_join.near_duplicates(as_docs(spark, rows + [(900, None)]), tile_rows=16).collect()
    assert {r["doc_id"] for r in got} == {i for i, _ in rows} | {900} and len(got) == len(rows) + 1
    degree = {i: 0 for i in classes}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    assert len(links) > 300
    for r in got:
        if r["doc_id"] == 900:
            assert (r["class_id"], r["n_links"], r["kept"]) == (900, 0, True)
        else:
            assert r["n_links"] == degree[r["doc_id"]]
            assert r["class_id"] == classes[r["doc_id"]]
            assert r["kept"] == (r["class_id"] == r["doc_id"])


def test_ngram_join_keeps_one_of_repeated_rows_and_takes_empty_tables(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "x y"), (3, "")]
    got = ngram_join.near_duplicates(as_docs(spark, rows), keep=["doc_id", "text", "n_links"])
    assert got.columns[:3] == ["doc_id", "text", "n_links"]
    kept = got.filter("kept").collect()
    assert sorted((r[0], r[1]) for r in kept) == [(1, "a b c d e f"), (2, "x y"), (3, "")]
    assert ngram_join.near_duplicates(as_docs(spark, [])).collect() == []


def test_ngram_join_collects_nothing_per_document(spark, monkeypatch):
    draw = random.Random(3)
    rows = []
    for k in range(150):
        words = [f"v{draw.randrange(10 ** 6)}" for _ in range(60)]
        rows += [(None if k == 0 else 2 * k, " ".join(words)), (2 * k + 1, " ".join([*words, "end"]))]
    docs, collected = as_docs(spark, rows), []
    joined = type(docs)
    plain = joined.collect

    def watched(frame):
        found = plain(frame)
        collected.append(sum(len(x) if isinstance(x, (list, str, bytes)) else 1 for r in found for x in r))
        return found

    monkeypatch.setattr(joined, "collect", watched)
    result = ngram_join.near_duplicates(docs)
    assert sum(collected) < 100
    monkeypatch.undo()
    assert {(r["doc_id"], r["class_id"], r["n_links"]) for r in result.collect()} == {
        (i, (1 if i in (None, 1) else i - i % 2), 1) for i, _ in rows}


def test_pruning_steps_keep_pairs_at_the_threshold():
    steps = ngram_join.least_matches(0.8, 1e-6)
    assert [n for n, _ in steps] == list(range(16, 97, 16))
    draw = np.random.default_rng(1)
    lost = 0
    for _ in range(3000):
        matches = draw.random(96) < 0.8
        lost += any(matches[:n].sum() < m for n, m in steps)
    assert lost == 0


@pytest.mark.parametrize("tile_rows", [8, 1024])
def test_embedding_dedup_equals_brute_force(spark, tile_rows):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(12, 16))
    rows = []
    for k in range(260):
        vector = centres[k % 12] + draw.normal(size=16) * (0.02 if k % 3 else 0.2)
        rows.append((k, [float(np.float32(x)) for x in vector * draw.choice([0.01, 1, 500])], k % 2))
    rows += [(300 + k, rows[0][1], 0) for k in range(40)]  # a hot group of copies
    odd = [(400, None, 0), (401, [], 0), (402, [0.0] * 16, 0), (403, [math.nan] * 16, 0),
           (404, [math.inf] + [0.0] * 15, 0), (405, rows[0][1], None), (406, rows[0][1], None),
           (407, [1.0, 0.0], 0), (408, [2.0, 0.0], 0), (409, [None] + [1.0] * 15, 0)]
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    label = {i: part for i, _, part in rows}
    links = [(a, b) for a in unit for b in unit
             if a < b and label[a] == label[b] and float(unit[a] @ unit[b]) >= 0.98] + [(407, 408)]
    ids = [*unit, *(row[0] for row in odd)]
    classes = classes_of(links, ids)
    degree = {i: sum(i in link for link in links) for i in ids}
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    got = embedding_dedup.near_duplicates(table.withColumn("copies", F.lit(1)), tile_rows=tile_rows).collect()
    assert sorted(r["vec_id"] for r in got) == sorted(ids)
    assert {r["vec_id"]: r["n_links"] for r in got} == degree
    assert {r["vec_id"]: r["component_id"] for r in got} == classes
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert len(links) > 1000


def test_embedding_dedup_with_null_and_very_large_ids(spark):
    big = 2 ** 60
    rows = [(None, [1.0, 0.0], "a"), (big + 1, [1.0, 0.01], "a"), (big + 3, [1.0, 0.02], "a"),
            (None, [0.0, 1.0], "a"), (None, [0.01, 1.0], "a"), (7, [-1.0, 0.0], "a"), (7, [-1.0, 0.0], "a"),
            (None, None, "a"), (big + 5, [1.0, 0.0], None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = sorted((tuple(r) for r in embedding_dedup.near_duplicates(frame).collect()), key=repr)
    assert got == sorted([
        (None, 2, big + 1, False), (big + 1, 2, big + 1, True), (big + 3, 2, big + 1, False),
        (None, 1, None, True), (None, 1, None, True), (7, 1, 7, True), (7, 1, 7, True),
        (None, 0, None, True), (big + 5, 0, big + 5, True)], key=repr)


def test_common_counts_in_ranges_equal_set_intersections(monkeypatch):
    draw = np.random.default_rng(2)
    pool = draw.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2)
    sets = [np.unique(draw.choice(pool, n)) for n in (0, 1, 5, 80, 300, 300, 700)]
    expected = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    for most in (10, 200, 10_000):
        monkeypatch.setattr(ngram_join, "SHINGLES", most)
        counts = ngram_join.common_counts(sets)
        assert all(counts[i, j] == expected[i][j] for i in range(7) for j in range(7) if i != j)


def test_embedding_dedup_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_duplicates(empty).collect() == []


def test_suffix_bounds_drop_no_pair():
    draw = np.random.default_rng(8)
    x = draw.normal(size=(80, 40))
    x[40:] = x[:40] + draw.normal(size=(40, 40)) * 0.12
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    i, j = embedding_dedup.linked_pairs(x, x, axes, 0.98, True)
    expected = np.nonzero(np.triu(x @ x.T >= 0.98, 1))
    assert sorted(zip(i, j)) == sorted(zip(*expected)) and len(i) > 10


def test_search_equals_brute_force(spark):
    draw = np.random.default_rng(6)
    rows = [(k, [float(np.float32(x)) for x in draw.normal(size=8)]) for k in range(230)]
    rows += [(300 + k, rows[7][1]) for k in range(60)]  # ties beyond k
    odd = [(400, None), (420, []), (440, [math.nan] * 8), (460, [1.0, 2.0]), (480, [None] * 8)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = {}
    for r in topk_search.search(table.withColumn("cell", F.lit(1)), pivots=9, block_rows=16).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    cut = {i: np.floor(64 * np.array(v)).astype(int) for i, v in rows}
    for query in [i for i in cut if i % 20 == 0]:
        best = sorted((-int(cut[query] @ v), i) for i, v in cut.items() if i != query)[:20]
        assert sorted(got.pop(query)) == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert not got


def test_search_with_repeated_query_and_candidate_rows(spark):
    draw = np.random.default_rng(9)
    vectors = {i: draw.integers(-64, 65, 4) / 64 for i in range(200)}
    rows = [(i, v.tolist()) for i, v in vectors.items() for _ in range(5 if i % 20 == 0 else 1 + i % 2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk_search.search(table, pivots=5, block_rows=16).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = [(i, np.floor(np.array(v) * 64).astype(int)) for i, v in rows]
    assert sorted(got) == list(range(0, 200, 20))
    for query, found in got.items():
        own = np.floor(vectors[query] * 64).astype(int)
        best = sorted((-int(own @ v), i) for i, v in whole if i != query)[:20]
        assert sorted(found) == [(k, i, -score) for k, (score, i) in enumerate(best, 1)]


def test_a_hot_cell_is_searched_in_groups_of_bounded_size(spark, monkeypatch, tmp_path):
    """One cell, candidates of one id, many queries: no product may meet many rows of either side."""
    place = str(tmp_path)
    plain = topk_search.products

    def watched(left, right):
        import uuid
        with open(f"{place}/{uuid.uuid4()}", "w") as out:
            out.write(f"{len(left)} {len(right)}")
        return plain(left, right)

    monkeypatch.setattr(topk_search, "products", watched)
    rows = [(20 * i, [1.0, i / 64]) for i in range(400)] + [(7, [0.5, 0.5])] * 400
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk_search.search(table, pivots=1, block_rows=32).collect()
    assert len(got) == 400 * 20
    sizes = np.array([list(map(int, x.read_text().split())) for x in tmp_path.iterdir()])
    assert len(sizes) and sizes.max() < 4 * 32


def test_search_with_few_candidates_or_none(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 1.0]), (1, [1.0, 0.0]), (2, [-1.0, 0.5])], schema)
    got = topk_search.search(few).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 4096), (2, -2048)]
    assert topk_search.search(spark.createDataFrame([], schema)).collect() == []
    assert topk_search.search(spark.createDataFrame([(0, [1.0])], schema)).collect() == []


def test_scores_beyond_double_precision_are_exact():
    x = np.array([[2 ** 30 + 1, 2 ** 30 - 1]], dtype=np.int64)
    assert topk_search.products(x, x).tolist() == [[(2 ** 30 + 1) ** 2 + (2 ** 30 - 1) ** 2]]


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(40)]
    star = [(100, 100 + k) for k in range(1, 30)]
    edges = spark.createDataFrame(chain + star + [(7, 7), (500, 499), (499, 500)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges, "test").collect()}
    assert got == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(30)}, 499: 499, 500: 499}
    assert connected_components(edges.limit(0), "test").collect() == []


def test_components_of_a_hot_star(spark):
    star = spark.range(1, 3000).select(F.lit(5000).cast("long").alias("a"), F.col("id").alias("b"))
    tail = spark.range(6000, 6040).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = connected_components(star.unionByName(tail), "test").groupBy("component").count().collect()
    assert {r["component"]: r["count"] for r in got} == {1: 3000, 6000: 41}


def test_most_frequent_cuts_where_counts_differ(spark):
    counts = spark.createDataFrame([("a", 100), ("b", 50), ("c", 3), ("d", 3), ("e", 3)], "word string, n long")
    assert {r["word"] for r in most_frequent(counts, 4).collect()} == {"a", "b"}
    assert most_frequent(counts, 5).count() == 5
    assert most_frequent(counts.limit(0), 5).count() == 0
