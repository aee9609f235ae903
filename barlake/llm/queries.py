"""One query per operator over the whole of its table, and the SQL that some of them equal."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm import (
    byte_bpe,
    embedding_dedup,
    html_extraction,
    language_id,
    lm_scoring,
    mixing,
    ngram_join,
    pii,
    prefix_trie,
    quality,
    secret_scan,
    structure_repair,
    topk_search,
)
from barlake.llm.common import remainder

BPE_RANKS = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_ngram_join(spark, folder):
    return ngram_join.near_duplicates(table(spark, folder, "documents"))


def op2_mix_sources(spark, folder):
    """How many words the mix takes of each document; rows that are repeated appear as often."""
    mix = mixing.mix(table(spark, folder, "documents"))
    times = F.col("times") + (F.col("row") <= F.col("more")).cast("bigint")
    return (mix.withColumn("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))))
            .select("doc_id", "source", "size", "source_size", "target",
                    (F.col("size") * times).alias("taken"), times.alias("times")))


def op3_byte_bpe(spark, folder):
    return byte_bpe.encode_documents(table(spark, folder, "documents"),
                                     public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


def op4_quality(spark, folder):
    """Documents by source and language, judged with the labels that some of them have."""
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_language_id(spark, folder):
    docs = table(spark, folder, "documents")
    held_out = remainder(F.col("doc_id"), 3) == 1
    predicted = language_id.identify(docs.select("doc_id", "text", "lang"), ~held_out, keep=["doc_id"])
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_pii(spark, folder):
    """Counts and places of personal data; base spans apart from all spans."""
    found = pii.find_personal_data(table(spark, folder, "documents"), keep=["doc_id"])

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select("doc_id", *[count(kind).alias(f"n_{kind}") for kind in pii.KINDS],
                        F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"),
                        pii.spans_text(F.col("spans")).alias("spans"))


def op7_lm_score(spark, folder):
    docs = table(spark, folder, "documents")
    return lm_scoring.score_documents(docs, remainder(F.col("doc_id"), 7) == 2)


def op8_embedding_dedup(spark, folder):
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


def op9_topk_search(spark, folder):
    return topk_search.search(table(spark, folder, "embeddings"))


def op10_html(spark, folder):
    return html_extraction.extract_main_text(table(spark, folder, "pages"))


def op11_secret_scan(spark, folder):
    """Counts and places of secrets; the spans of the base rules apart from all spans."""
    rules = secret_scan.BASE_RULES + secret_scan.MORE_RULES
    found = secret_scan.find_secrets(table(spark, folder, "documents"), rules, keep=["doc_id"])
    base = F.filter("secrets", lambda s: s["kind"] < len(secret_scan.BASE_RULES))
    counts = [F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{rule.kind}")
              for k, rule in enumerate(secret_scan.BASE_RULES)]
    return found.select("doc_id", *counts, F.sha2(secret_scan.spans_text(base, rules), 256).alias("base_sha256"),
                        secret_scan.spans_text(F.col("secrets"), rules).alias("spans"))


def op12_prefix_trie(spark, folder):
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))


def op13_structure_repair(spark, folder):
    return structure_repair.repair(table(spark, folder, "conversations"))


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_mix_sources": op2_mix_sources,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_quality": op4_quality,
    "op5_language_id": op5_language_id,
    "op6_pii": op6_pii,
    "op7_lm_score": op7_lm_score,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_topk_search": op9_topk_search,
    "op10_html": op10_html,
    "op11_secret_scan": op11_secret_scan,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_structure_repair": op13_structure_repair,
}

# Links between rows of `pairs(a, b)`, the classes they make, and one row per row of `items(id)`.
_CLASSES = """
    ends AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
    reach(id, other) AS (
        SELECT a, b FROM ends UNION SELECT r.id, l.b FROM reach r JOIN ends l ON l.a = r.other),
    classes AS (SELECT id, least(id, min(other)) AS first FROM reach GROUP BY id),
    degrees AS (SELECT a AS id, count(*) AS n FROM ends GROUP BY a),
    final AS (
        SELECT items.id, coalesce(degrees.n, 0) AS n_links, coalesce(classes.first, items.id) AS first
        FROM items LEFT JOIN degrees USING (id) LEFT JOIN classes USING (id))"""



def _crc32(text: str) -> str:
    """Unsigned crc32 of an ASCII text."""
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
        string_split({text}, ''), lambda c: ascii(c)::BIGINT)), lambda crc, byte: list_reduce(
        [xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda x, _: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT)"""


def _secrets_sql() -> str:
    """Spans of every rule: matches and the parts between them, whose lengths add up to the places."""
    parts = []
    for k, rule in enumerate(secret_scan.BASE_RULES + secret_scan.MORE_RULES):
        pattern = "'" + rule.pattern.replace("'", "''") + "'"
        parts.append(f"""
        SELECT rid, {k} AS kind, '{rule.kind}' AS name, list_sum(gaps[1:i]) + coalesce(list_sum(sizes[1:i - 1]), 0) AS start,
            list_sum(gaps[1:i]) + list_sum(sizes[1:i]) AS "end"
        FROM (SELECT *, unnest(range(1, len(sizes) + 1)) AS i FROM (
            SELECT rid, [length(m) for m in regexp_extract_all(body, {pattern})] AS sizes,
                [length(g) for g in regexp_extract_all(body, {pattern}, {rule.group})] AS valued,
                [length(g) for g in string_split_regex(body, {pattern})] AS gaps FROM docs))
        WHERE valued[i] >= {rule.least}""")
    base = len(secret_scan.BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (kind = {k})::BIGINT AS n_{rule.kind}"
                       for k, rule in enumerate(secret_scan.BASE_RULES))
    listed = "coalesce(string_agg(concat_ws(':', name, start::BIGINT, \"end\"::BIGINT), ',' ORDER BY start, kind)"
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
    spans AS ({" UNION ALL ".join(parts)})
    SELECT doc_id, {counts}, sha256({listed} FILTER (kind < {base}), '')) AS base_sha256,
        {listed} FILTER (kind IS NOT NULL), '') AS spans
    FROM docs LEFT JOIN spans USING (rid) GROUP BY rid, doc_id"""


ORACLES: dict[str, str] = {
    "op11_secret_scan": _secrets_sql(),
    "op12_prefix_trie": f"""
    WITH turns AS (
        SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS step,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(
                length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
        FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (
        SELECT conv_id, list(step ORDER BY pos) AS own, conv_id - conv_id % 5 AS base,
            {_crc32("conv_id::VARCHAR")} % 9 AS h FROM turns GROUP BY conv_id),
    rebuilt AS (
        SELECT c.conv_id, list_concat(coalesce(b.own[:c.h], []), c.own[c.h + 1:]) AS steps
        FROM convs c LEFT JOIN convs b ON b.conv_id = c.base),
    members AS (SELECT conv_id, steps, unnest(range(0, len(steps) + 1)) AS depth FROM rebuilt),
    nodes AS (
        SELECT depth, steps[:depth] AS steps, min(conv_id) AS conv_id, count(*) AS n_convs,
            sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(members.steps) = depth), ''))
                AS ends_sha256 FROM members GROUP BY depth, members.steps[:depth]),
    pairs AS (
        SELECT n.depth, n.steps, m.depth AS at, m.steps AS below, (m.n_convs - 1) * coalesce(strlen(m.steps[-1].text), 0) AS saved
        FROM nodes n JOIN nodes m ON m.depth >= n.depth AND m.steps[:n.depth] = n.steps),
    inner_nodes AS (SELECT DISTINCT depth - 1 AS depth, steps[:depth - 1] AS steps FROM nodes WHERE depth > 0),
    sums AS (
        SELECT p.depth, p.steps, count(*) FILTER (p.at = p.depth + 1) AS n_children,
            count(*) FILTER (i.steps IS NULL) AS n_leaves, sum(p.saved)::BIGINT AS saved_tokens
        FROM pairs p LEFT JOIN inner_nodes i ON i.depth = p.at AND i.steps = p.below GROUP BY p.depth, p.steps)
    SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves, s.saved_tokens,
        n.ends_sha256
    FROM nodes n JOIN sums s ON s.depth = n.depth AND s.steps = n.steps
    LEFT JOIN nodes up ON up.depth = n.depth - 1 AND up.steps = n.steps[:n.depth - 1]""",
    "op13_structure_repair": f"""
    WITH RECURSIVE kinds AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32(
            "concat_ws(':', coalesce(conv_id::VARCHAR, ' '), coalesce(turn::VARCHAR, ' '))")} % 20 AS kind
        FROM conversations),
    damaged AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
            CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE kind <> 0),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(
                length(role) || ':' || role || text)) AS pos,
            rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged),
    seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth FROM placed),
    rows AS (
        SELECT *, CASE WHEN bare = '' THEN 'b' WHEN nth > 1 THEN 'd'
                WHEN bare[-1] NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault,
            role[1] AS initial, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM seen),
    counts AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
            count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
            count(*) FILTER (fault = 't') AS truncated,
            count(*) FILTER (pos > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
            count(*) AS n FROM rows GROUP BY conv_id),
    inserts(f, t, cost, audit) AS (VALUES
        (0, 0, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 1, 0, ''), (1, 2, 3, 'I'), (1, 3, 6, 'II'),
        (2, 2, 0, ''), (2, 3, 3, 'I'), (3, 3, 0, ''), (3, 2, 3, 'I')),
    edges(f, symbol, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
    moves AS (
        SELECT r.conv_id, r.pos, e.f, e.t, (fault = 't')::INT * 3 + CASE WHEN e.symbol = initial THEN 0 ELSE 3 END AS cost,
            CASE WHEN e.symbol = initial THEN 'K' ELSE 'R' END AS edit
        FROM rows r JOIN edges e ON e.symbol = initial OR e.symbol IN ('u', 'a') WHERE fault IN ('t', '-')
        UNION ALL SELECT r.conv_id, r.pos, f, f, 4, 'D' FROM rows r, (VALUES (0), (1), (2), (3)) s(f)),
    steps AS (
        SELECT m.conv_id, m.pos, i.f, m.t, min(lpad((i.cost + m.cost)::VARCHAR, 3, '0') || i.audit || m.edit) AS best
        FROM moves m JOIN inserts i ON i.t = m.f GROUP BY ALL),
    parsed AS (
        SELECT conv_id, 0::BIGINT AS pos, 0 AS state, 0::BIGINT AS cost, '' AS audit FROM counts
        UNION ALL
        SELECT conv_id, pos, state, best.cost, best.audit FROM (
            SELECT p.conv_id, s.pos, s.t AS state,
                min({{'cost': p.cost + s.best[:3]::BIGINT, 'audit': p.audit || s.best[4:]}}) AS best
            FROM parsed p JOIN steps s ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND s.pos = p.pos + 1 AND s.f = p.state
            GROUP BY p.conv_id, s.pos, s.t)),
    chosen AS (
        SELECT c.conv_id, min({{'cost': p.cost + i.cost, 'audit': p.audit || i.audit}}) AS best
        FROM parsed p JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.pos
        JOIN inserts i ON i.f = p.state AND i.t IN (0, 3) GROUP BY c.conv_id),
    edits AS (
        SELECT conv_id, spot, best.audit[spot] AS edit, spot - len(replace(best.audit[:spot], 'D', '')) AS deleted,
            len(replace(best.audit[:spot], 'I', '')) AS pos
        FROM (SELECT *, unnest(range(1, len(best.audit) + 1)) AS spot FROM chosen)),
    lines AS (
        SELECT e.*, spot - deleted AS line, CASE WHEN edit = 'I' THEN '' ELSE r.text END AS text, r.role, r.initial
        FROM edits e JOIN rows r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.pos = greatest(e.pos, 1) WHERE edit <> 'D'),
    systems AS (SELECT conv_id, bool_or(line = 1 AND edit = 'K' AND initial = 's')::INT AS system FROM lines GROUP BY conv_id),
    hashes AS (
        SELECT l.conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role
            WHEN (line - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY line)) AS hash
        FROM lines l JOIN systems y ON y.conv_id IS NOT DISTINCT FROM l.conv_id GROUP BY l.conv_id)
    SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
        coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
        coalesce(best.audit, '') AS audit, coalesce(hash, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o
    LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN chosen x ON x.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN hashes h ON h.conv_id IS NOT DISTINCT FROM o.conv_id""",
    "op1_ngram_join": """
    WITH RECURSIVE items AS (SELECT doc_id AS id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
    shingles AS (
        SELECT DISTINCT id, array_to_string(words[k:k + 4], ' ') AS shingle
        FROM (SELECT id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS k
              FROM items WHERE len(words) > 0)),
    sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
    common AS (
        SELECT x.id AS a, y.id AS b, count(*) AS n FROM shingles x JOIN shingles y
        ON x.shingle = y.shingle AND x.id < y.id GROUP BY ALL),
    pairs AS (
        SELECT a, b FROM common JOIN sizes s ON s.id = a JOIN sizes t ON t.id = b
        WHERE common.n >= 0.8 * (s.n + t.n - common.n)),""" + _CLASSES + """
    SELECT id AS doc_id, first AS class_id, n_links, id = first AS kept FROM final""",
    "op8_embedding_dedup": """
    WITH RECURSIVE items AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, label FROM embeddings),
    usable AS (
        SELECT id, x, label FROM items WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0
        AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0
        AND len(list_filter(x, lambda c: c <> 0)) > 0),
    pairs AS (
        SELECT p.id AS a, q.id AS b FROM usable p JOIN usable q
        ON p.label = q.label AND p.id < q.id AND len(p.x) = len(q.x)
        WHERE list_cosine_similarity(p.x, q.x) >= 0.98),""" + _CLASSES + """
    SELECT id AS vec_id, n_links, first AS component_id, id = first AS kept FROM final""",
    "op9_topk_search": """
    WITH v AS (
        SELECT vec_id, list_transform(embedding::DOUBLE[], lambda c: floor(64 * c)) AS x FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    scores AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20""",
}
