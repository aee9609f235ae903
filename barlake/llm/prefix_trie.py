"""The trie of conversations' beginnings, by collapsing whole sequences.

Identical conversations become one weighted sequence with the list of those that end there. Sequences
that another one continues are dropped by an anti-join; the others are the leaves. The prefixes of the
sequences, each with its sequence's weight, are then aggregated into the nodes.

Texts are read once, for their digests. What follows the order of turns is done in blocks of turns, and
lists of conversations in chunks, so neither a long conversation nor a large group of copies meets in
one task as a whole.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.llm.common import discard, remainder, stored
from barlake.llm.turns import (
    BLOCK, batched, block_of, digest, each_block, half, half_of, numbered, rows_of, stream_pass,
)

# The prefix of no turns.
ROOT = bytes(16)
# Ids in one piece of a list of conversations.
CHUNK = 1000
# Nodes with more children than a thousandth of all, at least this many, are looked up by broadcast.
HOT = 1000


def root() -> Column:
    return F.lit(bytearray(ROOT)).cast("binary")


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, mark (a digest of role and text, null as empty) and the text's UTF-8 bytes."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        digest(role, text).alias("mark"), F.octet_length(text).cast("bigint").alias("n_bytes"))


def with_shared_openings(turns: DataFrame, lengths: DataFrame, family: int = 5, modulus: int = 9,
                         block: int = BLOCK) -> DataFrame:
    """Conversations c rebuilt: the first h turns of conversation c - c % family, then c's own after its
    first h, where h is crc32 of c's decimal text modulo `modulus`. Columns conv_id, pos, mark, n_bytes.

    If that conversation has fewer turns, all it has come first; if it is absent, none.
    """
    convs = lengths.select("conv_id", "n", remainder(F.col("conv_id"), modulus).alias("h"),
                           (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    heads = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = stored(convs.join(heads, "base", "left").withColumn(
        "m", F.least("h", F.coalesce("base_n", F.lit(0)))), "trie-convs")
    own = (turns.withColumn("block", block_of("pos", block))
           .join(each_block(convs, "n", block).select("conv_id", "block", "h", "m"), ["conv_id", "block"])
           .filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"),
                                     "mark", "n_bytes"))
    opening = (turns.filter((F.col("pos") < modulus) & (F.col("conv_id") % family == 0))
               .withColumnRenamed("conv_id", "base")
               .join(convs.select("conv_id", "base", "h"), "base").filter("pos <= h")
               .select("conv_id", "pos", "mark", "n_bytes"))
    return own.unionByName(opening)


_LOCAL = pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), ("block", pa.int64()),
                    ("n_bytes", pa.int64()), ("local", pa.binary()), ("before", pa.binary())])
_STARTS = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("start", pa.binary())])


def _chained(batches):
    """Digest of each turn with those before it in its block, and the one before."""
    def run():
        at, local = None, None
        for conv, pos, block, n_bytes, mark in rows_of(batches):
            if at != (conv, block):
                at, local = (conv, block), None
            before, local = local, half_of((local or b"") + mark)
            yield conv, pos, block, n_bytes, local, before

    return batched(run(), _LOCAL)


def _block_starts(batches):
    """The prefix with which each block after a full one begins."""
    def run():
        at, start = None, None
        for conv, block, local in rows_of(batches):
            if conv != at:
                at, start = conv, ROOT
            start = half_of(start + local)
            yield conv, block + 1, start

    return batched(run(), _STARTS)


def prefixes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each turn with `prefix`, which names the sequence of turns up to it, and `parent`, that up to the
    turn before. A block's turns are chained by themselves, then hung on the prefix the block begins
    with; so a long conversation takes a row per block in one task and no more."""
    blocked = turns.withColumn("block", block_of("pos", block)).select("conv_id", "pos", "block", "n_bytes", "mark")
    local = stored(stream_pass(
        blocked.repartition("conv_id", "block").sortWithinPartitions("conv_id", "pos"),
        "conv_id bigint, pos bigint, block bigint, n_bytes bigint, local binary, before binary",
        _chained), "trie-chained")
    full = local.filter(F.col("pos") % block == 0).select("conv_id", "block", "local")
    starts = stream_pass(full.repartition("conv_id").sortWithinPartitions("conv_id", "block"),
                         "conv_id bigint, block bigint, start binary", _block_starts)
    first = local.filter("block = 0").withColumn("start", root())
    later = local.filter("block > 0").join(starts, ["conv_id", "block"])
    return first.unionByName(later).select(
        "conv_id", "pos", "block", "n_bytes", half(F.concat("start", "local")).alias("prefix"),
        F.when(F.col("before").isNull(), F.col("start"))
        .otherwise(half(F.concat("start", "before"))).alias("parent"))


_CHUNKS = pa.schema([("prefix", pa.binary()), ("depth", pa.int64()), ("first", pa.int64()),
                     ("n", pa.int64()), ("ids", pa.string())])
_ENDS = pa.schema([("prefix", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()),
                   ("weight", pa.int64()), ("ends_sha256", pa.string())])


def chunked(size: int):
    """A pass that makes pieces, of at most `size` ids, of the ascending lists of ids per prefix."""
    def piece(at, ids):
        return *at, ids[0], len(ids), ",".join(map(str, ids))

    def pieces(batches):
        at, ids = None, []
        for prefix, depth, conv in rows_of(batches):
            if ids and (at != (prefix, depth) or len(ids) == size):
                yield piece(at, ids)
                ids = []
            at = prefix, depth
            ids.append(conv)
        if ids:
            yield piece(at, ids)

    return lambda batches: batched(pieces(batches), _CHUNKS, 200)


def _hashed(batches):
    """Weight, smallest id and hash of the list of each prefix, from its pieces in order."""
    def run():
        at, first, weight, sha = None, None, 0, None
        for prefix, depth, smallest, n, ids in rows_of(batches):
            if at == (prefix, depth):
                sha.update(b",")
            else:
                if at is not None:
                    yield *at, first, weight, sha.hexdigest()
                at, first, weight, sha = (prefix, depth), smallest, 0, hashlib.sha256()
            sha.update(ids.encode())
            weight += n
        if at is not None:
            yield *at, first, weight, sha.hexdigest()

    return batched(run(), _ENDS)


def weighted_sequences(steps: DataFrame, ids: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The distinct whole sequences: prefix, depth, conv_id (the smallest that has it), weight (how many
    have it) and ends_sha256, the SHA-256 of their ids, ascending and comma-joined. `ids` are all
    conversations; those without turns share the empty sequence."""
    last = steps.groupBy("conv_id").agg(F.max("pos").alias("depth"), F.max_by("prefix", "pos").alias("prefix"))
    members = ids.select("conv_id").join(last, "conv_id", "left").select(
        F.coalesce("prefix", root()).alias("prefix"),
        F.coalesce("depth", F.lit(0).cast("bigint")).alias("depth"), "conv_id")
    chunks = stream_pass(
        members.repartitionByRange("prefix", "conv_id").sortWithinPartitions("prefix", "conv_id"),
        "prefix binary, depth bigint, first bigint, n bigint, ids string", chunked(chunk))
    return stream_pass(chunks.repartition("prefix").sortWithinPartitions("prefix", "first"),
                       "prefix binary, depth bigint, conv_id bigint, weight bigint, ends_sha256 string",
                       _hashed)


def subtree_sums(paths: DataFrame, block: int = BLOCK) -> DataFrame:
    """For every step of a path the sums of `own` and `leaf` from there to the path's end."""
    within = Window.partitionBy("conv_id", "block").orderBy(F.col("pos").desc())
    sums = paths.withColumns({"saved": F.sum("own").over(within), "leaves": F.sum("leaf").over(within)})
    after = Window.partitionBy("conv_id").orderBy(F.col("block").desc()).rowsBetween(
        Window.unboundedPreceding, -1)
    totals = (paths.filter(F.col("length") > block).groupBy("conv_id", "block")
              .agg(F.sum("own").alias("own"), F.sum("leaf").alias("leaf"))
              .select("conv_id", "block", F.sum("own").over(after).alias("later_own"),
                      F.sum("leaf").over(after).alias("later_leaf")))
    short, long = sums.filter(F.col("length") <= block), sums.filter(F.col("length") > block)
    joined = long.join(totals, ["conv_id", "block"]).withColumns({
        "saved": F.col("saved") + F.coalesce("later_own", F.lit(0)),
        "leaves": F.col("leaves") + F.coalesce("later_leaf", F.lit(0))})
    columns = ["prefix", "saved", "leaves"]
    return short.select(*columns).unionByName(joined.select(*columns))


def with_parents(nodes: DataFrame, children: DataFrame, hot_children: int = HOT) -> DataFrame:
    """Nodes with `parent_conv_id`. Of a parent's children there may be very many: parents with more than a
    thousandth of all nodes as children, fewer than a thousand, are broadcast; the others are joined."""
    parents = children.join(nodes.select("prefix", F.col("conv_id").alias("parent_conv_id")), "prefix")
    parents = stored(parents.withColumnRenamed("prefix", "parent"), "trie-parents")
    busy = F.col("n_children") > max(nodes.count() // 1000, hot_children)
    hot = F.broadcast(parents.filter(busy).drop("n_children"))
    rest = nodes.join(hot.select("parent"), "parent", "left_anti")
    return nodes.join(hot, "parent").unionByName(
        rest.join(parents.filter(~busy).drop("n_children"), "parent", "left"))


def trie(turns: DataFrame, ids: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """The nodes of the trie of sequences `turns` (conv_id, pos from 1 without gaps, mark, n_bytes) of the
    conversations `ids`; see `prefix_trie` for the columns."""
    steps = stored(prefixes(turns, block), "trie-steps")
    sequences = stored(weighted_sequences(steps, ids, chunk), "trie-sequences")
    kept = sequences.select("conv_id", "weight", F.col("depth").alias("length"))
    paths = steps.join(each_block(kept.filter("length > 0"), "length", block), ["conv_id", "block"])
    tops = kept.select("conv_id", F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("block"),
                       F.lit(0).cast("bigint").alias("n_bytes"), root().alias("prefix"),
                       F.lit(None).cast("binary").alias("parent"), "weight", "length")
    paths = stored(paths.select(*tops.columns).unionByName(tops), "trie-paths")
    discard(steps)
    nodes = stored(
        paths.groupBy("prefix", "parent", "n_bytes", F.col("pos").alias("depth"))
        .agg(F.sum("weight").alias("n_convs"), F.min("conv_id").alias("conv_id")), "trie-nodes")
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("prefix")).agg(
        F.count("*").alias("n_children"))
    # Sequences that another one continues are no leaves.
    leaves = sequences.select("prefix").join(children.select("prefix"), "prefix", "left_anti").withColumn(
        "leaf", F.lit(1).cast("bigint"))
    # A node's own share is booked once, on the path of its smallest conversation.
    own = nodes.join(leaves, "prefix", "left").select(
        "conv_id", F.col("depth").alias("pos"), "leaf", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("own"))
    booked = paths.join(own, ["conv_id", "pos"], "left").fillna(0, ["own", "leaf"])
    sums = subtree_sums(booked, block).groupBy("prefix").agg(
        F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    result = (with_parents(nodes, children).join(sums, "prefix").join(children, "prefix", "left")
              .join(sequences.select("prefix", "ends_sha256"), "prefix", "left"))
    return result.select(
        "conv_id", "depth", "parent_conv_id", "n_convs",
        F.coalesce("n_children", F.lit(0).cast("bigint")).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, rebuild: bool = True, block: int = BLOCK,
                chunk: int = CHUNK) -> DataFrame:
    """One row per distinct beginning of the conversations, the empty one included.

    Turns are ordered by `turn`, nulls first, those of one turn by the digest of role and text, so that
    repeated rows stay repeated turns; a null role or text counts as empty. With `rebuild`, conversations
    first get their family's opening (see `with_shared_openings`). Columns, all but the last long:
    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs (members), n_children,
    n_leaves (childless nodes below, itself included), saved_tokens (over the subtree, members but one
    times the UTF-8 bytes of the last text) and ends_sha256 (of the members that end here, ascending,
    comma-joined; none: of the empty string). Rows without a conv_id belong to no conversation and are
    left out; an empty table gives no node. Further columns are ignored.
    """
    turns, lengths = numbered(turn_rows(conversations), "conv_id", ["turn", "mark"], "trie-turns")
    lengths = stored(lengths, "trie-lengths")
    turns = turns.drop("turn")
    rebuilt = with_shared_openings(turns, lengths, block=block) if rebuild else turns
    return trie(rebuilt, lengths, block, chunk)
