"""Repair of conversations' structure by weighted generalised LR parsing.

The role grammar is

    C -> (empty) | P | s P        P -> u a | P u a

for a system turn s, user turns u and assistant turns a. A parser with a graph-structured stack reads the
turns' roles and may keep, re-role or delete every turn and insert turns anywhere. Stacks that become
equal are one, with the least (cost, audit) of reaching it; stacks share what lies below their tops.

A conversation is parsed in blocks of turns: the first from the empty stack, every other one from each
stack that can stand at its beginning. What the blocks give is then put together, one row per block.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import stored
from barlake.llm.turns import BLOCK, batched, block_of, digest, numbered, rows_of, stream_pass

# LR table of the grammar. States: 0 nothing read, 1 after s, 2 after u, 3 after P, 4 after s P,
# 5 after u a, 6 after P u, 7 after P u a.
SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 5, (3, "u"): 6, (4, "u"): 6, (6, "a"): 7}
REDUCE = {5: 2, 7: 3}  # how many symbols become a P
GOTO = {0: 3, 1: 4}
ACCEPT = {0, 3, 4}

RE_ROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3  # costs
ROLES = {"u": "user", "a": "assistant"}
WHITE = " \t\n\x0b\x0c\r"

# A turn is one letter: its role's initial (o: none of s, u, a), lower-case if sound, upper-case if
# truncated, and 0 to 3 in the order of INITIALS if it has to be deleted.
INITIALS = "suao"


def initial_of(token: str) -> str:
    return INITIALS[int(token)] if token.isdigit() else token.lower()


# A stack is its top state and the stack below it.
EMPTY = (0, None)


def pushed(stack, symbol: str):
    """The stack after a symbol is shifted and whatever is complete is reduced; None if it does not fit."""
    to = SHIFT.get((stack[0], symbol))
    if to is None:
        return None
    stack = (to, stack)
    while stack[0] in REDUCE:
        for _ in range(REDUCE[stack[0]]):
            stack = stack[1]
        stack = (GOTO[stack[0]], stack)
    return stack


def _reachable() -> list:
    stacks = [EMPTY]
    for stack in stacks:
        stacks += [new for s in "sua" if (new := pushed(stack, s)) is not None and new not in stacks]
    return stacks


STACKS = _reachable()  # the grammar allows a handful of them
PLACE = {stack: i for i, stack in enumerate(STACKS)}
NEXT = [{s: PLACE[new] for s in "sua" if (new := pushed(stack, s)) is not None} for stack in STACKS]


def offer(tops: dict, stack: int, cost: int, audit: str) -> bool:
    """Merge into an equal stack by the least (cost, audit)."""
    if stack in tops and tops[stack] <= (cost, audit):
        return False
    tops[stack] = (cost, audit)
    return True


def with_inserts(tops: dict) -> dict:
    """The stacks, and those that inserted turns lead to. Ends, as every insert costs."""
    tops, waiting = dict(tops), list(tops)
    while waiting:
        stack = waiting.pop()
        cost, audit = tops[stack]
        waiting += [new for s, new in NEXT[stack].items()
                    if s in ROLES and offer(tops, new, cost + INSERT, audit + "I")]
    return tops


def step(tops: dict, token: str) -> dict:
    """The stacks after a turn."""
    after: dict = {}
    initial, faulty, extra = initial_of(token), token.isdigit(), TRUNCATED if token.isupper() else 0
    for stack, (cost, audit) in with_inserts(tops).items():
        offer(after, stack, cost + DELETE, audit + "D")
        if faulty:
            continue
        for symbol, new in NEXT[stack].items():
            if symbol == initial:
                offer(after, new, cost + extra, audit + "K")
            elif symbol in ROLES:
                offer(after, new, cost + extra + RE_ROLE, audit + "R")
    return after


@lru_cache(maxsize=20_000)
def parse(tokens: str, start: int) -> dict:
    """Stacks after the turns of a block, from one stack before it."""
    tops = {start: (0, "")}
    for token in tokens:
        tops = step(tops, token)
    return tops


def illegal_pairs(initials: str) -> int:
    return sum(pair not in ("su", "ua", "au") for pair in map("".join, zip(initials, initials[1:])))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (key, turn, role, text) after damage by crc32(conv_id:turn) modulo 20: 0 drops a row, 1 empties
    its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's. Nulls count as a space."""
    kind = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")),
                               F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return (conversations.select(key_of("conv_id").alias("key"), F.col("turn").cast("bigint").alias("turn"),
                                 role.alias("role"), text.alias("text"), kind.alias("kind"))
            .filter("kind <> 0")
            .select("key", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("kind") == 1, "")
                    .when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
                    .otherwise(F.col("text")).alias("text"), "kind")
            .withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1)))
                                          .otherwise(F.array(F.lit(0)))))
            .drop("kind", "copy"))


def key_of(column: str) -> Column:
    """A conversation's id as text; a space if it is null, so that it can be joined."""
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def tokens_of(rows: DataFrame) -> DataFrame:
    """key, pos, turn, fault ('b' blank, 'd' duplicate, 't' truncated or '-') and the token of every row."""
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    slim = rows.select(
        "key", "pos", "turn", "mark", (bare == "").alias("blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1))
        .otherwise("o").alias("initial"))
    # A row is a duplicate unless it is the first of its digest; (key, pos) meets one row on either side.
    first = slim.groupBy("key", "mark").agg(F.min("pos").alias("pos")).select(
        "key", "pos", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "b").when(F.col("first").isNull(), "d").when(F.col("cut"), "t").otherwise("-")
    deleted = F.translate("initial", INITIALS, "0123")
    return slim.join(first, ["key", "pos"], "left").withColumn("fault", fault).select(
        "key", "pos", "turn", "fault",
        F.when(F.col("fault").isin("b", "d"), deleted).when(F.col("fault") == "t", F.upper("initial"))
        .otherwise(F.col("initial")).alias("token"))


_MOVES = pa.schema([
    ("key", pa.string()), ("block", pa.int64()), ("tokens", pa.string()),
    ("moves", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()),
                                  ("audit", pa.string())])))])
_PLANS = pa.schema([("key", pa.string()), ("block", pa.int64()), ("tokens", pa.string()), ("piece", pa.string()),
                    ("lines", pa.int64()), ("system", pa.bool_()), ("last", pa.bool_()),
                    ("cost", pa.int64()), ("illegal", pa.int64())])
_EDITS = pa.schema([("key", pa.string()), ("pos", pa.int64()), ("lead", pa.string()), ("kept", pa.bool_()),
                    ("role", pa.string()), ("trail", pa.string())])
_HASHES = pa.schema([("key", pa.string()), ("repaired_sha256", pa.string())])


def _parsed(batches):
    """The moves of each block from stack to stack."""
    def run():
        for key, block, tokens in rows_of(batches):
            starts = [PLACE[EMPTY]] if block == 0 else range(len(STACKS))
            yield key, block, tokens, [
                {"start": start, "end": end, "cost": cost, "audit": audit}
                for start in starts for end, (cost, audit) in parse(tokens, start).items()]

    return batched(run(), _MOVES, 200)


def _composed(batches):
    """The cheapest edits of each conversation, block by block."""
    def run():
        held = None
        for key, block, tokens, moves in rows_of(batches):
            if held is None or held[0] != key:
                if held is not None:
                    yield from finished(*held)
                held = [key, {PLACE[EMPTY]: (0, "", None)}, [], 0, ""]
            tops = {}
            for move in moves:
                if move["start"] in held[1]:
                    cost, audit, chain = held[1][move["start"]]
                    new = (cost + move["cost"], audit + move["audit"])
                    if move["end"] not in tops or new < tops[move["end"]][:2]:
                        tops[move["end"]] = (*new, (chain, move["audit"]))
            initials = "".join(map(initial_of, tokens))
            held[3] += illegal_pairs(held[4][-1:] + initials)
            held[1:3], held[4] = [tops, [*held[2], (block, tokens)]], initials
        if held is not None:
            yield from finished(*held)

    def finished(key, tops, blocks, illegal, _):
        # Inserts behind the last turn belong to the last block's piece.
        ends = [((cost + more, audit + tail), chain, tail)
                for stack, (cost, audit, chain) in tops.items()
                for end, (more, tail) in with_inserts({stack: (0, "")}).items() if STACKS[end][0] in ACCEPT]
        (cost, _), chain, tail = min(ends, key=lambda end: end[0])
        pieces = []
        while chain is not None:
            chain, piece = chain
            pieces.append(piece)
        pieces.reverse()
        pieces[-1] += tail
        lines, system = 0, False
        for (block, tokens), piece in zip(blocks, pieces):
            if lines == 0:
                system = kept_system(tokens, piece)
            last = block == blocks[-1][0]
            yield key, block, tokens, piece, lines, system, last, cost, illegal if last else None
            lines += len(piece) - piece.count("D")

    return batched(run(), _PLANS, 200)


def kept_system(tokens: str, piece: str) -> bool:
    """Whether the first turn that the piece leaves is a kept system turn."""
    at = 0
    for edit in piece:
        if edit in "KRI":
            return edit == "K" and initial_of(tokens[at]) == "s"
        at += 1
    return False


def edited(block_size: int):
    """A pass that tells what becomes of every row: lines inserted before and behind it, whether it stays,
    its new role."""
    def run(batches):
        for key, block, tokens, piece, lines, system in rows_of(batches):
            row, lead, edits = 0, [], []

            def role():
                return ROLES["ua"[(lines - system) % 2]]

            for edit in piece:
                if edit == "I":
                    lead.append(f"{role()}:")
                    lines += 1
                    continue
                edits.append([key, block * block_size + row + 1, "\n".join(lead) if lead else None, edit != "D",
                              role() if edit == "R" else None, None])
                row, lead = row + 1, []
                lines += edit != "D"
            if lead:
                edits[-1][5] = "\n".join(lead)
            yield from map(tuple, edits)

    return lambda batches: batched(run(batches), _EDITS)


def _hashed(batches):
    """SHA-256 of each conversation's lines, in order."""
    def run():
        at, sha = None, None
        for key, line in rows_of(batches):
            if key == at:
                sha.update(b"\n")
            else:
                if sha is not None:
                    yield at, sha.hexdigest()
                at, sha = key, hashlib.sha256()
            sha.update(line.encode())
        if sha is not None:
            yield at, sha.hexdigest()

    return batched(run(), _HASHES)


def plans_of(tokens: DataFrame, block: int = BLOCK) -> DataFrame:
    """The cheapest edits per conversation and block: piece of the audit, lines before it, whether a
    system turn leads, total cost, and on the `last` block the illegal pairs."""
    blocks = tokens.groupBy("key", block_of("pos", block).alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))),
                                 lambda t: t["token"]), "").alias("tokens"))
    parsed = stream_pass(
        blocks, "key string, block bigint, tokens string, "
                "moves array<struct<start:int,end:int,cost:bigint,audit:string>>", _parsed)
    return stream_pass(
        parsed.repartition("key").sortWithinPartitions("key", "block"),
        "key string, block bigint, tokens string, piece string, lines bigint, system boolean, last boolean, "
        "cost bigint, illegal bigint", _composed)


def repaired(rows: DataFrame, plans: DataFrame, block: int = BLOCK) -> DataFrame:
    """The SHA-256 of each repaired conversation. The hash is by nature taken in order: the lines of a
    conversation stream through one task, which holds a batch of them at a time."""
    edits = stream_pass(
        plans.select("key", "block", "tokens", "piece", "lines", "system"),
        "key string, pos bigint, lead string, kept boolean, role string, trail string", edited(block))
    own = F.when(F.col("kept"), F.concat(F.coalesce(F.col("new_role"), F.col("role")), F.lit(":"), F.col("text")))
    lines = rows.select("key", "pos", "role", "text").join(
        edits.withColumnRenamed("role", "new_role"), ["key", "pos"]).filter(
        "kept or lead is not null or trail is not null").select(
        "key", "pos", F.concat_ws("\n", "lead", own, "trail").alias("line"))
    return stream_pass(
        lines.repartition("key").sortWithinPartitions("key", "pos").select("key", "line"),
        "key string, repaired_sha256 string", _hashed)


def repair(conversations: DataFrame, damage: bool = True, block: int = BLOCK) -> DataFrame:
    """Faults and cheapest repair of every conversation.

    Rows go by turn, nulls first, those of one turn by the digest of role and text, so that repeated rows
    are adjacent; with `damage` they are first damaged (see `damaged`). Nulls count as one space, also in
    the role, which then is none of the grammar's, and a null conv_id is a conversation of its own. A row
    is blank (only white space), a duplicate (role and text seen before) or truncated (does not end in
    '.', '!' or '?'), whichever holds first.

    Returns conv_id, gaps (turns missing between the least and the largest), blank, duplicate, truncated
    and illegal (neighbours whose roles are not su, ua or au), cost, audit (K, R, D, I in order, the least
    of the cheapest) and repaired_sha256. Conversations all of whose rows were dropped have zeros, an
    empty audit and the empty string's hash. An empty table gives an empty one; further columns are
    ignored.
    """
    rows = damaged(conversations) if damage else conversations.select(
        key_of("conv_id").alias("key"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows, _ = numbered(rows.withColumn("mark", digest(F.col("role"), F.col("text"))), "key",
                       ["turn", "mark"], "repair-rows")
    tokens = stored(tokens_of(rows), "repair-tokens")
    plans = stored(plans_of(tokens, block), "repair-plans")

    def count(fault: str) -> Column:
        return F.count_if(F.col("fault") == fault)

    faults = tokens.groupBy("key").agg(count("b").alias("blank"), count("d").alias("duplicate"),
                                       count("t").alias("truncated"))
    turns = tokens.filter("turn is not null").groupBy("key", "turn").agg(F.lit(1).alias("one")).groupBy(
        "key").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    audits = plans.groupBy("key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "piece"))),
                                 lambda p: p["piece"]), "").alias("audit"),
        F.max("cost").alias("cost"), F.max("illegal").alias("illegal"))
    every = conversations.select("conv_id", key_of("conv_id").alias("key")).distinct()
    result = every
    for part in (faults, turns, audits, repaired(rows, plans, block)):
        result = result.join(part, "key", "left")
    zero = F.lit(0).cast("bigint")
    return result.select(
        "conv_id", *[F.coalesce(name, zero).alias(name)
                     for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
