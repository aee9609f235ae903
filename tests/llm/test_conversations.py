"""Conversation operators against brute force."""

import hashlib
import itertools
import random
import zlib

import pytest

from barlake.llm import structure_repair
from barlake.llm.prefix_trie import prefix_trie
from barlake.llm.structure_repair import repair

SCHEMA = "conv_id long, turn long, role string, text string, key string, pos int, prefix int"


def crc(text):
    return zlib.crc32(text.encode())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def in_order(rows):
    """Rows (turn, role, text) as the operators order them."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, sha(f"{len(r[1])}:{r[1]}{r[2]}")))


# Prefix trie

def brute_trie(rows, rebuild=True):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn, role or "", text or ""))
    own = {conv: [r[1:] for r in in_order(turns)] for conv, turns in own.items()}
    full = {}
    for conv, turns in own.items():
        base, h = conv - int(conv - 5 * (abs(conv) // 5) * (1 if conv >= 0 else -1)), crc(str(conv)) % 9
        full[conv] = tuple(own.get(base, [])[:h] + turns[h:]) if rebuild else tuple(turns)
    nodes = {}
    for conv, turns in full.items():
        for depth in range(len(turns) + 1):
            nodes.setdefault(turns[:depth], []).append(conv)
    out = []
    for node, members in nodes.items():
        below = [n for n in nodes if n[:len(node)] == node]
        ends = sorted(c for c in members if full[c] == node)
        out.append((min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members),
                    sum(len(n) == len(node) + 1 for n in below),
                    sum(not any(len(m) == len(n) + 1 and m[:-1] == n for m in nodes) for n in below),
                    sum((len(nodes[n]) - 1) * len(n[-1][1].encode()) for n in below if n),
                    sha(",".join(map(str, ends)))))
    return sorted(out, key=str)


def trie_rows(frame):
    return sorted((tuple(row) for row in frame.collect()), key=str)


def as_table(spark, rows):
    return spark.createDataFrame([(*row, "k", 1, 2) for row in rows], SCHEMA)


def random_conversations(seed, convs, turns, texts="ab"):
    draw = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(draw.randint(1, turns)):
            rows.append((conv, turn, draw.choice(["user", "assistant", None]), draw.choice([*texts, "é.", None, ""])))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("rebuild", [True, False])
def test_trie_equals_brute_force(spark, rebuild):
    rows = random_conversations(1, 40, 12)
    rows += [(7, None, "user", "first"), (7, None, "user", "first"), (8, 3, "user", "tie"), (-7, 1, "u", "x")]
    rows += [(None, 1, "user", "nobody's")]
    assert trie_rows(prefix_trie(as_table(spark, rows), rebuild)) == brute_trie(rows, rebuild)


def test_blocks_and_chunks_change_nothing(spark):
    rows = random_conversations(2, 24, 10, "a")
    rows += [(conv, turn, "user", str(turn % 3)) for conv in (30, 31, 35, 40) for turn in range(40)]
    rows += [(50 + k, 0, "user", "same") for k in range(0, 60, 5)]  # a group of copies
    frame = as_table(spark, rows)
    expected = brute_trie(rows)
    assert trie_rows(prefix_trie(frame, block=4, chunk=2)) == expected
    assert trie_rows(prefix_trie(frame)) == expected


def test_conversations_may_end_up_without_turns(spark):
    # Conversation 1001 has no family head, and fewer turns than it takes from there.
    conv = next(c for c in range(1001, 2000) if c % 5 and crc(str(c)) % 9 > 1)
    rows = [(conv, 1, "user", "x")]
    assert trie_rows(prefix_trie(as_table(spark, rows))) == [(conv, 0, None, 1, 0, 1, 0, sha(str(conv)))]
    assert brute_trie(rows) == [(conv, 0, None, 1, 0, 1, 0, sha(str(conv)))]


def test_an_empty_table_has_no_nodes(spark):
    empty = as_table(spark, [])
    assert prefix_trie(empty).collect() == [] and repair(empty).collect() == []


# Structure repair

WHITE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = crc(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}") % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults_of(turns):
    seen, out = set(), []
    for _, role, text in turns:
        bare = text.rstrip(WHITE)
        out.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-")
        seen.add((role, text))
    return out


def grammatical(roles):
    rest = roles[1:] if roles[:1] == "s" else roles
    return roles == "" or (rest != "" and len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2))


def cheapest(turns, faults, most_inserts=3):
    """(cost, audit, lines) by trying every combination of edits with up to so many inserts in a place."""
    inserts = [list(p) for n in range(most_inserts + 1) for p in itertools.product("ua", repeat=n)]
    best = None

    def walk(at, cost, audit, roles, lines):
        nonlocal best
        if best is not None and (cost, audit) > best[:2] and cost > best[0]:
            return
        for more in inserts:
            c, a = cost + 3 * len(more), audit + "I" * len(more)
            r, out = roles + "".join(more), lines + [f"{structure_repair.ROLES[m]}:" for m in more]
            if at == len(turns):
                if grammatical(r) and (best is None or (c, a) < best[:2]):
                    best = (c, a, out)
                continue
            _, role, text = turns[at]
            walk(at + 1, c + 4, a + "D", r, out)
            if faults[at] in "-t":
                extra = 3 * (faults[at] == "t")
                walk(at + 1, c + extra, a + "K", r + (role[:1] if role[:1] in "sua" and role else "?"), out + [f"{role}:{text}"])
                for new, word in structure_repair.ROLES.items():
                    walk(at + 1, c + extra + 3, a + "R", r + new, out + [f"{word}:{text}"])

    walk(0, 0, "", "", [])
    return best


def brute_repair(rows, damage=True, search=cheapest):
    convs = {conv: [] for conv, *_ in rows}
    kept = damaged(rows) if damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    for conv, *turn in kept:
        convs[conv].append(tuple(turn))
    out = []
    for conv, turns in convs.items():
        turns = in_order(turns)
        faults, numbers = faults_of(turns), [t[0] for t in turns if t[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, lines = search(turns, faults)
        out.append((conv, gaps, *map(faults.count, "bdt"), illegal, cost, audit, sha("\n".join(lines))))
    return sorted(out, key=str)


def repair_rows(frame):
    return sorted((tuple(row) for row in frame.collect()), key=str)


def random_turns(seed, convs, turns):
    draw = random.Random(seed)
    return [(conv, draw.choice([turn, turn, turn, None]) if conv % 7 == 0 else turn * 2,
             draw.choice(["user", "assistant", "system", "tool", None, ""]),
             draw.choice(["Yes.", "No!", "cut", " \n", "", None, "Well? \t", "é"]))
            for conv in range(convs) for turn in range(draw.randint(1, turns))]


def test_repairs_equal_an_exhaustive_search(spark):
    rows = random_turns(3, 60, 4)
    rows += [(None, 1, "user", "Nobody's."), (None, 2, "assistant", "Yes."), (1000, None, "user", "A.")]
    frame = as_table(spark, rows)
    for damage in (True, False):
        assert repair_rows(repair(frame, damage)) == brute_repair(rows, damage)


def by_distances(turns, faults):
    """The same by a dynamic programme over the four situations a valid beginning can be in."""
    after = {("start", "s"): "system", ("start", "u"): "open", ("system", "u"): "open", ("open", "a"): "whole",
             ("whole", "u"): "open"}
    best = {"start": (0, "", [])}

    def inserted(best):
        best = dict(best)
        for _ in range(3):
            for at, (cost, audit, lines) in list(best.items()):
                for symbol, word in structure_repair.ROLES.items():
                    to = after.get((at, symbol))
                    new = (cost + 3, audit + "I", lines + [word + ":"])
                    if to and (to not in best or new[:2] < best[to][:2]):
                        best[to] = new
        return best

    for (_, role, text), fault in zip(turns, faults):
        new = {}

        def offer(to, *state):
            if to not in new or state[:2] < new[to][:2]:
                new[to] = state

        for at, (cost, audit, lines) in inserted(best).items():
            offer(at, cost + 4, audit + "D", lines)
            if fault in "bd":
                continue
            extra = 3 * (fault == "t")
            for symbol in "sua":
                to = after.get((at, symbol))
                if to and symbol == role[:1]:
                    offer(to, cost + extra, audit + "K", lines + [f"{role}:{text}"])
                elif to and symbol in structure_repair.ROLES:
                    offer(to, cost + extra + 3, audit + "R", lines + [f"{structure_repair.ROLES[symbol]}:{text}"])
        best = new
    return min(state for at, state in inserted(best).items() if at in ("start", "whole"))


def test_long_conversations_in_blocks_equal_a_plain_programme(spark):
    rows = random_turns(4, 30, 30)
    rows += [(100, turn, "ua"[turn % 2] + "x", f"Turn {turn}.") for turn in range(200)]
    frame = as_table(spark, rows)
    expected = brute_repair(rows, search=by_distances)
    assert repair_rows(repair(frame, block=4)) == expected
    assert repair_rows(repair(frame)) == expected


def test_conversations_whose_rows_are_all_dropped(spark):
    conv = next(c for c in range(1000) if crc(f"{c}:1") % 20 == 0)
    got = repair_rows(repair(as_table(spark, [(conv, 1, "user", "Hi.")])))
    assert got == [(conv, 0, 0, 0, 0, 0, 0, "", sha(""))]


def test_the_stack_knows_the_grammar():
    def accepted(roles):
        stack = structure_repair.EMPTY
        for symbol in roles:
            stack = stack and structure_repair.pushed(stack, symbol)
        return stack is not None and stack[0] in structure_repair.ACCEPT

    for size in range(7):
        for roles in map("".join, itertools.product("sua", repeat=size)):
            assert accepted(roles) == grammatical(roles), roles
