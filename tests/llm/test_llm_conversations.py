import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from thematrail.llm import conversations as cv

SCHEMA = "conv_id bigint, turn bigint, role string, text string, cost string"
NEXT = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
MOVES = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("a", 2): 3, ("u", 3): 2}


def damage(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        n = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text
        out += [(conv, turn, "user" if n == 4 else role, text)] * (n != 0) * (2 if n == 3 else 1)
    return out


def brute(rows, originals):
    """Every figure by a plain dynamic program over whole edit strings."""
    found = {}
    for conv in {r[0] for r in originals}:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x, *_ in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, kinds = set(), []
        for _, role, text in own:
            last = re.findall(r"[^\x20\x09-\x0D]", text)
            kinds.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "")
            seen.add((role, text))
        best = {0: (0, "", ())}
        for (_, role, text), kind in zip(own, kinds):
            after = {}

            def offer(state, option):
                after[state] = min(after.get(state, option), option, key=lambda o: o[:2])

            for state, (cost, audit, lines) in best.items():
                for inserts in range(3):
                    extra = kind == "truncated"
                    offer(state, (cost + 3, audit + "D", lines))
                    if kind in ("", "truncated"):
                        if (role[:1], state) in MOVES:
                            offer(MOVES[role[:1], state], (cost + extra, audit + "K", (*lines, f"{role}:{text}")))
                        offer(NEXT[state][0], (cost + 2 + extra, audit + "R", (*lines, f"{NEXT[state][1]}:{text}")))
                    state, added = NEXT[state]
                    cost, audit, lines = cost + 2, audit + "I", (*lines, f"{added}:")
            best = after
        ends = []
        for state, (cost, audit, lines) in best.items():
            while state not in (0, 3):
                state, added = NEXT[state]
                cost, audit, lines = cost + 2, audit + "I", (*lines, f"{added}:")
            ends.append((cost, audit, lines))
        cost, audit, lines = min(ends, key=lambda o: o[:2])
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        found[conv] = (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


def random_rows(seed, conversations, longest):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(conversations), None]:
        for _ in range(rng.randrange(longest)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "User", "sage"])
            rows.append((conv, rng.choice([None, *range(-2, 9)]), role, rng.choice(["a.", "b", "c! ", " \t", "", None, "d?x", "é.\n", "é.​"]), "x"))
    return rows


@pytest.mark.parametrize("seed,longest,segment,rounds,rules", [(1, 9, 16384, 8, 12), (2, 25, 3, 3, 4), (3, 60, 7, 8, 2), (4, 6, 1, 0, 1)])
def test_repairs_equal_brute_force(spark, seed, longest, segment, rounds, rules):
    rows = random_rows(seed, 60, longest)
    turns = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: tuple(r)[1:] for r in cv.repair_conversations(turns, segment=segment, rounds=rounds, rules=rules).collect()}
    assert got == brute(rows, rows)


def test_damage_and_conversations_that_lose_all_rows(spark):
    rows = random_rows(5, 300, 5)
    turns = spark.createDataFrame(rows, SCHEMA)
    got = sorted((tuple(r) for r in cv.damaged(turns).collect()), key=str)
    assert got == sorted(damage(rows), key=str)
    found = {r.conv_id: tuple(r)[1:] for r in cv.repair_conversations(cv.damaged(turns), turns).collect()}
    expected = brute(damage(rows), rows)
    assert found == expected and (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in expected.values()


def test_many_equal_rows_and_one_long_conversation(spark):
    rows = [(1, t % 50, "user", "same.", "x") for t in range(400)] + [(1, 3, "assistant", "again.", "x")] * 200 + [(2, t, "ua"[t % 2] and ("user", "assistant")[t % 2], f"{t}.", "x") for t in range(300)]
    turns = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: tuple(r)[1:] for r in cv.repair_conversations(turns, segment=16).collect()}
    assert got == brute(rows, rows) and got[2][6] == "K" * 300


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cv.repair_conversations(empty).count() == 0 and cv.repair_conversations(cv.damaged(empty), empty).count() == 0


def test_matrices_order_edit_strings_as_their_text_does():
    rules = [("u", "a", "Ā"), ("Ā", "D", "ā"), ("x", "Ā", "Ă")]
    grammar = cv.Grammar(rules)
    for symbols in map("".join, itertools.product("suaxUD", repeat=4)):
        packed, matrices = grammar.prefixes(symbols + "uaD")
        last = matrices[-1]
        texts = {(p, q): grammar.audit(symbols + "uaD", p, q) for p in range(4) for q in range(4) if last.cost[4 * p + q] < cv.FAR}
        assert len(packed) <= 5 and all(len(re.findall("[KRD]", t)) == 7 for t in texts.values())
        order = {t: k for k, t in enumerate(sorted(set(texts.values())))}
        assert {x: last.place[4 * x[0] + x[1]] for x in texts} == {x: order[t] for x, t in texts.items()}


def test_rules_are_shared_and_shorten_sequences(spark):
    sequences = spark.createDataFrame([("uauaua" * 40, 3), ("suaua", 5), ("D" * 100, 1)], "symbols string, n bigint")
    rules = cv.paired_rules(sequences, 8, 4)
    assert rules[0][:2] == ("u", "a") and len(rules) <= 32
    packed = cv.Grammar(rules).compressed("uauaua" * 40)
    assert len(packed) < 20


def test_query_equals_brute_force(spark):
    from thematrail.llm import queries

    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in queries.queries()["op13_grammar_repair"](spark, folder).collect()}
    assert got == brute(damage(rows), rows)


def test_groups_of_conversations_stay_apart(spark):
    by_conv = defaultdict(list)
    for r in random_rows(9, 20, 8):
        by_conv[r[0]].append(r)
    whole = spark.createDataFrame([r for rows in by_conv.values() for r in rows], SCHEMA)
    got = {r.conv_id: tuple(r)[1:] for r in cv.repair_conversations(whole).collect()}
    for conv, rows in itertools.islice(by_conv.items(), 3):
        assert got[conv] == brute(rows, rows)[conv]
