"""Conversation repair against dynamic programming, exhaustive search and SQL, and its edge cases."""

import hashlib
import itertools
import random
import re

import duckdb
import pytest

from sigflow.llm import chat
from sigflow.llm.queries import QUERIES, SQL

SCHEMA = "conv_id long, turn long, role string, text string, part int, audit string"
BLANK = " \t\n\x0b\x0c\r"
PATTERN = re.compile("(s?(ua)+)?")


def least(kinds):
    """(cost, edits) by dynamic programming over whole label sets."""
    labels = {chat.START: (0, "")}

    def insert(labels):
        for _ in range(3):
            for s, (c, a) in list(labels.items()):
                to = chat._NEXT[s]
                labels[to] = min(labels.get(to, (9**9, "")), (c + 3, a + "I"))
        return labels

    for kind in kinds:
        out = {}
        for s, (c, a) in insert(labels).items():
            moves = [(s, c + 4, "D")]
            if kind != "-":
                tax = 3 if kind.isupper() else 0
                moves.append((chat._NEXT[s], c + 3 + tax, "R"))
                to = {(chat.START, "s"): chat.S, (chat.START, "u"): chat.U, (chat.S, "u"): chat.U, (chat.U, "a"): chat.A, (chat.A, "u"): chat.U}.get((s, kind.lower()))
                if to is not None:
                    moves.append((to, c + tax, "K"))
            for to, cost, e in moves:
                out[to] = min(out.get(to, (9**9, "")), (cost, a + e))
        labels = out
    insert(labels)
    return min(labels[s] for s in (chat.START, chat.A) if s in labels)


def repaired(turns):
    """What the operator should give for one conversation's sorted (turn, role, text)."""
    kinds, count, seen = "", {"-b": 0, "-d": 0, "cut": 0}, set()
    for _, role, text in turns:
        bare = text.strip(BLANK)
        kind = role[:1] if role[:1] in tuple("sua") else "x"
        if not bare:
            kind = "-"
            count["-b"] += 1
        elif (role, text) in seen:
            kind = "-"
            count["-d"] += 1
        elif bare[-1] not in ".!?":
            kind = kind.upper()
            count["cut"] += 1
        seen.add((role, text))
        kinds += kind
    cost, audit = least(kinds)
    given = {t for t, *_ in turns if t is not None}
    gaps = max(given) - min(given) + 1 - len(given) if given else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    left = chat.apply_edits(audit, chat.START, [(r, t) for _, r, t in turns])
    assert PATTERN.fullmatch("".join(r[:1] for r, _ in left))
    text = "\n".join(f"{r}:{t}" for r, t in left)
    return gaps, count["-b"], count["-d"], count["cut"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def order(rows):
    rows = [(t, " " if r is None else r, " " if x is None else x) for _, t, r, x, *_ in rows]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


@pytest.mark.parametrize("n", range(6))
def test_search_gives_the_least_of_all_edit_strings(n):
    """Every string of edits of small conversations is tried."""
    rng = random.Random(n)
    for _ in range(12):
        kinds = "".join(rng.choice("suaxSUAX-") for _ in range(n))
        best = None
        for edits in itertools.product("DKR", repeat=n):
            for gaps in itertools.product(("", "I", "II"), repeat=n + 1):
                audit = "".join(g + e for g, e in zip(gaps, (*edits, "")))
                state, cost, k, ok = chat.START, 0, 0, True
                for e in audit:
                    if e == "I":
                        state, cost = chat._NEXT[state], cost + 3
                        continue
                    kind = kinds[k]
                    k += 1
                    if e == "D":
                        cost += 4
                    else:
                        to = chat._keeps(state, kind.lower()) if e == "K" else chat._NEXT[state]
                        ok &= kind != "-" and to is not None
                        if not ok:
                            break
                        state, cost = to, cost + (3 if e == "R" else 0) + (3 if kind.isupper() else 0)
                if ok and state in (chat.START, chat.A):
                    best = min(best or (9**9, ""), (cost, audit))
            if n > 4:
                break
        state, cost, audit = chat.search(kinds, chat.START, True)[0]
        assert (cost, audit) == least(kinds)
        if n <= 4:
            assert (cost, audit) == best


def test_search_equals_dynamic_programming():
    rng = random.Random(7)
    for _ in range(400):
        kinds = "".join(rng.choice("suaxSUAX-") for _ in range(rng.randint(0, 40)))
        (state, cost, audit), = chat.search(kinds, chat.START, True)
        assert (cost, audit) == least(kinds)


def conversations(seed=3):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(40)]:
        for turn in range(rng.randint(1, 12) if conv != 7 else 400):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "And then", "", " \n", None, "Why? ", "e\x1c", "one two. three", "So.\n"])
            rows += [(conv, rng.choice([turn, turn, turn, 3 * turn, None]), role, text, 1, "x")] * rng.choice([1, 1, 1, 2])
    return rows


@pytest.mark.parametrize("turns", [512, 5])
def test_repair(spark, monkeypatch, turns):
    """Whole conversations, and (with blocks of five turns) those put together from many blocks."""
    monkeypatch.setattr(chat, "TURNS", turns)
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    run = chat._blocks

    def small(schema):  # workers import the module anew
        def f(batches, inner=run(schema)):
            chat.TURNS = turns
            yield from inner(batches)

        return f

    monkeypatch.setattr(chat, "_blocks", small)
    got = {r[0]: tuple(r)[1:] for r in chat.repair_conversations(df).collect()}
    assert len(got) == 41
    for conv in got:
        assert got[conv] == repaired(order([r for r in rows if r[0] == conv])), conv
    if turns == 5:
        blocks, way = chat._solve(df, None)
        assert way.count() > 80 and blocks.where("conv_id = 7").count() > 50
    left = {}
    for r in sorted(chat.repaired_turns(df).collect(), key=lambda r: (r.part, r.seq, r.turn)):
        left.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert all(hashlib.sha256("\n".join(left.get(c, [])).encode()).hexdigest() == got[c][-1] for c in got)


def test_edges(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert chat.repair_conversations(df).count() == 0 and chat.repaired_turns(df).count() == 0
    rows = [(1, 0, "user", "Hi.", 1, "x"), (2, 0, "user", "a " * 300000 + ".", 1, "x"), (3, None, None, None, 1, "x")]
    gone = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "conv_id = 1 as gone")
    got = {r.conv_id: r for r in chat.repair_conversations(gone, gone="gone").collect()}
    assert tuple(got[1])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert (got[2].audit, got[2].cost) == ("KI", 3) and (got[3].audit, got[3].blank) == ("D", 1)


def test_query_and_sql_on_nulls_and_ties(spark, tmp_path):
    rows = [r[:4] for r in conversations(5) if r[2] != ""]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = {r[0]: r for r in con.sql(SQL["op11_astar_repair"]).fetchall()}
    got = {r[0]: tuple(r) for r in QUERIES["op11_astar_repair"](spark, str(tmp_path)).collect()}
    assert got == want and len(got) == len({r[0] for r in rows})
