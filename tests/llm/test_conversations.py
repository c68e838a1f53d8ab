"""Repaired conversations, against every way of editing short ones, and against SQL."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from uvsieve.llm import conversations
from uvsieve.llm.conversations import ALL, NOTHING, best_end, damaged, edited, illegal_pairs, repair_conversations, summarised, table
from uvsieve.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, cost double, kind int, audit string"
VALID = re.compile(r"(s?(ua)+)?")


def every_way(rows):
    """All edits of rows (initial, truncated, has to go) with up to four inserts that give valid roles: the least (cost, audit)."""
    choices = []
    for initial, cut, gone in rows:
        own = [(4, "D", "")]
        if not gone:
            own += [(3 * cut, "K", initial), (3 + 3 * cut, "R", "u"), (3 + 3 * cut, "R", "a")]
        choices.append(own)
    inserts = [(3 * n, "I" * n, "".join(w)) for n in range(3) for w in itertools.product("ua", repeat=n)]
    spots = [x for c in choices for x in (inserts, c)] + [inserts]
    best = None
    for way in itertools.product(*spots):
        if VALID.fullmatch("".join(w[2] for w in way)):
            found = (sum(w[0] for w in way), "".join(w[1] for w in way))
            best = found if best is None or found < best else best
    return best


def letter(initial, cut, gone):
    return conversations.FIRST[initial] if gone else initial.upper() if cut else initial


def test_short_conversations_against_every_way():
    draw = random.Random(3)
    for _ in range(60):
        rows = [(draw.choice("suao" if k < 2 else "uao"), draw.random() < 0.3, draw.random() < 0.2) for k in range(draw.randint(0, 3))]
        letters = "".join(letter(*r) for r in rows).translate(conversations.GONE)
        assert best_end(table(letters, (NOTHING,))[NOTHING]) == every_way(rows), rows


def test_pieces_join_to_the_whole():
    draw = random.Random(4)
    for n in (1, 63, 64, 65, 200, 700):
        rows = "".join(draw.choices("suaoSUA1", weights=[1, 6, 6, 1, 1, 1, 1, 3], k=n))
        final = conversations.lightest((0, NOTHING), lambda item: conversations.edits(rows, item))  # noqa: B023
        whole = {last: w for (at, last), w in final.items() if at == n}
        assert table(rows)[NOTHING] == whole
        cut = draw.randint(0, n)
        assert conversations.joined(table(rows[:cut]), table(rows[cut:]), ALL)[NOTHING] == whole


def plain(rows, ids):
    """The contract in plain Python: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, sha)."""
    out = []
    for conv in ids:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
        turns = [t for _, t, _, _ in own if t is not None]
        seen, faults = set(), []
        for _, _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        first = [r[2][:1] for r in own]
        # weights by place and role last, relaxed until nothing changes
        states = {"": (0, "")}

        def fill(states):
            for _ in range(3):
                for last, (cost, audit) in list(states.items()):
                    to = "a" if last == "u" else "u"
                    states[to] = min(states.get(to, (10**9, "")), (cost + 3, audit + "I"))
            return states

        states = fill(states)
        for initial, fault in zip(first, faults, strict=True):
            new = {}
            for last, (cost, audit) in states.items():
                ways = [(last, 4, "D")]
                if fault not in ("b", "d"):
                    late = 3 * (fault == "t")
                    ways.append(("a" if last == "u" else "u", 3 + late, "R"))
                    if initial and last + initial in ("s", "u", "su", "au", "ua"):
                        ways.append((initial, late, "K"))
                for to, more, a in ways:
                    new[to] = min(new.get(to, (10**9, "")), (cost + more, audit + a))
            states = fill(new)
        cost, audit = min(states[s] for s in ("", "a") if s in states)
        told = list(edited(audit, iter([(r, t) for _, _, r, t in own])))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), sum(a + b not in ("su", "ua", "au") for a, b in zip(first[:-1], first[1:], strict=True)), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in told).encode()).hexdigest()))
        assert VALID.fullmatch("".join(r[:1] for r, _ in told))
    return out


def random_rows(seed, n_convs, most):
    draw = random.Random(seed)
    rows = []
    for conv in [None, *range(n_convs)]:
        for turn in range(draw.randint(0, most)):
            text = draw.choice([None, "", " \t", "yes.", "no", "why?", "stop!\n", "é 😀.", "a\x85", f"text {draw.randint(0, 9)}."])
            rows.append((conv, draw.choice([turn, turn, turn, None, 3]), draw.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"]), text))
    draw.shuffle(rows)
    return rows


def test_odd_rows_against_plain_code(spark):
    rows = random_rows(1, 40, 12)
    df = spark.createDataFrame([(*r, 0.5, 7, "x") for r in rows], SCHEMA)
    ids = sorted({r[0] for r in rows if r[0] is not None} | {1000}) + [None]
    got = summarised(repair_conversations(df, spark.createDataFrame([(i, 1) for i in ids], "conv_id long, turn int"))).collect()
    want = plain([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows], ids)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert summarised(repair_conversations(df.limit(0))).count() == 0


def test_a_conversation_over_many_partitions(spark):
    draw = random.Random(9)
    long = [(7, k, draw.choice(["user", "assistant", "user", "assistant", "system"]), draw.choice([f"turn {k}.", f"cut {k}", "again.", ""])) for k in range(4000)]
    rows = long + [(c, k, ("user", "assistant")[k % 2], f"{c} {k}.") for c in (3, 6, 8, 9) for k in range(4)]
    df = spark.createDataFrame([(*r, 0.5, 7, "x") for r in rows], SCHEMA).repartition(5)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as many pieces as partitions
    try:
        got = summarised(repair_conversations(df)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sorted(map(tuple, got)) == sorted(plain(rows, [3, 6, 7, 8, 9]))


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "hello."), (1, 1, "user", "anyone?"), (1, 2, "assistant", "yes"), (1, 3, "assistant", "  ")]
    got = repair_conversations(spark.createDataFrame([(*r, 0.5, 7, "x") for r in rows], SCHEMA)).collect()
    assert [(r["place"], r["role"], r["text"]) for r in got[1:]] == [(1, "user", "hello."), (2, "assistant", ""), (3, "user", "anyone?"), (4, "assistant", "yes")]
    assert (got[0]["place"], got[0]["audit"], got[0]["cost"], got[0]["illegal"]) == (0, "KIKKD", 10, 2)


def test_damage(spark):
    rows = [(c, t, "assistant", "a. b! c?") for c in range(30) for t in range(6)] + [(None, None, None, None)]
    want = []
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        row = (c, t, "user" if fault == 4 else role, "" if fault == 1 else "a b c" if fault == 2 and text != " " else text)
        want += [row] * (0 if fault == 0 else 2 if fault == 3 else 1)
    got = [tuple(r) for r in damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) != len(rows)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, size):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '/root/testdata/{size}/conversations.parquet'")
    want = con.sql(ORACLE_SQL["op12_repaired_conversations"])
    got = QUERIES["op12_repaired_conversations"](spark, f"/root/testdata/{size}")
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    assert illegal_pairs("suaua") == 0
