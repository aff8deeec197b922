"""Repairs against all edits of short conversations, and against the SQL of the query."""

import hashlib
import random
import re
import zlib
from functools import cache

import duckdb

from tidemark.llm import turn_repair

WHITE = " \t\n\x0b\x0c\r"


def faults(turns):
    seen, out = set(), []
    for role, text in turns:
        bare = text.strip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(turns):
    """(cost, audit, repaired) by trying every edit, a letter at a time; the grammar is a regular expression."""
    found = faults(turns)
    legal = re.compile("(s?(ua)+)?")
    start = re.compile("s?(ua)*u?")

    @cache
    def best(i, roles, inserted):
        while "uaua" in roles:  # as legal, and continued by the same
            roles = roles.replace("uaua", "ua")
        if not start.fullmatch(roles):
            return None
        ways = [(0, "", ())] if i == len(turns) and legal.fullmatch(roles) else []

        def add(cost, letter, item, n, more, k=0):
            if (rest := best(n, more, k)) is not None:
                ways.append((cost + rest[0], letter + rest[1], (*item, *rest[2])))

        if inserted < 3:
            for r in ("user", "assistant"):
                add(5, "I", (f"{r}:",), i, roles + r[0], inserted + 1)
        if i < len(turns):
            role, text = turns[i]
            add(2, "D", (), i + 1, roles)
            if found[i] in (None, "truncated"):
                extra = 5 * (found[i] == "truncated")
                if role[:1] in ("s", "u", "a"):
                    add(extra, "K", (f"{role}:{text}",), i + 1, roles + role[0])
                for r in ("user", "assistant"):
                    add(1 + extra, "R", (f"{r}:{text}",), i + 1, roles + r[0])
        return min(ways, default=None)

    cost, audit, items = best(0, "", 0)
    return cost, audit, hashlib.sha256("\n".join(items).encode()).hexdigest()


def harmed(rows):
    out = []
    blank = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def want(rows):
    out = {}
    kept = harmed(rows)
    for conv in {r[0] for r in rows}:
        own = sorted(((-1 if t is None else t), r, x) for c, t, r, x in kept if c == conv)
        turns = [(r, x) for _, r, x in own]
        found = faults(turns)
        numbers = [t for t, _, _ in own if t >= 0]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        out[conv] = (gaps, *(found.count(x) for x in ("blank", "duplicate", "truncated")), illegal, *cheapest(turns))
    return out


def conversations():
    rng = random.Random(7)
    rows = []
    for conv in [*range(150), None]:
        for turn in range(rng.randrange(8)):
            role = rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None, "Agent"])
            text = rng.choice(["Yes.", "No!", "Why?", "cut off", "  ", "", None, "Ends. \n", f"Text {rng.random()}.", f"more {rng.random()}"])
            if rng.random() < 0.15:
                turn = rng.choice([None, turn + 3])
            rows += [(conv, turn, role, text)] * rng.choice([1, 1, 1, 1, 1, 2])
    return rows


def test_by_all_edits_and_by_sql(spark, tmp_path):
    rows = conversations()
    expected = want(rows)
    assert len({x[5] for x in expected.values()}) > 5
    spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, pos int").write.parquet(f"{tmp_path}/conversations.parquet")
    df = turn_repair.op12_conversation_repair(spark, str(tmp_path))
    got = df.collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == expected and len(got) == len(expected)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    found = con.sql(turn_repair.OP12_SQL)
    assert found.columns == df.columns and {r[0]: r[1:] for r in found.fetchall()} == expected


def test_one_long_conversation_over_many_runs(spark, tmp_path):
    rng = random.Random(8)
    rows = [(5, t, rng.choice(["user", "assistant"]), rng.choice([f"Turn {t}.", f"turn {t}", "Same."])) for t in range(3000)] + [(k, 0, "user", "Hm.") for k in (1, 9)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    got = {tuple(r) for r in turn_repair.op12_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == set(con.sql(turn_repair.OP12_SQL).fetchall()) and max(len(r[7]) for r in got) > 2800


def test_repaired_turns_are_those_of_the_hash(spark):
    rows = [(c, t, r, x) for c, t, r, x in conversations() if c is not None]
    df = spark.createDataFrame([(f"c{c}", *r) for c, *r in rows], "conv_id string, turn long, role string, text string")
    turns = turn_repair.ordered_turns(df)
    solved = turn_repair.solution(turn_repair.solved_runs(turn_repair.judged(turns)))
    texts = {}
    for r in sorted(turn_repair.repaired_turns(solved, turns).collect(), key=lambda r: (r["pos"], r["at"])):
        texts.setdefault(r["conv"], []).append(f"{r['role']}:{r['text']}")
    hashes = {r["conv_id"]: r["repaired_sha256"] for r in turn_repair.repair(df).collect()}
    assert {c: hashlib.sha256("\n".join(texts.get(c, [])).encode()).hexdigest() for c in hashes} == hashes and len(texts) > 50


def test_insertions_complete_what_cannot_be_deleted():
    assert turn_repair.CLOSING == [(0, ""), (10, "IJ"), (5, "J"), (0, "")]
    table = {(s, i, f, t): (c, x) for s, i, f, t, c, x in turn_repair.moves()}
    assert table[turn_repair.EMPTY, "a", turn_repair.FINE, turn_repair.ASSISTANT] == (5, "IK")
    assert table[turn_repair.USER, "u", turn_repair.FINE, turn_repair.USER] == (2, "D")
    assert table[turn_repair.EMPTY, "u", turn_repair.TRUNCATED, turn_repair.USER] == (5, "K")


def test_no_rows_and_ids_without_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turn_repair.repair(none).count() == 0
    some = spark.createDataFrame([(4,), (None,)], "conv_id long")
    assert {tuple(r) for r in turn_repair.repair(none, conversations=some).collect()} == {(k, 0, 0, 0, 0, 0, 0, "", turn_repair.EMPTY_SHA256) for k in (4, None)}
