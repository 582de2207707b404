"""Structure repair against every edit script, its SQL across blocks, and odd rows."""

import hashlib
import itertools
import random
import re

import duckdb
import pytest
from compare import duck_rows, spark_rows, verdict

from foretally.llm import conversations
from foretally.llm.queries import SQL, op12_conversation_structure

SCHEMA = "conv_id long, turn long, role string, text string, gaps string"
LEGAL = re.compile(r"(s?(ua)+)?")


def faults(turns):
    out, seen = [], set()
    for role, text in turns:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def every_script(turns):
    """(cost, audit, repaired lines) of all edit scripts with at most two inserts at a place."""
    found = faults(turns)
    puts = [p for n in range(3) for p in itertools.product(("user", "assistant"), repeat=n)]

    def go(i, letters, cost, audit, lines):
        for put in puts:
            now = letters + "".join(r[0] for r in put)
            if not re.fullmatch(r"(s?(ua)*u?)?", now):
                continue
            price, note, said = cost + 3 * len(put), audit + "I" * len(put), lines + [f"{r}:" for r in put]
            if i == len(turns):
                if LEGAL.fullmatch(now):
                    yield price, note, said
                continue
            role, text = turns[i]
            extra = 3 if found[i] == "truncated" else 0
            yield from go(i + 1, now, price + 4, note + "D", said)
            if found[i] in ("", "truncated"):
                yield from go(i + 1, now + role[:1] if role else now + "?", price + extra, note + "K", said + [f"{role}:{text}"])
                for new in ("user", "assistant"):
                    yield from go(i + 1, now + new[0], price + 3 + extra, note + "R", said + [f"{new}:{text}"])

    return min(go(0, "", 0, "", []))


def rows():
    rng = random.Random(9)
    out = []
    for conv in range(60):
        for turn in range(rng.randint(1, 3)):
            out.append((conv, turn * rng.choice([1, 1, 3]), rng.choice(["user", "assistant", "system", "tool", "User", "", None]),
                        rng.choice(["Done.", "Cut off", " \t\n", "", None, "One. Two? ", "Same."]), "x"))
    return out + [(500, None, "user", "b.", None), (500, None, "assistant", "a.", None), (500, 4, "assistant", "c.", None), (500, 4, "user", "c.", None),
                  (None, 0, "user", "n.", None), (None, 1, "assistant", "m.", None), (501, 0, "user", "same.", "x"), (501, 0, "user", "same.", "x")]


@pytest.mark.parametrize("block", [1024, 2, 1])
def test_cheapest_edits_among_all_scripts(spark, monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK", block)
    data = rows()
    frame = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = {r["conv_id"]: r for r in conversations.repair_structure(frame).collect()}
    spoken = {}
    for r in conversations.repaired_turns(frame).orderBy("position").collect():
        spoken.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert set(got) == {r[0] for r in data}
    for conv, r in got.items():
        mine = sorted((x for x in data if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2] if x[2] is not None else " ", x[3] if x[3] is not None else " "))
        turns = [(x[2] if x[2] is not None else " ", x[3] if x[3] is not None else " ") for x in mine]
        cost, audit, lines = every_script(turns)
        assert (r["cost"], r["audit"]) == (cost, audit), turns
        assert spoken.get(conv, []) == lines and r["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()
        kinds = faults(turns)
        assert [r["blank"], r["duplicate"], r["truncated"]] == [kinds.count(k) for k in ("blank", "duplicate", "truncated")]
        assert r["illegal"] == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        known = [x[1] for x in mine if x[1] is not None]
        assert r["gaps"] == (max(known) - min(known) + 1 - len(set(known)) if known else 0)


@pytest.mark.parametrize("block", [3, 1])
def test_sql_agrees_across_blocks(spark, tiny, monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK", block)
    monkeypatch.setattr(conversations, "HEAVY", 4)
    assert verdict(spark_rows(op12_conversation_structure(spark, tiny)), duck_rows(SQL["op12_conversation_structure"], tiny)) == "ok"


def test_hot_and_long_conversations_and_odd_keys(spark, tmp_path):
    """A third of the rows in one conversation, one signature in most others, nulls, long texts."""
    rng = random.Random(2)
    data = [(7, i, rng.choice(["user", "assistant"]), rng.choice(["a.", "b", f"c{i}."]), None) for i in range(3000)]
    data += [(1000 + c, t, ("user", "assistant")[t], f"say {c}.", None) for c in range(1500) for t in range(2)]
    data += [(None, None, None, None, None), (8, None, "user", "long " * 100_000, None), (8, 2, "assistant", "x" * 300_000, None)]
    spark.createDataFrame(data, SCHEMA).drop("gaps").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = spark_rows(op12_conversation_structure(spark, str(tmp_path)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute("SELECT count(DISTINCT coalesce(conv_id, -1)) FROM conversations").fetchone()[0]
    assert len(got[1]) == want
    names = got[0]
    hot = next(r for r in got[1] if r[names.index("conv_id")] == 7)
    audit = hot[names.index("audit")]
    assert len(audit) > 2500 and hot[names.index("gaps")] > 0
    cost = 4 * audit.count("D") + 3 * audit.count("I") + 3 * audit.count("R")
    assert cost <= hot[names.index("cost")] <= cost + 3 * hot[names.index("truncated")]


def test_dropped_conversations_and_empty_table(spark):
    every = spark.createDataFrame([(1,), (2,), (None,)], "conv_id long")
    turns = spark.createDataFrame([(1, 0, "user", "hi.", "")], SCHEMA)
    got = {r["conv_id"]: r for r in conversations.repair_structure(turns, every).collect()}
    assert set(got) == {1, 2, None}
    assert tuple(got[2])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) == tuple(got[None])[1:]
    assert (got[1]["cost"], got[1]["audit"]) == (3, "KI")
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.repair_structure(empty).count() == 0 and conversations.repaired_turns(empty).count() == 0


def test_a_suffix_is_one_node():
    """Words sorted by their end share the stack; costs equal those of a fresh stack."""
    words = sorted({"".join(random.Random(i).choices(conversations.SYMBOLS, k=i % 9)) for i in range(200)})
    shared = conversations.Suffixes()
    for word in words:
        for state in range(4):
            assert shared.solve(conversations.END, word, state) == conversations.Suffixes().solve(conversations.END, word, state)
