"""Role repair against every possible repair, across blocks, and odd rows."""

import itertools
import random
import re

import pytest

from foretally.llm import chat

SCHEMA = "conv_id long, turn int, role string, text string, position string"


def legal(roles):
    rest = roles[1:] if roles[:1] == ["system"] else roles
    return len(rest) % 2 == 0 and (len(rest) > 0 or not roles) and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(rest))


def cheapest(found):
    """Every labelling, every choice of merges, and the fewest insertions that make it legal."""
    best = 10**9
    for given in itertools.product(chat.ROLES, repeat=len(found)):
        price = sum(chat.RELABEL for f, g in zip(found, given) if f != g)
        for merged in itertools.product([False, True], repeat=max(0, len(given) - 1)):
            if any(m and given[i] != given[i + 1] for i, m in enumerate(merged)):
                continue
            turns = [g for i, g in enumerate(given) if i == 0 or not merged[i - 1]]
            if "system" in turns[1:]:
                continue
            rest, put, last = turns[turns[:1] == ["system"]:], 0, "assistant"
            for t in rest:
                put += t == last
                last = t
            put += (last == "user") + (2 if turns and not rest else 0)
            best = min(best, price + chat.MERGE * sum(merged) + chat.INSERT * put)
    return best


def roles_of(text):
    return re.findall(r"<\|(user|assistant|system)\|>\n", text)


def rows():
    rng = random.Random(6)
    out = []
    for conv in range(120):
        for turn in range(rng.randint(1, 6)):
            out.append((conv, turn, rng.choice(["user", "assistant", "system", "User ", "tool", None]), f"t{turn}", "x"))
    return out + [(500, None, "user", None, None), (500, None, "user", "b", None), (500, 1, "assistant", "a", None), (None, 0, "user", "n", None),
                  (None, 1, "assistant", "m", None), (501, 0, "user", "same", "x"), (501, 0, "user", "same", "x"), (502, 0, "user", "long " * 50000, "x")]


@pytest.mark.parametrize("block", [1024, 2])
def test_repairs_are_legal_and_cheapest(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    data = rows()
    got = chat.repair(spark.createDataFrame(data, SCHEMA).repartition(3)).collect()
    convs = {}
    for r in got:
        convs.setdefault(r["conv_id"], []).append(r)
    assert len(got) == len(data) and set(convs) == {r[0] for r in data}
    for conv, turns in convs.items():
        turns.sort(key=lambda r: r["position"])
        assert [r["position"] for r in turns] == list(range(len(turns)))
        text = "".join(r["piece"] for r in turns)
        assert legal(roles_of(text)) and text.count("<|end|>") == len(roles_of(text))
        found = [(r["role"] or "").strip().lower() for r in turns]
        if len(found) <= 6:
            assert sum(r["cost"] for r in turns) == cheapest(found), (found, [tuple(r)[4:9] for r in turns])
        at = 0
        for r in sorted((r for r in data if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or "")):
            at = text.index(r[3] or "", at) + len(r[3] or "")


def test_legal_conversations_stay(spark):
    data = [(1, 0, "system", "s", ""), (1, 1, "user", "u", ""), (1, 2, "assistant", "a", "")]
    got = chat.repair(spark.createDataFrame(data, SCHEMA)).orderBy("position").collect()
    assert {r["action"] for r in got} == {"keep"} and sum(r["cost"] for r in got) == 0
    assert "".join(r["piece"] for r in got) == "<|system|>\ns\n<|end|>\n<|user|>\nu\n<|end|>\n<|assistant|>\na\n<|end|>\n"
    assert chat.repair(spark.createDataFrame([], SCHEMA)).count() == 0
