"""The Jaccard join against all pairs, its parts, and odd rows."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from foretally.llm import jaccard_join as jj
from foretally.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string, lang string, rid int, label string"


def shingles(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def plain(rows):
    sets = [shingles(r[1]) for r in rows]
    links, up = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
            links[i] += 1
            links[j] += 1
            up[find(j)] = find(i)
    classes = {}
    for i, r in enumerate(rows):
        classes.setdefault(find(i), []).append(r[0])
    least = {k: min((d for d in v if d is not None), default=None) for k, v in classes.items()}
    return sorted(((r[0], least[find(i)], links[i]) for i, r in enumerate(rows)), key=str), len(classes)


def rows():
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(400)] + ["Été", "日本"]
    out = []
    for i in range(60):
        base = rng.choices(vocabulary, k=rng.randint(3, 150))
        for j in range(rng.choice([1, 1, 2, 4, 9])):
            words = list(base)
            for _ in range(rng.randint(0, 4) if j else 0):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append((len(out), " ".join(words).upper() if j % 3 == 2 else ", ".join(words), "en", i, "x"))
    hot = rng.choices(vocabulary, k=120)
    for j in range(150):  # a large group of near copies
        words = list(hot)
        words[rng.randrange(120)] = f"z{j}"
        out.append((len(out), " ".join(words), "en", 1, "x"))
    shared = " ".join(rng.choices(vocabulary, k=30))
    out += [(len(out) + j, shared + " " + " ".join(rng.choices(vocabulary, k=40)), "en", 1, "x") for j in range(40)]  # one common passage
    out += [(9000, None, None, None, None), (9001, "", "en", 1, "x"), (9002, " .,- ", "en", 1, "x"), (None, out[0][1], "en", 1, "x"), (5, out[5][1], "en", 1, "x"),
            (5, out[5][1], "en", 1, "x"), (9003, "one two", "en", 1, "x"), (9004, "One, TWO", "en", 1, "x"), (9005, "one two three", "en", 1, "x"),
            (9006, "long text " * 30000, "en", 1, "x"), (None, None, None, None, None), (None, "null id alone here now", "en", 1, "x")]
    return out


@pytest.mark.parametrize("block", [512, 16])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(jj, "BLOCK_ROWS", block)
    got = jj.jaccard_join(spark.createDataFrame(rows(), SCHEMA).repartition(3), carry=["doc_id"]).select("row.doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got), key=str) == plain(rows())[0]


def test_one_of_each_keeps_columns(spark):
    data = rows()
    kept = jj.one_of_each(spark.createDataFrame(data, SCHEMA))
    assert kept.columns == ["doc_id", "text", "lang", "rid", "label"]
    ids = [r["doc_id"] for r in kept.collect()]
    want, classes = plain(data)
    assert set(ids) == {r[1] for r in want} and len(ids) == classes
    assert jj.one_of_each(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shingles_are_those_of_the_words():
    rng = random.Random(1)
    texts = ["", "a", "a b c d", "a b c d e", "A-b.c d\ne f", "é É", "a b c d e a b c d e"] + ["".join(rng.choices("ab ,Cé", k=rng.randint(0, 60))) for _ in range(300)]
    hashes, sizes = shingle_sets(texts)
    seen = {}
    for text, part in zip(texts, np.split(hashes, np.cumsum(sizes)[:-1])):
        assert len(part) == len(shingles(text)) and (np.diff(part.astype(object)) > 0).all()
        assert seen.setdefault(frozenset(shingles(text)), part.tobytes()) == part.tobytes()
    assert len(set(seen.values())) == len(seen)


def test_pruning_keeps_similar_pairs():
    rng = np.random.default_rng(0)
    lost = 0
    for similarity in (0.8, 0.85):
        same = rng.random((20000, jj.HASHES)) < similarity
        signatures = np.concatenate([np.zeros_like(same, np.uint32), (~same).astype(np.uint32)])
        a, _ = jj.surviving(np.arange(20000), np.arange(20000, 40000), signatures)
        lost += 20000 - a.size
    assert lost <= 2
    far = (rng.random((20000, jj.HASHES)) >= 0.4).astype(np.uint32)
    a, _ = jj.surviving(np.arange(20000), np.arange(20000, 40000), np.concatenate([np.zeros_like(far), far]))
    assert a.size < 200


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(200)] + [(1000 + rng.randrange(50), 1000 + rng.randrange(50)) for _ in range(40)] + [(5000, 5000)]
    got = {r["a"]: r["label"] for r in jj.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}
    for a, b in edges:
        for x in (a, b):
            up.setdefault(x, x)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(up[a], up[b])
            if up[a] != low or up[b] != low:
                up[a] = up[b] = low
                changed = True
    assert got == {k: v for k, v in up.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert jj.components(spark.createDataFrame([], "a long, b long")).count() == 0
