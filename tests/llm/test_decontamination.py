"""Benchmark decontamination against a plain search."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from foretally.llm import decontamination as dec

DOCS, ITEMS = "doc_id long, text string, lang string, rid int", "item_id long, text string"


def words(text):
    low = (text or "").translate(str.maketrans(dec.UPPER, dec.LOWER))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(docs, items):
    out = []
    cut = [(i, [tuple(w[k:k + 10]) for k in range(max(1, len(w) - 9))]) for i, t in items for w in [words(t)] if w]
    for doc, text, *_ in docs:
        w, hit, found = words(text), set(), []
        for item, windows in cut:
            met = False
            for win in windows:
                for k in range(len(w) - len(win) + 1):
                    if tuple(w[k:k + len(win)]) == win:
                        hit |= set(range(k, k + len(win)))
                        met = True
            if met:
                found.append(item)
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, docs, items):
    got = dec.contamination(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), carry=["doc_id"])
    got = got.select("row.doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256))
    return sorted(map(tuple, got.collect()), key=str)


def test_against_plain_search(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)] + ["Über", "ÉTÉ", "日本", "the", "THE"]
    prose = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, k=n))
    items = [(i, prose(rng.randint(8, 25))) for i in range(25)] + [(90, "the"), (91, "w1 w2"), (92, ""), (93, None), (94, "w3 w3 w3 w3 w3 w3 w3 w3 w3 w3 w3")]
    items += [(95, items[0][1]), (10, items[1][1].upper())]
    docs = [(i, prose(rng.randint(0, 60)) + " " + (items[rng.randrange(25)][1] if i % 3 else "") + " " + prose(5), "en", i) for i in range(60)]
    docs += [(100, None, None, None), (101, "", "en", 1), (None, items[2][1], "en", 1), (102, items[3][1], "en", 1), (102, items[3][1], "en", 1),
             (103, "w3 " * 5000 + items[4][1] * 3, "en", 1), (104, "\0 w1\x7fw2 \x01", "en", 1), (105, ".,-", "en", 2)]
    assert run(spark, docs, items) == plain(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b", "x", 1)], []) == plain([(1, "a b")], [])


def test_clean_documents_keep_all_columns(spark):
    docs = spark.createDataFrame([(1, "x alpha beta y", "en", 5), (2, "gamma", "en", 6)], DOCS)
    kept = dec.clean_documents(docs, spark.createDataFrame([(1, "alpha beta")], ITEMS))
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "gamma", "en", 6)]


def test_proximity(spark):
    text = "rare1 " + "the " * 8 + "rare2 " + "the " * 60 + "rare1"
    stored = dec.store_words(spark.createDataFrame([(1, text, "en", 1)], DOCS), ["doc_id"])
    windows = dec.item_windows(spark.createDataFrame([(1, "rare1 the rare2")], ITEMS))
    assert [r["start"] for r in dec.near_matches(stored, windows, within=20).collect()] == [9]
    assert dec.near_matches(stored, windows, within=5).count() == 0


def test_shifted_lists_are_intersected_where_they_arise(spark, monkeypatch):
    """No exchange by places: only the index and each text, once, are dealt out by document."""
    plans, store = [], dec.durable
    monkeypatch.setattr(dec, "durable", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or store(df))
    text = "the cat sat on the mat and the dog sat on the cat"
    stored = dec.store_words(spark.createDataFrame([(i, text, "en", i) for i in range(50)], DOCS), ["doc_id"])
    windows = dec.item_windows(spark.createDataFrame([(1, "the cat sat"), (2, "dog the dog"), (3, "mat")], ITEMS))
    matches = dec.phrase_matches(stored, windows)
    assert sorted(matches.groupBy("win", "start").count().collect()) == [("mat", 5, 50), ("the cat sat", 0, 50)]
    keys = re.findall(r"hashpartitioning\((.*?), \d+\)", "\n".join(plans))
    assert any(k.startswith("rid#") for k in keys) and not any("start#" in k or "pos#" in k for k in keys)
