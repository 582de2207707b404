"""Compression language identification: held-out accuracy, a plain version, and odd rows."""

import zlib

import pytest
import zstandard

from foretally.llm import language_id
from foretally.llm.queries import op13_compression_language

SCHEMA = "doc_id long, text string, lang string, guess string"


def plain(model, text):
    """Sizes of a lower-cased text with each dictionary."""
    raw = text.encode()
    raw = raw if len(raw) >= 256 else b" ".join([raw] * 3)
    out = {}
    for name, content in model:
        words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        tool = zstandard.ZstdCompressor(level=9, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)
        out[name] = sum(len(tool.compress(raw[i:i + 2048])) for i in range(0, len(raw), 2048))
    return out


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = op13_compression_language(spark, folder).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in docs if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) > 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    sure = [r for r in held if not r["narrow"]]
    assert len(sure) > 0.97 * len(held) and sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in sure) > 0.985 * len(sure)


def test_smallest_of_plain_compression(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    model = language_id.learn(docs)
    assert {name for name, _ in model} == {"en", "fr", "de", "es"} and all(len(c) <= 4 * language_id.DICTIONARY for _, c in model)
    for r in language_id.identify(docs, model).collect():
        sizes = plain(model, r["row"]["text"].lower())
        assert sizes[r["guess"]] == min(sizes.values())
        first, second = sorted(sizes.values())[:2]
        assert r["narrow"] == (second - first < language_id.MARGIN * second)
        assert r["lang"] == (None if r["narrow"] else r["guess"])


def test_labels_of_judged_rows_do_not_matter(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    model = language_id.learn(docs)
    from pyspark.sql import functions as F
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("s"), "doc_id": F.col("doc_id") + 10**6})
    mine = sorted((r["row"]["doc_id"], r["guess"]) for r in language_id.identify(docs, model).collect())
    theirs = sorted((r["row"]["doc_id"] - 10**6, r["guess"]) for r in language_id.identify(other, model).collect())
    assert mine == theirs
    assert language_id.learn(docs.repartition(7)) == model


def test_odd_rows(spark):
    learnt = [(1, "the cat sat on the mat and the dog", "en", ""), (2, "die katze und der hund", "de", ""), (3, None, "en", ""), (4, "12 34", "en", ""),
              (5, "le chat", None, ""), (1, "the cat sat on the mat and the dog", "en", "")]
    model = language_id.learn(spark.createDataFrame(learnt, SCHEMA))
    assert [name for name, _ in model] == ["en", "de"]
    asked = [(1, None, "en", "g"), (2, "", None, "g"), (3, "123 !?", None, "g"), (4, "The cat and the dog", None, "g"), (5, "die katze " * 60000, None, "g"),
             (None, "der hund und die katze", "en", None), (None, "der hund und die katze", "en", None)]
    got = language_id.identify(spark.createDataFrame(asked, SCHEMA), model).collect()
    assert [(r["guess"], r["score"], r["lang"]) for r in got[:3]] == [("und", 0.0, None)] * 3
    assert [r["guess"] for r in got[3:]] == ["en", "de", "de", "de"] and got[5] == got[6] and got[0]["row"]["guess"] == "g"


@pytest.mark.parametrize("learnt, guess", [([], "und"), ([(1, "hello", "en", "")], "en")])
def test_nothing_or_one_language_learnt(spark, learnt, guess):
    model = language_id.learn(spark.createDataFrame(learnt, SCHEMA))
    docs = spark.createDataFrame([(1, "hello", "en", "")], SCHEMA)
    assert [r["guess"] for r in language_id.identify(docs, model).collect()] == [guess]
    assert language_id.identify(docs.limit(0), model).count() == 0
