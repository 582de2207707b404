"""The corpus pipeline on the smallest tables, stage by stage against plain versions."""

import numpy as np
import public_tokenizers
from test_decontamination import plain as plain_contamination
from test_jaccard_join import plain as plain_classes
from test_quality import plain_base
from tokenizers import Tokenizer

import corpus_pipeline


def test_stages_against_plain_versions(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns = docs.columns
    rows = [tuple(r) for r in docs.collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").select("item_id", "text").collect()]
    at = columns.index("text")
    (_, quality), (_, near), (_, clean), (_, pack) = corpus_pipeline.STAGES

    one = quality(spark, docs, tiny)
    assert one.columns == columns
    kept = [tuple(r) for r in one.collect()]
    assert set(kept) <= set(rows)
    for r in kept:
        n, *_, repeated = plain_base(r[at] or "")
        assert n >= 50 and 100 * repeated <= 50 * n
    # what else goes is full of symbols or far from its language
    passing = [r for r in rows for b in [plain_base(r[at] or "")] if b[0] >= 50 and 100 * b[4] <= 50 * b[0]]
    assert len(kept) >= 0.9 * len(passing)

    two = near(spark, spark.createDataFrame(kept, docs.schema), tiny)
    single = [tuple(r) for r in two.collect()]
    classes, n = plain_classes([(r[0], r[at]) for r in kept])
    assert two.columns == columns and sorted(r[0] for r in single) == sorted({c for _, c, _ in classes}) and len(single) == n

    three = clean(spark, spark.createDataFrame(single, docs.schema), tiny)
    left = [tuple(r) for r in three.collect()]
    hits = {doc: hit for doc, _, hit, *_ in plain_contamination([(r[0], r[at]) for r in single], items)}
    assert three.columns == columns and sorted(left, key=str) == sorted((r for r in single if hits[r[0]] == 0), key=str)

    pieces = pack(spark, spark.createDataFrame(left, docs.schema), tiny).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r[0]: len(library.encode(r[at] or "", add_special_tokens=False).ids) + 1 for r in left}
    got = {}
    for p in pieces:
        got[p["doc_id"]] = got.get(p["doc_id"], 0) + p["length"]
    assert got == want
    sizes = np.bincount([p["sequence_id"] for p in pieces], weights=[p["length"] for p in pieces])
    assert sizes.max() <= 2048 and len(sizes) <= -(-sum(want.values()) // 2048) + 1


def test_run_applies_all_stages(spark, tiny):
    packed = corpus_pipeline.run(spark, tiny)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert 0 < packed.select("doc_id").distinct().count() < spark.read.parquet(f"{tiny}/documents.parquet").count()


def test_stages_with_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
