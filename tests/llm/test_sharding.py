"""Jump consistent hashing against the published loop, growth, slots and odd rows."""

import random

import numpy as np

from foretally.llm import sharding

SCHEMA = "doc_id long, shard string, slot int"


def plain(key, shards):
    state, at, ahead = key % 2**64, -1, 0
    while ahead < shards:
        at = ahead
        state = (state * 2862933555777941757 + 1) % 2**64
        ahead = int((at + 1) * (float(1 << 31) / float((state >> 33) + 1)))
    return at


def test_jump_is_the_published_loop_and_moves_only_into_the_new_shard():
    rng = random.Random(2)
    keys = [0, 1, -1, 2**63 - 1, -(2**63)] + [rng.randrange(-(2**63), 2**63) for _ in range(3000)]
    array = np.array(keys, np.int64)
    before = sharding.jump(array, 1)
    assert not before.any()
    for shards in (2, 3, 16, 17, 1000):
        assert sharding.jump(array, shards).tolist() == [plain(k, shards) for k in keys]
    for shards in range(1, 40):
        after = sharding.jump(array, shards + 1)
        assert ((after == before) | (after == shards)).all()
        before = after
    counts = np.bincount(sharding.jump(np.arange(160_000), 16))
    assert counts.min() > 9_400 and counts.max() < 10_600


def test_slots_are_gapless_and_odd_rows_are_placed(spark):
    rows = [(i, "x", i) for i in range(300)] + [(None, None, None)] * 3 + [(7, "same", 1)] * 200
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).select("doc_id")
    got = sharding.place_rows(df, "doc_id", 16, ["doc_id"]).collect()
    assert len(got) == len(rows)
    for shard in range(16):
        mine = sorted((r["slot"], r["doc_id"]) for r in got if r["shard"] == shard and r["doc_id"] is not None)
        every = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert every == list(range(len(every))) and [d for _, d in mine] == sorted(d for _, d in mine)
    assert all(r["shard"] == plain(r["doc_id"] or 0, 16) and r["grown_shard"] == plain(r["doc_id"] or 0, 17) for r in got)
    assert sharding.place_rows(df.limit(0), "doc_id", 16, ["doc_id"]).count() == 0


def test_written_shards_keep_clashing_columns(spark, tmp_path):
    df = spark.createDataFrame([(i, f"s{i}", i) for i in range(50)], SCHEMA)
    sharding.write_shards(df, "doc_id", 4, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["doc_id"], r["shard"], r["slot"], r["shard_"]) for r in back.collect()) == [(i, f"s{i}", i, plain(i, 4)) for i in range(50)]


def test_placed_rows_keep_clashing_columns(spark):
    rows = [(i, f"s{i}", i * 10, -i, i % 3, 5) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, shard string, Slot int, grown_shard int, _seq int, _part int")
    got = sharding.place_rows(df, "doc_id", 4, ["doc_id"])
    assert got.columns == [*df.columns, "shard_", "grown_shard_", "slot_"]
    back = got.collect()
    assert sorted(tuple(r)[:6] for r in back) == sorted(rows)
    assert all(r["shard_"] == plain(r["doc_id"], 4) and r["grown_shard_"] == plain(r["doc_id"], 5) for r in back)
    for shard in range(4):
        slots = [r["slot_"] for r in sorted(back, key=lambda r: r["doc_id"]) if r["shard_"] == shard]
        assert slots == list(range(len(slots)))
