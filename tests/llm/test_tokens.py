"""Encoding, counting, Arrow files and packing against the libraries and brute force."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from foretally.llm import arrow_files, encoding, packing, token_counts

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))

TRICKY = ["", " ", "  a", "a  b", "a \n b", "a\n\nb", "a\nb", "\n", "tail ", "tail\n", "it's we'll 's", "x" * 5000, "a" * 4097, "ab" * 3000,
          "end<|endoftext|>mid <|endoftext|>", "<|startoftext|> x <|endoftext|>", "\x00a \x01b", "a\tb c d", "é ́e é", "日本語 テキスト 123 4567",
          "Ǆ ß İi ﬁ Σς", "a\x1cb \x85c​d", "### $$$ 12.5% <b>&amp;</b>", "👩‍👩‍👧 🙂🙂", "don't DON'T 'S 'll've", "\r\nx\r\n y", "　x　 y"]


def texts():
    rng = random.Random(7)
    alphabet = list("abcdeß éà09.,'#\n\t ") + [" ", " ", "the", " and", " ", " ", "ing", "'s", "\r\n", "日", "<|endoftext|>"]
    letters = "abzABZßÉéñÑçÇøØœŒžŽıİǅŉĸſáü"
    words = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 9))) + rng.choice(["", ".", ",", "\n"]) for _ in range(12)) for _ in range(300)]
    return TRICKY + words + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(1500)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_library(path):
    library, own = Tokenizer.from_file(path), encoding.Encoder(path)
    cases = texts()
    for _ in range(2):  # once with an empty cache, once with a full one
        got = own.encode(cases)
        for text, ids in zip(cases, got):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_counts_equal_library():
    library, own = Tokenizer.from_file(BYTE), token_counts.Counter(BYTE)
    cases = texts()
    for _ in range(2):
        assert own.count(cases) == [len(library.encode(t, add_special_tokens=False).ids) for t in cases]


def test_every_code_point_counts_as_in_the_library():
    library, own = Tokenizer.from_file(BYTE), token_counts.Counter(BYTE)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    cases = [" ".join(f"a{chr(c)}1{chr(c)}{chr(c)}." for c in points[i:i + 500]) for i in range(0, 0x30000, 500)]
    wrong = [i for i, (t, n) in enumerate(zip(cases, own.count(cases))) if n != len(library.encode(t, add_special_tokens=False).ids)]
    assert not wrong


def frame(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame(rows, schema)


def odd_rows():
    return [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "null id", "en", "s", 1), (3, "same", "en", "s", 1), (3, "same", "en", "s", 1),
            (4, "long words " * 20000, "en", "s", 1), (5, "<|endoftext|>", "en", "s", 1), (6, "a  b\n\nc ", "xx", "s", 9)]


def test_count_tokens_rows(spark):
    library = Tokenizer.from_file(BYTE)
    rows = odd_rows()
    got = sorted(token_counts.count_tokens(frame(spark, rows), BYTE).collect(), key=str)
    want = []
    for doc, text, *_ in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((doc, len((text or "").encode()), n, n > 512))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.count_tokens(frame(spark, []), BYTE).count() == 0


def test_arrow_files_round_trip(spark):
    library = Tokenizer.from_file(BYTE)
    rows = odd_rows() + [(i, f"text number {i} " * (i % 7), "en", "s", 1) for i in range(100, 160)]
    manifest = arrow_files.write_arrow(frame(spark, rows), BYTE, length=16)
    got = sorted(arrow_files.read_documents(manifest).collect(), key=lambda r: r["start"])
    ids = {}
    for doc, text, *_ in rows:
        ids.setdefault(doc, []).append(library.encode(text or "", add_special_tokens=False).ids + [0])
    start = 0
    for row in got:
        mine = np.frombuffer(row["ids"], "<u4").tolist()
        assert mine in ids[row["doc_id"]] and row["start"] == start and row["n_tokens"] == len(mine)
        start += len(mine)
    assert [r["doc_id"] for r in got] == sorted([r[0] for r in rows], key=lambda d: -1 if d is None else d)
    files = manifest.orderBy("part").collect()
    flat = []
    for f in files:
        file = arrow_files.SequenceFile(f["tokens"])
        for i in range(len(file)):
            view, mask = file[i]
            assert len(view) == len(mask) == 16 and not view.flags.owndata
            flat += view[mask].tolist()
    assert flat == [t for row in got for t in np.frombuffer(row["ids"], "<u4").tolist()]
    assert arrow_files.read_documents(arrow_files.write_arrow(frame(spark, []), BYTE)).count() == 0


def fewest(lengths, capacity):
    """Fewest bins by trying every way, for a few pieces."""
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for b in set(range(len(bins))):
            if bins[b] + lengths[i] <= capacity:
                go(i + 1, bins[:b] + [bins[b] + lengths[i]] + bins[b + 1:])
        go(i + 1, bins + [lengths[i]])

    go(0, [])
    return best


def places(plan):
    """Every piece's (bin, offset, length) from the runs."""
    out = []
    runs = sorted(plan.runs)
    for (length, first, bin_, each, offset), later in itertools.zip_longest(runs, runs[1:]):
        last = later[1] if later and later[0] == length else int(plan.taken[length])
        out += [(bin_ + (r - first) // each, offset + (r - first) % each * length, length) for r in range(first, last)]
    return out


def check_plan(counts, capacity):
    plan = packing.plan_packing(dict(counts), capacity)
    laid = sorted(places(plan))
    assert {x: sum(p[2] == x for p in laid) for x in counts} == dict(counts)
    ends = {}
    for bin_, offset, length in laid:
        assert ends.get(bin_, 0) == offset
        ends[bin_] = offset + length
    assert sorted(ends) == list(range(plan.bins)) and all(e <= capacity for e in ends.values())
    return plan


def test_plans_are_whole_and_reduction_keeps_the_optimum():
    rng = random.Random(3)
    for _ in range(400):
        capacity = rng.randint(5, 30)
        lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        counts = {x: lengths.count(x) for x in lengths}
        plan = check_plan(counts, capacity)
        best = fewest(lengths, capacity)
        assert best <= plan.bins <= best + 1
        reduced = packing.Plan(counts, capacity)
        fixed = reduced.reduce()
        left = [x for x in range(capacity, 0, -1) for _ in range(int(reduced.left[x]))]
        assert fixed + fewest(left, capacity) == best if left else fixed == best


def test_large_histogram_is_near_the_bound():
    rng = np.random.default_rng(5)
    counts = {int(x): int(n) for x, n in zip(range(1, 2049), rng.integers(0, 10**7, 2048)) if n}
    plan = packing.plan_packing(counts, 2048)
    bound = -(-sum(x * n for x, n in counts.items()) // 2048)
    assert plan.bins <= bound * 1.01 and len(plan.runs) < 20 * 2048
    check_plan({int(x): int(n) for x, n in zip(range(1, 2049), rng.integers(0, 5, 2048)) if n}, 2048)


def test_pack_documents(spark):
    library = Tokenizer.from_file(WORD)
    rows = odd_rows() + [(i, "word " * (i % 90), "en", "s", 1) for i in range(100, 400)]
    got = packing.pack_documents(frame(spark, rows), WORD, capacity=64).collect()
    docs = {}
    for r in got:
        docs.setdefault(r["doc_id"], []).append(r)
    for doc, text, *_ in rows:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        pieces = [(i, s, len(ids[s:s + 64]), zlib.crc32(ids[s:s + 64].tobytes()), ids[s:s + 64].astype("<u2").tobytes()) for i, s in enumerate(range(0, len(ids), 64))]
        mine = {(r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in docs[doc]}
        assert mine == set(pieces)
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert ends.get(r["sequence_id"], 0) == r["offset"]
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 64 and len(ends) <= -(-sum(r["length"] for r in got) // 64) + 1
    assert packing.pack_documents(frame(spark, []), WORD).count() == 0
