"""Token counts by rank-synchronous array merging.

Distinct pre-tokens of a batch lie one after another in flat numpy arrays (symbol ids and
the number of the sequence they belong to).  In every round each sequence finds its pair of
lowest rank and all its non-overlapping occurrences are merged, in all sequences at once;
sequences without a pair left are counted and leave the arrays.  The surviving symbols are
the tokens.  The vocabulary is a byte-level BPE file of the tokenizers library; special
strings inside texts count as one token, as is the library's default.

Null and empty texts have no tokens.  Texts are cut at spaces first, so a text of any
length is a list of short units; a single unit of any length is one sequence.
"""

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretally.llm.common import chunks, short_batches, trim, worker_state
from foretally.llm.encoding import FIRST, LINE, byte_letters, is_clean, unit_text, units_of

NONE = np.int64(1) << 40  # above every rank
SHIFT = np.int64(1) << 20  # above every id
CACHE_UNITS = 500_000

# fixed value: the published pre-token pattern of the byte-level vocabularies
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Merges:
    """Pair ranks as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        pairs = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
        keys = np.array([vocab[a] * int(SHIFT) + vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.first = np.array([vocab[c] for _, c in sorted(byte_letters().items())], np.int64)
        self.specials = [x["content"] for x in spec.get("added_tokens", [])]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left * SHIFT + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.order[at], NONE)

    def count(self, sequences: list[bytes]) -> np.ndarray:
        """Surviving symbols of each byte sequence."""
        sizes = np.array([len(s) for s in sequences], np.int64)
        survivors = np.zeros(len(sequences), np.int64)
        ids = self.first[np.frombuffer(b"".join(sequences), np.uint8)]
        owner = np.repeat(np.arange(len(sequences)), sizes)
        rank = np.full(ids.size, NONE)
        if ids.size > 1:
            rank[:-1] = np.where(owner[1:] == owner[:-1], self.rank(ids[:-1], ids[1:]), NONE)
        while ids.size:
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            widths = np.diff(np.r_[heads, ids.size])
            best = np.minimum.reduceat(rank, heads)
            done = best == NONE
            survivors[owner[heads[done]]] = widths[done]
            hits = np.flatnonzero((rank == np.repeat(best, widths)) & (rank < NONE))
            if not hits.size:
                break
            # occurrences of one pair overlap only in runs of a single symbol: take every other one
            run_head = np.r_[True, np.diff(hits) != 1]
            run_at = hits - np.repeat(hits[run_head], np.diff(np.r_[np.flatnonzero(run_head), hits.size]))
            hits = hits[run_at % 2 == 0]
            ids[hits] = self.made[rank[hits]]
            keep = np.repeat(~done, widths)
            keep[hits + 1] = False
            moved = np.cumsum(keep)[hits] - 1
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            rank[moved] = NONE
            for touched in (moved, moved - 1):  # the pair that a new symbol begins, and the one it ends
                touched = touched[(touched >= 0) & (touched + 1 < ids.size)]
                same = owner[touched] == owner[touched + 1]
                rank[touched] = np.where(same, self.rank(ids[touched], ids[touched + 1]), NONE)
        return survivors


class Counter:
    """Token counts of whole texts, with a bounded cache of unit counts."""

    def __init__(self, path: str):
        import regex

        self.merges = Merges(path)
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, self.merges.specials))) if self.merges.specials else None
        self.cache: dict[str, int | None] = {}

    def learn(self, fresh: dict[str, list[str]]) -> None:
        """``fresh``: the pre-tokens of each new unit.  All distinct ones are merged together."""
        distinct = list(dict.fromkeys(t for tokens in fresh.values() for t in tokens))
        counts = dict(zip(distinct, self.merges.count([t.encode() for t in distinct]).tolist()))
        for unit, tokens in fresh.items():
            self.cache[unit] = sum(counts[t] for t in tokens)

    def count(self, texts: list[str]) -> list[int]:
        trim(self.cache, CACHE_UNITS)
        parts, owner, specials = [], [], [0] * len(texts)
        for i, text in enumerate(texts):
            cut = self.special.split(text) if self.special and self.special.search(text) else [text]
            specials[i] = len(cut) - 1
            parts += cut
            owner += [i] * len(cut)
        cut = [None if FIRST in p or LINE in p else units_of(p, True) for p in parts]
        fresh = set(chain.from_iterable(units for units in cut if units)).difference(self.cache)
        self.cache.update(dict.fromkeys(u for u in fresh if not is_clean(u)))
        self.learn({u: self.pattern.findall(unit_text(u)) for u in fresh if is_clean(u)})
        totals, odd = list(specials), []
        for i, units, part in zip(owner, cut, parts):
            try:
                totals[i] += sum(map(self.cache.__getitem__, units))
            except TypeError:  # wide white space or marker characters: pre-tokens of the whole part
                odd.append((i, [LINE + LINE + t for t in self.pattern.findall(part)]))
        self.learn({t: [t[2:]] for _, tokens in odd for t in tokens if t not in self.cache})
        for i, tokens in odd:
            totals[i] += sum(map(self.cache.__getitem__, tokens))
        return totals


def token_count(text: Column, path: str) -> Column:
    """Tokens of each whole text by the vocabulary file at ``path``."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = worker_state(("token counter", path), lambda: Counter(path))
        for batch in batches:
            yield pd.Series([n for part in chunks(batch) for n in counter.count(part)], dtype="int64")

    return count(text)


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` of every row; no shuffle."""
    short_batches(docs.sparkSession)
    return docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        token_count(F.col("text"), path).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
