"""Best-fit packing after Martello-Toth dominance reduction.

Documents become ids with an end id behind each; only those longer than a sequence are cut,
into pieces of full length with a shorter last one.  How pieces are packed depends on their
lengths alone, so the instance is a histogram of at most ``capacity`` counts, whatever the
number of documents: this bounded table is all the driver sees.  On it

* sets of up to three lengths that provably dominate every other set holding the same
  longest piece are fixed for good, as many copies at once as the counts allow,
* the instance shrinks and the test is repeated until nothing more can be fixed,
* the remainder goes by best fit, longest first, equal bins handled together.

The plan is a list of runs: pieces ``first`` to ``last`` of one length go to consecutive
sequences from a given one on.  There are a few runs per length.  Tasks then number the
pieces of each length (a length held by any share of the rows is numbered by many tasks)
and look their place up.

Null and empty texts are one piece with the end id; repeated rows are pieces of their own;
an empty table packs into no sequences.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretally.llm.common import chunks, numbered, short_batches, stamped
from foretally.llm.encoding import encoded

CAPACITY = 2048
END_ID = 0
RANKS = np.int64(1) << 44  # above the number of pieces of one length

PIECES = "doc_id {}, piece int, start long, length long, ids_crc32 long, ids binary"


def cut_pieces(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document with their ids (binary, little-endian unsigned 16-bit,
    or 32-bit for a vocabulary above 65,536)."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        wide = Tokenizer.from_file(vocabulary_path).get_vocab_size() > 1 << 16
        waiting: list = []

        def texts():
            for batch in batches:
                at = 0
                for run in chunks(batch.column("text").to_pylist()):
                    waiting.append(batch.column("doc_id").slice(at, len(run)))
                    at += len(run)
                    yield run

        held: dict[str, list] = {k: [] for k in ("row", "piece", "start", "length", "crc", "ids")}
        row = 0
        for ids in encoded(vocabulary_path, texts()):
            whole = np.append(np.frombuffer(ids, "<u4"), np.uint32(END_ID)).astype("<u4")
            for piece, start in enumerate(range(0, whole.size, capacity)):
                part = whole[start:start + capacity]
                stored = part if wide else part.astype("<u2")
                for k, v in zip(held, (row, piece, start, part.size, zlib.crc32(part.tobytes()), stored.tobytes())):
                    held[k].append(v)
            row += 1
            if row == len(waiting[0]):  # one run of documents is done
                doc_id = waiting.pop(0).take(pa.array(held["row"], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [doc_id, pa.array(held["piece"], pa.int32()), pa.array(held["start"], pa.int64()),
                     pa.array(held["length"], pa.int64()), pa.array(held["crc"], pa.int64()), pa.array(held["ids"], pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
                held, row = {k: [] for k in held}, 0

    short_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(cut, PIECES.format(kind))


class Plan:
    """Runs of pieces placed so far: (length, first, bin, pieces a bin, offset in the bin)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, count in counts.items():
            if not 1 <= length <= capacity:
                raise ValueError(f"a piece of length {length} cannot be packed into {capacity}")
            self.left[length] = count
        self.taken = np.zeros(capacity + 1, np.int64)
        self.bins = 0
        self.runs: list[tuple[int, int, int, int, int]] = []

    def put(self, length: int, first_bin: int, bins: int, each: int, offset: int) -> None:
        self.runs.append((length, int(self.taken[length]), first_bin, each, offset))
        self.taken[length] += bins * each
        self.left[length] -= bins * each

    def fix(self, lengths: list[int]) -> None:
        """Fill as many new bins with this set as the counts allow."""
        times = {x: lengths.count(x) for x in lengths}
        bins = min(int(self.left[x]) // k for x, k in times.items())
        offset = 0
        for x, k in times.items():
            self.put(x, self.bins, bins, k, offset)
            offset += x * k
        self.bins += bins

    # -- dominance ---------------------------------------------------------------------

    def dominating(self, longest: int) -> list[int] | None:
        """A feasible set with the piece ``longest`` that dominates all others, if one is
        known: every other set's companions fit, part by part, in the places of its own."""
        room = self.capacity - longest
        others = self.left.copy()
        others[longest] -= 1
        fitting = np.flatnonzero(others[:room + 1])
        if not fitting.size:
            return [longest]
        a = int(fitting[-1])
        if a == room:  # fills the bin: whatever else goes with it fits in a's place
            return [longest, a]
        smallest = np.repeat(fitting[:3], np.minimum(others[fitting[:3]], 3))[:3]
        most = int((np.cumsum(smallest) <= room).sum())
        if most == 1:
            return [longest, a]
        if most == 2:
            if self.best_pair(others, fitting, room) <= a:
                return [longest, a]
            others[a] -= 1
            second = np.flatnonzero(others[:room - a + 1])
            if second.size:
                b = int(second[-1])
                others[a] += 1
                above = fitting[fitting > b][:2]
                two = np.repeat(above, np.minimum(others[above], 2))[:2]
                if two.size < 2 or int(two.sum()) > room:  # no two companions are both longer than b
                    return [longest, a, b]
        return None

    @staticmethod
    def best_pair(others: np.ndarray, fitting: np.ndarray, room: int) -> int:
        """Largest sum up to ``room`` of two companions, 0 if none."""
        mate = fitting[np.maximum(np.searchsorted(fitting, room - fitting, side="right") - 1, 0)]
        lone = (mate == fitting) & (others[fitting] < 2)
        lower = fitting[np.maximum(np.searchsorted(fitting, mate, side="left") - 1, 0)]
        mate = np.where(lone, np.where(lower < fitting, lower, room + 1), mate)
        sums = fitting + mate
        return int(sums[sums <= room].max(initial=0))

    def reduce(self) -> int:
        """Fix dominating sets until none is left; returns the number of bins fixed."""
        before = -1
        while before != self.bins:
            before = self.bins
            for longest in range(self.capacity, 0, -1):
                while self.left[longest] > 0:
                    found = self.dominating(longest)
                    if found is None:
                        break
                    self.fix(found)
        return self.bins

    # -- best fit ----------------------------------------------------------------------

    def best_fit(self) -> None:
        """Longest first, each piece into the fullest bin that takes it.  Bins with equal room
        form intervals; a piece that fits again in the bin it made fuller goes there, since no
        other bin with enough room is fuller."""
        open_bins: dict[int, list[tuple[int, int]]] = {}  # room -> intervals (first bin, bins)

        def leave(room: int, first: int, bins: int) -> None:
            if room and bins:
                open_bins.setdefault(room, []).append((first, bins))

        def fill(length: int, room: int, first: int, bins: int) -> None:
            """Use an interval of equal bins for the pieces that are left of this length."""
            each = room // length
            whole = min(bins, int(self.left[length]) // each)
            if whole:
                self.put(length, first, whole, each, self.capacity - room)
                leave(room - each * length, first, whole)
            rest = min(int(self.left[length]), each)
            if whole < bins and 0 < rest < each:  # the last, partly used bin
                self.put(length, first + whole, 1, rest, self.capacity - room)
                leave(room - rest * length, first + whole, 1)
                whole += 1
            leave(room, first + whole, bins - whole)

        for length in range(self.capacity, 0, -1):
            while self.left[length] > 0:
                room = min((r for r in open_bins if r >= length), default=None)
                if room is None:
                    bins = -(-int(self.left[length]) // (self.capacity // length))
                    self.bins += bins
                    fill(length, self.capacity, self.bins - bins, bins)
                    continue
                first, bins = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                fill(length, room, first, bins)

    def arrays(self) -> tuple[np.ndarray, ...]:
        runs = np.array(self.runs, np.int64).reshape(-1, 5)
        runs = runs[np.argsort(runs[:, 0] * RANKS + runs[:, 1], kind="stable")]
        return runs[:, 0] * RANKS + runs[:, 1], *runs[:, 1:].T


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    plan = Plan(counts, capacity)
    plan.reduce()
    plan.best_fit()
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with a ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``."""
    stored = stamped(pieces)
    # at most one row per length: bounded by the capacity
    counts = {r["length"]: r["count"] for r in stored.groupBy("length").count().collect()}
    keys, first, first_bin, each, offset = plan_packing(counts, capacity).arrays()

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(), rank.to_numpy()
        run = np.searchsorted(keys, length * RANKS + rank, side="right") - 1
        steps, inside = np.divmod(rank - first[run], each[run])
        return pd.DataFrame({"sequence_id": first_bin[run] + steps, "offset": offset[run] + inside * length})

    ranked = numbered(stored, ["length"], ["_seq"], "_rank")
    kept = [c for c in pieces.columns]
    placed = ranked.withColumn("_place", place("length", "_rank"))
    return placed.select(*kept, F.col("_place.sequence_id").alias("sequence_id"), F.col("_place.offset").alias("offset"))


def pack_documents(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack whole documents: one row per piece with its ids and place."""
    return pack(cut_pieces(docs, vocabulary_path, capacity), capacity)
