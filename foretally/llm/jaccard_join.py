"""N-gram Jaccard join with Bayesian candidate pruning.

Two documents are linked if their sets of five-word shingles have a Jaccard similarity of
0.8 or more.

1. One pass gives each row its shingle count, a 128-bit sum over its set, MinHash values
   and band keys.  Rows with equal sets form a class with one representative; only
   representatives are compared, so exact copies never become pairs.
2. Representatives that share a band key are candidates.  A key's smallest representative
   is its centre, and all rows of one centre form a group; two candidates always meet in
   the group of the centre of a key they share.  Groups beyond a block's size are cut into
   blocks that meet pair by pair, so no group is one task, and no pair is ever emitted.
3. Inside a pair of blocks MinHash values are compared 16 at a time; a pair whose posterior
   probability (uniform prior) of reaching the threshold falls below ``TOLERANCE`` is
   dropped (Satuluri and Parthasarathy, 2012), the rest is verified on the exact sets.  A
   pair that shares several centres counts at the smallest.
4. Each task returns a row's number of links and the root of its local component; links
   add up, and components are joined by repeated contraction.

A pair at exactly the threshold is lost with a probability below 1e-5 (24 bands of 4 values:
3e-6; pruning: 6e-6), more similar pairs with far less.  The work inside a group of m
different texts is quadratic in m, the rows sent are m times the number of its blocks.

Null texts and texts without words have no shingles: no links, a class of their own.
Repeated rows are copies of each other.  A class is named by its smallest doc_id (null
only if all are null).  An empty table gives no rows.
"""

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretally.llm.common import chunks, column, drop_worker_state, map_groups, short_batches
from foretally.llm.shingles import mix, shingle_sets
from foretally.session import durable

THRESHOLD = 0.8
BANDS, ROWS = 24, 4
STEP = 16  # MinHash values compared at a time
TOLERANCE = 1e-6
BLOCK_ROWS, BLOCK_SHINGLES = 512, 400_000

HASHES = BANDS * ROWS
FACTORS = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
OFFSETS = mix(np.arange(1001, HASHES + 1001, dtype=np.uint64))

SKETCH = "rid long, n int, f1 long, f2 long, signature binary, bands array<long>"


# -- sketches --------------------------------------------------------------------------

def sketches(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(sum, mixed sum, MinHash values, band keys) of each non-empty set."""
    heads = np.cumsum(sizes) - sizes
    values = np.empty((sizes.size, HASHES), np.uint32)
    for k in range(HASHES):
        values[:, k] = np.minimum.reduceat((hashes * FACTORS[k] + OFFSETS[k]) >> np.uint64(32), heads)
    wide = values.astype(np.uint64).reshape(-1, BANDS, ROWS)
    keys = np.zeros((sizes.size, BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + wide[:, :, r])
    return np.add.reduceat(hashes, heads), np.add.reduceat(mix(hashes ^ OFFSETS[0]), heads), values, keys


def sketch(rows: DataFrame) -> DataFrame:
    """``rows`` (rid, text) -> sketches of all rows that have shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_state()
        for batch in batches:
            at = 0
            for texts in chunks(batch.column("text").to_pylist()):
                rid = batch.column("rid").slice(at, len(texts)).to_numpy()
                at += len(texts)
                hashes, sizes = shingle_sets(texts)
                some = sizes > 0
                if not some.any():
                    continue
                f1, f2, values, keys = sketches(hashes, sizes[some])
                bands = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), keys.view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid[some]), pa.array(sizes[some].astype(np.int32)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)),
                     pa.array([v.tobytes() for v in values], pa.binary()), bands], names=["rid", "n", "f1", "f2", "signature", "bands"])

    return rows.mapInArrow(run, SKETCH)


def shingled(rows: DataFrame) -> DataFrame:
    """``rows`` (rid, signature, text) -> the exact sets: (rid, signature, shingles)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_state()
        for batch in batches:
            at = 0
            for texts in chunks(batch.column("text").to_pylist()):
                hashes, sizes = shingle_sets(texts)
                parts = [p.tobytes() for p in np.split(hashes, np.cumsum(sizes)[:-1])]
                yield pa.RecordBatch.from_arrays([batch.column("rid").slice(at, len(texts)), batch.column("signature").slice(at, len(texts)),
                                                  pa.array(parts, pa.binary())], names=["rid", "signature", "shingles"])
                at += len(texts)

    return rows.mapInArrow(run, "rid long, signature binary, shingles binary")


# -- pruning and verification ----------------------------------------------------------

def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """Compared values -> fewest matches that keep a pair.  With a uniform prior the posterior
    of similarity after k matches of m is Beta(k + 1, m - k + 1), so the probability of
    reaching t is that of at most k successes in m + 1 trials of chance t."""
    out = {}
    for m in range(STEP, HASHES + 1, STEP):
        chance, k = 0.0, -1
        while chance < tolerance:
            k += 1
            chance += comb(m + 1, k) * threshold**k * (1 - threshold) ** (m + 1 - k)
        out[m] = k
    return out


LEAST = least_matches()


def surviving(a: np.ndarray, b: np.ndarray, signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a[i], b[i]) that no round of MinHash values rules out."""
    matches = np.zeros(a.size, np.int32)
    for m in range(STEP, HASHES + 1, STEP):
        matches += (signatures[a, m - STEP:m] == signatures[b, m - STEP:m]).sum(axis=1, dtype=np.int32)
        keep = matches >= LEAST[m]
        a, b, matches = a[keep], b[keep], matches[keep]
    return a, b


def intersections(a: np.ndarray, b: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """|A and B| of each pair: one by one if they are few, else as products of 0/1 matrices
    over the shingles that at least two of the sets hold."""
    rows = np.unique(np.concatenate([a, b]))
    if a.size <= 4 * rows.size:
        return np.array([np.intersect1d(sets[i], sets[j], assume_unique=True).size for i, j in zip(a, b)], np.int64)
    values = np.concatenate([sets[i] for i in rows])
    holder = np.repeat(np.arange(rows.size), [sets[i].size for i in rows])
    _, where, times = np.unique(values, return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    shared = times[where] > 1
    where, holder = number[where[shared]], holder[shared]
    order = np.argsort(where, kind="stable")
    where, holder = where[order], holder[order]
    common = np.zeros((rows.size, rows.size), np.float32)
    width = 4096
    for lo in range(0, int(where[-1]) + 1 if where.size else 0, width):
        span = slice(*np.searchsorted(where, [lo, lo + width]))
        held = np.zeros((rows.size, width), np.float32)
        held[holder[span], where[span] - lo] = 1
        common += held @ held.T
    return common[np.searchsorted(rows, a), np.searchsorted(rows, b)].astype(np.int64)


def linked_pairs(a: np.ndarray, b: np.ndarray, signatures: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    a, b = surviving(a, b, signatures)
    if not a.size:
        return a, b
    sizes = np.array([s.size for s in sets], np.int64)
    both = intersections(a, b, sets)
    links = both >= THRESHOLD * (sizes[a] + sizes[b] - both) - 1e-9
    return a[links], b[links]


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each of ``n`` nodes' components."""
    up = np.arange(n)
    while True:
        low = np.minimum(up[a], up[b])
        new = up.copy()
        np.minimum.at(new, up[a], low)
        np.minimum.at(new, up[b], low)
        new = new[new]
        if (new == up).all():
            return up
        up = new


def compare_blocks(group: pd.DataFrame) -> pd.DataFrame:
    """All pairs of one pair of blocks: (rid, links, root) of each row with a link."""
    group = group.sort_values("rid", ignore_index=True)
    centre, first, second = (group[c].iloc[0] for c in ("centre", "first", "second"))
    block = group["block"].to_numpy()
    a, b = np.triu_indices(len(group), 1)
    if first != second:
        apart = block[a] != block[b]
        a, b = a[apart], b[apart]
    earlier: dict[int, list[int]] = {}
    for i, centres in enumerate(group["centres"]):
        for c in centres:
            if c < centre:
                earlier.setdefault(c, []).append(i)
    met = np.zeros((len(group),) * 2, bool)  # pairs that meet at a smaller centre
    for rows in earlier.values():
        if len(rows) > 1:
            met[np.ix_(rows, rows)] = True
    fresh = ~met[a, b]
    a, b = a[fresh], b[fresh]
    signatures = np.stack([np.frombuffer(s, np.uint32) for s in group["signature"]])
    sets = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
    a, b = linked_pairs(a, b, signatures, sets)
    copies = group["copies"].to_numpy(np.int64)
    links = np.bincount(a, weights=copies[b], minlength=len(group)) + np.bincount(b, weights=copies[a], minlength=len(group))
    rid = group["rid"].to_numpy()
    out = pd.DataFrame({"rid": rid, "links": links.astype(np.int64), "root": rid[roots(len(group), a, b)]})
    return out[out["links"] > 0]


def compare_many(frame: pd.DataFrame) -> pd.DataFrame:
    parts = [compare_blocks(g) for _, g in frame.groupby(["centre", "first", "second"], sort=False)]
    return pd.concat(parts, ignore_index=True)


# -- components ------------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(a, label) for every node of the undirected ``edges`` (a, b): its component's smallest
    node.  Every round points each node to its smallest neighbour, follows the pointers to
    their ends by doubling, and contracts the edges; at least half of the nodes go."""
    both = edges.filter("a <> b")
    both = durable(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    names = None
    while not both.isEmpty():
        up = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = True
        while moved:
            up = durable(up)
            ends = up.select(F.col("a").alias("m"), F.col("m").alias("end"))
            followed = durable(up.join(ends, "m").select("a", F.col("end").alias("m"), (F.col("end") != F.col("m")).alias("moved")))
            moved = not followed.filter("moved").isEmpty()
            up = followed.select("a", "m")
        if names is None:
            names = up.select("a", F.col("m").alias("label"))
        else:
            later = up.select(F.col("a").alias("label"), F.col("m").alias("end"))
            names = durable(names.join(later, "label", "left").select("a", F.coalesce("end", "label").alias("label")))
        to = up.select(F.col("a").alias("b"), F.col("m").alias("n"))
        both = durable(both.join(up, "a").join(to, "b").select(F.col("m").alias("a"), F.col("n").alias("b")).filter("a <> b").distinct())
    return names if names is not None else both.select("a", F.col("b").alias("label"))


# -- the join --------------------------------------------------------------------------

def links_of(rows: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (rid, text), ``reps`` (rid, n, copies, signature, bands) -> stored (rid, links,
    root) per pair of blocks, and (a, label) of the linked representatives."""
    keyed = reps.select("rid", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("rid").alias("centre"), F.count("*").alias("rows")).filter("rows > 1").select("key", "centre")
    met = durable(keyed.join(shared, "key").select("rid", "centre").distinct())
    # what each representative belongs to; at most one centre for each of its bands
    centres = met.groupBy("rid").agg(F.array_sort(F.collect_list("centre")).alias("centres"))
    inside = durable(reps.select("rid", "n", "copies", "signature").join(centres, "rid"))
    exact = durable(shingled(inside.select("rid", "signature").join(rows, "rid").select("rid", "signature", "text")))
    size = met.join(inside.select("rid", "n"), "rid").groupBy("centre").agg(F.count("*").alias("m"), F.sum("n").alias("all"))
    blocks = size.select("centre", F.ceil(F.greatest(F.col("m") / BLOCK_ROWS, F.col("all") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = (met.join(blocks, "centre").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("rid", "centre", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second")))
    full = placed.join(inside.select("rid", "copies", "centres"), "rid").join(exact, "rid")
    found = durable(map_groups(full, ["centre", "first", "second"], [], compare_many, "rid long, links long, root long"))
    return found, components(found.select(F.col("rid").alias("a"), F.col("root").alias("b")))


def jaccard_join(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Every row with its class: ``row`` (the carried columns), ``class_id``, ``n_links``
    (linked other rows, copies included), ``keeper`` (true for one row of each class)."""
    short_batches(docs.sparkSession)
    carry = carry or docs.columns
    apart = [] if "text" in carry else [column(docs, "text").alias("text")]
    stored = durable(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*[column(docs, c) for c in carry]).alias("row"),
                                 column(docs, "doc_id").alias("doc_id"), *apart))
    rows = stored.select("rid", F.col("row.text").alias("text") if "text" in carry else "text")
    marks = durable(sketch(rows))
    same = ["f1", "f2", "n"]
    named = stored.select("rid", "doc_id").join(marks.select("rid", *same), "rid")
    classes = durable(named.groupBy(*same).agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rid")).alias("first"), F.min("doc_id").alias("least"), F.count("*").alias("copies"))
                      .select(*same, F.col("first.rid").alias("rep"), "first", "least", "copies"))
    reps = marks.join(classes.select(F.col("rep").alias("rid"), "copies"), "rid")
    found, labels = links_of(rows, reps)
    links = found.groupBy(F.col("rid").alias("rep")).agg(F.sum("links").alias("links"))
    known = (classes.join(links, "rep", "left").join(labels.select(F.col("a").alias("rep"), "label"), "rep", "left")
             .withColumn("label", F.coalesce("label", "rep")))
    known = durable(known.select(*same, "label", "first", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    heads = known.groupBy("label").agg(F.min("first").alias("head"), F.min("least").alias("class_id"))
    per_class = known.join(heads, "label").select(*same, "class_id", F.col("head.rid").alias("head"), "n_links")
    per_row = marks.select("rid", *same).join(per_class, same).select("rid", "class_id", "head", "n_links")
    out = stored.join(per_row, "rid", "left")
    alone = F.col("head").isNull()
    return out.select("row", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (alone | (F.col("head") == F.col("rid"))).alias("keeper"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with one row of each class (the one of smallest doc_id)."""
    return jaccard_join(docs).filter("keeper").select("row.*")
