"""Masked pseudo-likelihood: every word predicted from both sides by a small numpy network.

A word is predicted in two steps: its class (its token: its hash in 4,096 values, predicted
by the network as two halves of 64), then the word within its class.  The second step rests
on a count of all words of all documents, so the vocabulary grows with the corpus: a word
seen ``RARE`` times or more has its share of its class.  Rarer and unknown words share
what is left and are spelt byte by byte.  The probabilities of all words of a class add up
to at most 1; a spelt word pays for its spelling among the strings of all classes.  What
stays fixed are the 4,096 classes, which are also all that the network sees of the words
around.

The ``HEAD`` most frequent words are looked up inside the tasks, all others by a join on
the word, so no task and not the driver holds the vocabulary.

The network adds
an embedding for each of the two words before and after (one table per place), takes tanh,
and predicts the upper half of the token; with the upper half known it predicts the lower
half.  A document's score is the sum of its words' conditional log probabilities.

Training covers every document once.  The corpus is dealt into ``ROUNDS`` slices by hash;
in a round each task starts from the current weights, takes Adagrad steps over its share of
the slice and returns its change with, for every weight row, how often it was used.  Spark
adds these up in a tree (groups of 64, weight rows in chunks), and their averages, weighted
by use, move the weights; so what is gathered grows with the tasks, and what reaches the
driver is the fixed 2 MB of weights.  They are stored after every round.

Null and empty texts and texts without words have no tokens: score 0, no mean.  Repeated
rows score alike.  With an empty table nothing is trained and no row comes back.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretally.llm.common import chunks, map_groups, short_batches
from foretally.llm.shingles import hashes_of, word_bytes, word_hashes
from foretally.session import durable

HALF = 64  # values of each half of a token
TOKENS = HALF * HALF
PLACES = (-2, -1, 1, 2)
WIDTH = 32
ROUNDS = 4
BATCH = 1024
GROUP = 64  # batches laid out at once
RATE = 0.15
FAN = 64  # task results added up at once
CHUNK = 512  # weight rows in a piece
RARE = 3  # words seen fewer times are spelt
HEAD = 1 << 16  # so many of the most frequent words are looked up inside the tasks
COUNTED = 1 << 18  # different words a counting task holds before it passes them on
SMOOTH = 0.1
BLOCK = 2048  # words scored at once
STEEP = 60.0  # exponentials of numbers within this bound neither overflow nor vanish
TAME = 20.0  # nor do those of two such numbers' doubled sum

EDGE = TOKENS  # stands for a word beyond the text's ends
TABLE = TOKENS + 1

# weight rows of 32 numbers, one matrix for all layers
N_PLACE = len(PLACES) * TABLE
FIRST = np.cumsum([0, N_PLACE, HALF, HALF, HALF, 1, HALF // WIDTH, HALF * HALF // WIDTH])
ROWS = int(FIRST[-1])


def split(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower half of each token."""
    upper = token // HALF
    return upper, token - upper * HALF


def within(values: np.ndarray, bound: float) -> bool:
    return bool(values.max(initial=0) < bound and values.min(initial=0) > -bound)


class Network:
    def __init__(self, weights: np.ndarray):
        self.rows = weights
        part = [weights[a:b] for a, b in zip(FIRST, FIRST[1:])]
        self.places, self.given, self.upper, self.lower, self.bias, upper_bias, lower_bias = part
        self.upper_bias, self.lower_bias = upper_bias.reshape(HALF), lower_bias.reshape(HALF, HALF)

    def hidden(self, context: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        before = self.places.take(context[:, 0], axis=0)
        for k in range(1, len(PLACES)):
            before += self.places.take(context[:, k], axis=0)
        before += self.bias
        if not (within(before, TAME) and within(self.given, TAME)):
            two = self.given.take(upper, axis=0)
            two += before
            return np.tanh(before, out=before), np.tanh(two, out=two)
        one = np.exp(np.add(before, before, out=before), out=before)  # tanh x = 1 - 2 / (1 + exp 2x), one exponential for both
        two = np.exp(2 * self.given).take(upper, axis=0)
        two *= one
        for e in (one, two):
            e += 1
            np.divide(-2, e, out=e)
            e += 1
        return one, two

    def logits(self, one: np.ndarray, two: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unnormalised log probabilities of both halves; steep ones are shifted so that none is above 0."""
        a, b = one @ self.upper.T, two @ self.lower.T
        a += self.upper_bias
        b += self.lower_bias.take(upper, axis=0)
        for z, layer, bias in ((a, self.upper, self.upper_bias), (b, self.lower, self.lower_bias)):
            longest = np.einsum("ij,ij->i", layer, layer).max()  # hidden units lie between -1 and 1
            if not (np.sqrt(WIDTH * longest) + max(bias.max(), -bias.min()) < STEEP or within(z, STEEP)):
                z -= z.max(axis=1, keepdims=True)
        return a, b

    def log_probability(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        halves = split(token)
        at = np.arange(token.size) * HALF
        total = np.zeros(token.size)
        for z, half in zip(self.logits(*self.hidden(context, halves[0]), halves[0]), halves):
            total += z.ravel().take(at + half)
            total -= np.log(np.exp(z, out=z) @ np.ones(HALF, z.dtype))
        return total


def initial_weights() -> np.ndarray:
    weights = np.random.default_rng(17).normal(0, 0.1, (ROWS, WIDTH)).astype(np.float32)
    weights[FIRST[4]:] = 0  # biases
    return weights


def runs(values: np.ndarray, most: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(first place, length) of each run of equal values; none reaches over a multiple of ``most``."""
    first = np.ones(values.size, bool)
    np.not_equal(values[1:], values[:-1], out=first[1:])
    if most:
        first[::most] = True
    heads = np.flatnonzero(first)
    times = np.full(heads.size, values.size)
    times[:-1] = heads[1:]
    times -= heads
    return heads, times


class Plan(NamedTuple):
    """A batch of words, those of one upper half side by side, and where their gradients go."""

    context: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    heads: np.ndarray  # first word of each upper half that occurs
    halves: np.ndarray  # how many words it has
    rows: np.ndarray  # distinct rows of the place tables
    times: np.ndarray  # how often each occurs
    first: np.ndarray  # a word that each occurs at
    again: list[tuple[np.ndarray, np.ndarray]]  # rows that occur up to 2, 4, 8 ... times, their words filled up with ``BATCH``


def plans(context: np.ndarray, token: np.ndarray, order: np.ndarray) -> Iterator[Plan]:
    """Batches of words in the given order, laid out ``GROUP`` at a time."""
    for at in range(0, order.size, GROUP * BATCH):
        some = order[at:at + GROUP * BATCH]
        cuts = np.arange(0, some.size + BATCH, BATCH).clip(max=some.size)
        batch = np.arange(some.size) // BATCH
        # short numbers sort by digits
        some = some.take(np.argsort((batch * HALF + token.take(some) // HALF).astype(np.uint16), kind="stable"))
        near, (upper, lower) = context.take(some, axis=0), split(token.take(some))
        heads, halves = runs(batch * HALF + upper)
        of_half = np.searchsorted(heads, cuts)
        k = len(PLACES)
        rows = np.full((cuts.size - 1, BATCH * k), np.iinfo(np.uint16).max, np.uint16)  # more than ROWS: what the last batch lacks comes last
        rows.ravel()[:near.size] = near.ravel()
        by = np.argsort(rows, axis=1, kind="stable")
        word = (by // k).ravel()[:near.size]
        by += np.arange(0, rows.size, BATCH * k)[:, None]
        rows = rows.ravel().take(by.ravel()[:near.size])
        starts, times = runs(rows, BATCH * k)
        of_row = np.searchsorted(starts, cuts * k)
        filled, groups, size = np.append(word, BATCH), [], 2
        more = np.flatnonzero(times > 1)
        begin, length = starts.take(more), times.take(more)
        while size < 2 * length.max(initial=0):
            chosen, place = np.flatnonzero((length > size // 2) & (length <= size)), np.arange(size)[:, None]
            words = filled.take(np.where(place < length.take(chosen), begin.take(chosen) + place, word.size))
            often = more.take(chosen)
            groups.append((often, words, np.searchsorted(often, of_row)))
            size *= 2
        rows, first = rows.take(starts).astype(np.int64), word.take(starts)
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a < b:
                h, r = slice(*of_half[i:i + 2]), slice(*of_row[i:i + 2])
                again = [(often[c:d] - r.start, words[:, c:d]) for often, words, cut in groups for c, d in [cut[i:i + 2]] if c < d]
                yield Plan(near[a:b], upper[a:b], lower[a:b], heads[h] - a, halves[h], rows[r], times[r], first[r], again)


class Trainer:
    """Adagrad on one task's documents; counts how often each weight row is used."""

    def __init__(self, weights: np.ndarray):
        self.start = weights
        self.net = Network(weights.copy())
        self.squares = np.full(ROWS, 1e-2, np.float32)
        self.used = np.zeros(ROWS, np.float32)

    def move(self, rows: np.ndarray, gradient: np.ndarray, times) -> None:
        squares = np.einsum("ij,ij->i", gradient, gradient)
        squares /= WIDTH
        squares += self.squares.take(rows)
        self.squares[rows] = squares
        gradient *= (RATE / np.sqrt(squares))[:, None]
        np.subtract(self.net.rows.take(rows, axis=0), gradient, out=gradient)
        whole = f"V{gradient.itemsize * WIDTH}"  # a weight row as one item
        np.put(self.net.rows.view(whole), rows, gradient.view(whole))
        self.used[rows] += times

    def step(self, context: np.ndarray, token: np.ndarray) -> None:
        for plan in plans(context, token, np.arange(token.size)):
            self.follow(plan)

    def follow(self, plan: Plan) -> None:
        net, upper, n = self.net, plan.upper, plan.upper.size
        at = np.arange(n) * HALF
        one, two = net.hidden(plan.context, upper)
        ga, gb = net.logits(one, two, upper)
        for g, half in ((ga, upper), (gb, plan.lower)):  # gradient: probabilities less the seen token
            np.exp(g, out=g)
            g *= (1 / (g @ np.full(HALF, n, g.dtype)))[:, None]
            g.ravel()[at + half] -= 1 / n
        padded = np.zeros((BATCH + 1, WIDTH), ga.dtype)
        back, back_two = np.matmul(ga, net.upper, out=padded[:n]), gb @ net.lower
        for b, h in ((back, one), (back_two, two)):
            slope = h * h
            b *= np.subtract(1, slope, out=slope)
        back += back_two
        values = padded.take(plan.first, axis=0)
        for rows, words in plan.again:
            values[rows] = padded.take(words, axis=0).sum(axis=0)
        given, each = upper.take(plan.heads), np.ones(n, ga.dtype)
        biases = FIRST[6] + given[:, None] * (HALF // WIDTH) + np.arange(HALF // WIDTH)
        self.move(plan.rows, values, plan.times)
        self.move(np.concatenate([FIRST[1] + given, np.arange(FIRST[2], FIRST[6]), biases.ravel()]),
                  np.concatenate([np.add.reduceat(back_two, plan.heads, axis=0), (one.T @ ga).T, (two.T @ gb).T, (each @ back)[None],
                                  (each @ ga).reshape(-1, WIDTH), np.add.reduceat(gb, plan.heads, axis=0).reshape(-1, WIDTH)]),
                  np.concatenate([plan.halves, np.full(FIRST[6] - FIRST[2], n), np.repeat(plan.halves, HALF // WIDTH)]))


def examples(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context rows in the place tables, token, number of the text) of every word."""
    return placed(*word_hashes(texts))


def placed(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    token = (hashes % np.uint64(TOKENS)).astype(np.int64)
    context = np.full((token.size, len(PLACES)), EDGE, np.int64)
    for i, place in enumerate(PLACES):
        k = abs(place)
        if token.size > k:
            here, there = (slice(k, None), slice(None, -k)) if place < 0 else (slice(None, -k), slice(k, None))
            context[here, i] = np.where(owner[here] == owner[there], token[there], EDGE)
    return context + np.arange(len(PLACES)) * TABLE, token, owner


def train_round(docs: DataFrame, weights: np.ndarray) -> np.ndarray:
    """One pass over ``docs`` from ``weights``; the averaged weights."""
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        trainer, seen = Trainer(weights), 0
        for batch in batches:
            for texts in chunks(batch.column("text").to_pylist()):
                context, token, _ = examples(texts)
                order = np.random.default_rng(seen).permutation(token.size)  # words of a batch come from many texts
                seen += token.size
                for plan in plans(context, token, order):
                    trainer.follow(plan)
        if seen:
            change = (trainer.net.rows - weights) * trainer.used[:, None]
            spans = range(0, ROWS, CHUNK)
            yield pa.RecordBatch.from_pydict({
                "chunk": np.arange(len(spans), dtype=np.int64), "task": np.full(len(spans), TaskContext.get().partitionId(), np.int64),
                "used": [trainer.used[a:a + CHUNK].tobytes() for a in spans], "change": [change[a:a + CHUNK].tobytes() for a in spans]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for (chunk, task), part in frame.groupby(["chunk", "task"], sort=False):
            sums = [np.sum([np.frombuffer(x, np.float32) for x in part[c]], axis=0, dtype=np.float64).astype(np.float32).tobytes() for c in ("used", "change")]
            rows.append((chunk, task, *sums))
        return pd.DataFrame(rows, columns=["chunk", "task", "used", "change"])

    kind = "chunk long, task long, used binary, change binary"
    moved = durable(docs.mapInArrow(train, kind))
    tasks = moved.agg(F.max("task")).first()[0]
    while tasks:
        grouped = moved.withColumn("from", F.col("task")).withColumn("task", F.floor(F.col("task") / FAN))
        moved = durable(map_groups(grouped, ["chunk", "task"], ["from"], add, kind))
        tasks //= FAN
    out = weights.copy()
    for row in moved.collect():  # the weights' own size
        used, change = (np.frombuffer(row[c], np.float32) for c in ("used", "change"))
        a = row["chunk"] * CHUNK
        out[a:a + used.size] += change.reshape(-1, WIDTH) / np.maximum(used, 1)[:, None]
    return out


def train(docs: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after every document was seen once."""
    weights = initial_weights()
    dealt = docs.select("text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)).alias("slice"))
    for k in range(rounds):
        weights = train_round(dealt.filter(F.col("slice") == k).select("text"), weights)
    return weights


# -- words within their classes ----------------------------------------------------------

class Head(NamedTuple):
    """What a task needs of the vocabulary, bounded by ``HEAD``, the classes and the bytes."""

    hashes: np.ndarray  # sorted
    logs: np.ndarray  # log counts
    total: np.ndarray  # log (1 + occurrences) of each class
    rare: np.ndarray  # log (1 + occurrences of rare words) of each class
    spelling: np.ndarray  # log probability of a byte after a byte, 0 at both ends


def pairs(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte pair (before x 256 + byte) at every byte, and the pair that ends each word."""
    before = np.r_[np.zeros(min(data.size, 1), np.int64), data[:-1].astype(np.int64)]
    before[first] = 0
    return before * 256 + data, data[last].astype(np.int64) * 256


def spelt(data: np.ndarray, first: np.ndarray, some: np.ndarray, spelling: np.ndarray) -> np.ndarray:
    """Log probability of the spelling of ``some`` of the words of ``word_bytes``."""
    if not some.size:
        return np.zeros(0)
    sizes = np.append(first[1:], data.size).take(some) - first.take(some)
    ends = np.cumsum(sizes)
    heads = ends - sizes
    within, end = pairs(data.take(np.arange(ends[-1]) + np.repeat(first.take(some) - heads, sizes)), heads, ends - 1)
    return np.add.reduceat(spelling.take(within), heads) + spelling.take(end)


def word_counts(docs: DataFrame) -> DataFrame:
    """(hash, word, c): how often each word occurs in all documents."""
    def counted(texts: list[str]) -> pa.Table:
        data, first, _ = word_bytes(texts)
        coded = pa.array(hashes_of(data, first).view(np.int64)).dictionary_encode()
        number, different = coded.indices.to_numpy(), len(coded.dictionary)
        at = np.empty(different, np.int64)
        at[number[::-1]] = np.arange(number.size)[::-1]  # where each word is first met
        places = pa.py_buffer(np.append(first, data.size).astype(np.int32))
        words = pa.Array.from_buffers(pa.binary(), first.size, [None, places, pa.py_buffer(data)])
        return pa.table({"hash": coded.dictionary, "word": words.take(pa.array(at)), "c": np.bincount(number, minlength=different)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for texts in chunks(batch.column("text").to_pylist()):
                held.append(counted(texts))
                rows += len(held[-1])
                if rows > 2 * COUNTED:
                    held = [merged(held)]
                    rows = len(held[0])
                    if rows > COUNTED:
                        yield from held.pop().to_batches()
                        rows = 0
        if held:
            yield from merged(held).to_batches()

    def merged(held: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(held).group_by("hash", use_threads=False).aggregate([("word", "first"), ("c", "sum")])
        return pa.table({"hash": sums["hash"], "word": sums["word_first"], "c": sums["c_sum"]})

    counts = docs.select("text").mapInArrow(count, "hash long, word binary, c long")
    return counts.groupBy("hash").agg(F.min("word").alias("word"), F.sum("c").alias("c"))


def spelling_of(known: DataFrame) -> np.ndarray:
    """Byte after byte in the different words, each word once."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << 16, np.int64)
        for batch in batches:
            words = [w for w in batch.column("word").to_pylist() if w]
            sizes = np.array([len(w) for w in words], np.int64)
            last = np.cumsum(sizes) - 1
            for codes in pairs(np.frombuffer(b"".join(words), np.uint8), last + 1 - sizes, last):
                seen += np.bincount(codes, minlength=seen.size)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"pair": at, "c": seen[at]})

    times = np.full(1 << 16, SMOOTH)
    for row in known.select("word").mapInArrow(count, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).collect():
        times[row["pair"]] += row["c"]  # at most 65,536 rows
    table = times.reshape(256, 256)
    return np.log(table / table.sum(axis=1, keepdims=True)).ravel()


def vocabulary(docs: DataFrame) -> tuple[Head, DataFrame]:
    """The head, and the other words of the vocabulary as (hash, log_c)."""
    # counts fall into at most some hundred steps of a sixteenth of a power of two
    known = durable(word_counts(docs).withColumn("step", F.floor(F.log2("c") * 16)))
    total, rare = np.zeros(TOKENS), np.zeros(TOKENS)
    by_class = known.groupBy(F.col("hash").bitwiseAND(TOKENS - 1).alias("class"))
    for row in by_class.agg(F.sum("c").alias("all"), F.sum(F.when(F.col("c") < RARE, F.col("c")).otherwise(0)).alias("rare")).collect():
        total[row["class"]], rare[row["class"]] = row["all"], row["rare"]
    often = known.filter(F.col("c") >= RARE)
    least, room = None, HEAD
    for row in sorted(often.groupBy("step").count().collect(), reverse=True):
        room -= row["count"]
        if room < 0:
            break
        least = row["step"]
    top = often.filter(F.col("step") >= least).select("hash", "c").collect() if least is not None else []
    top.sort()
    head = Head(np.array([r["hash"] for r in top], np.int64), np.log(np.array([r["c"] for r in top], float)),
                np.log1p(total), np.log1p(rare), spelling_of(known))
    tail = often if least is None else often.filter(F.col("step") < least)
    return head, tail.select("hash", F.log("c").alias("log_c"))


def in_class(texts: list[str], hashes: np.ndarray, token: np.ndarray, head: Head, letters: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(in the head or not, log probability within the class as a head or rare word, what
    a word outside the head that the join finds has to add to its log count).  ``letters``
    are the texts' ``word_bytes``, if they are known."""
    data, first, _ = letters or word_bytes(texts)
    of_class = -head.total.take(token)
    coded = pa.array(hashes).dictionary_encode()  # different words are looked up once
    different, at = coded.dictionary.to_numpy(), np.zeros(hashes.size, np.int64)
    inside = np.zeros(hashes.size, bool)
    if head.hashes.size and hashes.size:
        found = np.minimum(np.searchsorted(head.hashes, different), head.hashes.size - 1)
        number = coded.indices.to_numpy()
        at, inside = found.take(number), (head.hashes.take(found) == different).take(number)
    value = of_class.copy()
    value[inside] += head.logs.take(at[inside])
    outside = np.flatnonzero(~inside)
    value[outside] += head.rare.take(token.take(outside)) + spelt(data, first, outside, head.spelling)
    return inside, value, of_class


def text_score(text: Column, weights: np.ndarray, head: Head | None = None) -> Column:
    """Number of tokens and summed log probability of each text: of the words with ``head``,
    of their classes without.  Words outside the head come as arrays and are not yet in the sum."""
    kind = pa.struct([("n_tokens", pa.int64()), ("score", pa.float64()), ("hash", pa.list_(pa.int64())),
                      ("spelt", pa.list_(pa.float64())), ("share", pa.list_(pa.float64()))])

    def scored(net: Network, texts: list[str]) -> pa.Array:
        letters = word_bytes(texts)
        hashes = hashes_of(*letters[:2])
        context, token, owner = placed(hashes, letters[2])
        each = np.zeros(token.size)
        for at in range(0, token.size, BLOCK):
            each[at:at + BLOCK] = net.log_probability(context[at:at + BLOCK], token[at:at + BLOCK])
        outside, late = np.zeros(0, np.int64), (hashes.view(np.int64), each, each)
        if head is not None:
            inside, value, of_class = in_class(texts, late[0], token, head, letters)
            outside = np.flatnonzero(~inside)
            each[inside] += value[inside]
            late = late[0], value, of_class
        cuts = pa.array(np.searchsorted(owner.take(outside), np.arange(len(texts) + 1)), pa.int32())
        columns = [np.bincount(owner, minlength=len(texts)), np.bincount(owner, weights=each, minlength=len(texts)).astype(float)]
        lists = [pa.ListArray.from_arrays(cuts, pa.array(values.take(outside))) for values in late]
        return pa.StructArray.from_arrays([*map(pa.array, columns), *lists], fields=list(kind))

    @F.arrow_udf("n_tokens long, score double, hash array<bigint>, spelt array<double>, share array<double>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net = Network(weights)
        for batch in batches:
            yield pa.concat_arrays([scored(net, texts) for texts in chunks(batch.to_pylist())] or [pa.array([], kind)])

    return score(text)


def pseudo_likelihood(docs: DataFrame, weights: np.ndarray | None = None, words: tuple[Head, DataFrame] | None = None) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``score`` (natural log) and ``mean_score`` of every row, by a
    network and a vocabulary made of these documents or by the given ones.  Given weights
    without words score classes only."""
    short_batches(docs.sparkSession)
    if weights is None:
        weights, words = train(docs), words or vocabulary(docs)
    head, tail = words or (None, None)
    scored = docs.select("doc_id", text_score(F.col("text"), weights, head).alias("s")).select("doc_id", "s.*")
    if tail is not None:
        scored = durable(scored.withColumn("rid", F.monotonically_increasing_id()))
        # a word outside the head is rare enough for no task to be full of it
        late = scored.select("rid", F.explode(F.arrays_zip("hash", "spelt", "share")).alias("w")).select("rid", "w.*")
        value = F.coalesce(F.col("log_c") + F.col("share"), F.col("spelt"))
        more = late.join(tail, "hash", "left").groupBy("rid").agg(F.sum(value).alias("more"))
        scored = scored.join(more, "rid", "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0)))
    return scored.select("doc_id", "n_tokens", "score", F.when(F.col("n_tokens") > 0, F.col("score") / F.col("n_tokens")).alias("mean_score"))
