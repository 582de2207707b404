"""Structure repair of conversations over a suffix-shared automaton.

A legal conversation is empty, or an optional system turn followed by one or more pairs of a
user and an assistant turn: ``(s?(ua)+)?`` in role initials.  Every turn has at most one
fault, the first that applies: ``blank`` (nothing but white space), ``duplicate`` (role and
text seen earlier in the conversation), ``truncated`` (its last character that is no white
space is none of ``.!?``).  Edits in order: Keep (free), Rerole to user or assistant (3),
Delete (4; blank and duplicate turns have to go), Insert an empty turn of a user or an
assistant anywhere (3); truncated turns that stay cost 3 more.  The cheapest edits are
written as their initials, and of equally cheap ones the least string is taken.

Only roles' initials and faults matter for that, so a conversation is a short word, its
*signature*, and costs are worked out from its end:

* Signatures of all conversations are made distinct and sorted by their reversal; a task goes
  through its range with a stack of nodes, one per suffix, so a suffix that many conversations
  share is one node: for each grammar state before it (nothing yet, after s, u, a) the
  cost-to-go and the best audit of the rest are computed once.
* Nodes are minimised: costs that differ by a constant, with their audits in the same order,
  choose alike whatever comes before.  There are few such classes, whatever the data; they
  and their transitions form the automaton ``CLASSES``, built once.
* A conversation of any length is cut into blocks of ``BLOCK`` turns.  A block's effect on
  each class that may follow it is a small table, so a walk over the blocks of a conversation (one
  row for 1,024 turns) tells each block what follows it and in which state it begins.
  Blocks are then words like any other.

Answers of signatures that more than one block in ``HEAVY`` has are broadcast (at most
``HEAVY`` rows of bounded length), the others meet their blocks in a join, so no common signature is
one task.  The SHA-256 of a conversation is a chain over its bytes: its turns pass one task
as a sorted stream, a batch in memory at a time.

Defined results: null roles and texts are one space, so blank; turns of a null conversation
id form one conversation; turns go by ``turn``, nulls first, then role and text; repeated
rows are duplicates of each other.  Roles count by their first letter as it is written; a
role of another letter, or an empty one, can only be rerolled or deleted.  Conversations in
``every`` without a turn have zeros, an empty audit and the digest of nothing.  An empty
table gives no rows.  Only the four named columns are read, so extra columns cannot clash.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from foretally.llm.common import map_groups, numbered, partitions, short_batches
from foretally.session import durable

BLOCK = 1024
HEAVY = 512
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

INITIALS = "suao"              # system, user, assistant, any other
GOOD, CUT, BLANK, SEEN = range(4)  # faults
LEGAL_PAIRS = ("su", "ua", "au")
END = -1                       # nothing follows a block; not a class, since later suffixes may ask the same
STATES = 4                     # nothing yet, after s, after u, after a
NEXT = (2, 2, 3, 2)            # the state after a user or assistant turn that is legal there
FULL = {2: "user", 3: "assistant"}
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
GONE = "x"                     # in a signature: a turn that has to be deleted
SYMBOLS = INITIALS + INITIALS.upper() + GONE  # capital: truncated
WHITE = " \t\n\x0b\x0c\r"


def moves(symbol: str) -> list[list[tuple[int, str, int]]]:
    """Per state, all (cost, edits, state after) that consume one turn, inserts before it included."""
    initial, extra = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    out = []
    for state in range(STATES):
        found, at = [], state
        for j in range(3):  # after a third insert the state is that after the first
            found.append((INSERT * j + DELETE, "I" * j + "D", at))
            if symbol != GONE:
                found.append((INSERT * j + REROLE + extra, "I" * j + "R", NEXT[at]))
                if (at, initial) in KEPT:
                    found.append((INSERT * j + extra, "I" * j + "K", KEPT[at, initial]))
            at = NEXT[at]
        out.append(found)
    return out


class Automaton:
    """Classes of suffixes by what they ask of the turns before them.  A class is (cost above
    the least, place in the order of audits) of each state; ``step[class][symbol]`` is (class
    before that turn, least cost added, (edits, state after) per state)."""

    def __init__(self):
        # nothing follows: states 0 and 3 may end, the others need inserts
        self.closing = ("", "II", "I", "")
        costs = tuple(INSERT * len(c) for c in self.closing)
        known = {(costs, tuple(sorted(set(self.closing)).index(c) for c in self.closing)): 0}
        ways = {s: moves(s) for s in SYMBOLS}
        self.costs, self.step, todo = [], [], list(known)
        for at in todo:  # grows while new classes turn up
            self.costs.append(at[0])
            row = {}
            for symbol, way in ways.items():
                best = [min((cost + at[0][to], edits, at[1][to], to) for cost, edits, to in way[s]) for s in range(STATES)]
                least = min(b[0] for b in best)
                order = sorted({b[1:3] for b in best})
                made = (tuple(b[0] - least for b in best), tuple(order.index(b[1:3]) for b in best))
                if made not in known:
                    known[made] = len(known)
                    todo.append(made)
                row[symbol] = (known[made], least, tuple((b[1], b[3]) for b in best))
            self.step.append(row)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """[symbol, class] -> class before, and [symbol, class, state] -> state after."""
        before = np.array([[row[s][0] for row in self.step] for s in SYMBOLS])
        after = np.array([[[to for _, to in row[s][2]] for row in self.step] for s in SYMBOLS])
        return before, after


CLASSES = Automaton()


def block_table(signature: str) -> bytes:
    """For each class that may follow the block: the class before the block, and the state at
    its end for each state at its beginning."""
    before, after = CLASSES.tables()
    n = len(CLASSES.step)
    at, ends = np.arange(n), np.tile(np.arange(STATES), (n, 1))
    for symbol in reversed(signature):
        k = SYMBOLS.index(symbol)
        ends = np.take_along_axis(ends, after[k, at], axis=1)
        at = before[k, at]
    return np.c_[at, ends].astype("<u2").tobytes()


def chain(tables: list[bytes]) -> list[tuple[int, int]]:
    """(class that follows, END for the last; state at the beginning) of each block of one conversation."""
    shape = (len(CLASSES.step), 1 + STATES)
    known = [np.frombuffer(t, "<u2").reshape(shape) for t in tables]
    follow, at = [], 0
    for t in reversed(known):
        follow.append(at)
        at = int(t[at, 0])
    follow.reverse()
    out, state = [], 0
    for t, f in zip(known, follow):
        out.append((f, state))
        state = int(t[f, 1 + state])
    out[-1] = (END, out[-1][1])
    return out


class Suffixes:
    """The stack of nodes of the current reversed signature.  A node holds its class, the least
    cost-to-go, and per state the best audit and the state at the block's end."""

    def __init__(self):
        self.follow, self.word, self.stack = None, "", []

    def solve(self, follow: int, word: str, state: int) -> tuple[int, str]:
        """(cost, audit) of a block whose reversed signature is ``word``; words come sorted."""
        if follow != self.follow:
            audits = CLASSES.closing if follow == END else ("",) * STATES
            self.follow, self.word, self.stack = follow, "", [(max(follow, 0), 0, audits, tuple(range(STATES)))]
        shared = 0
        while shared < min(len(word), len(self.word)) and word[shared] == self.word[shared]:
            shared += 1
        del self.stack[shared + 1:]
        for symbol in word[shared:]:
            kind, cost, audits, ends = self.stack[-1]
            before, least, best = CLASSES.step[kind][symbol]
            self.stack.append((before, cost + least, tuple(edits + audits[to] for edits, to in best), tuple(ends[to] for _, to in best)))
        self.word = word
        kind, cost, audits, ends = self.stack[-1]
        beyond = 0 if follow == END else CLASSES.costs[follow][ends[state]]
        return cost + CLASSES.costs[kind][state] - beyond, audits[state]


def first_letter(role: Column) -> Column:
    letter = F.substring(role, 1, 1)
    return F.when(letter.isin("s", "u", "a"), letter).otherwise("o")


def fault(text: Column) -> Column:
    """Blank, truncated or neither, in the JVM."""
    bare = F.rtrim(F.translate(text, WHITE[1:], " " * (len(WHITE) - 1)))
    return F.when(bare == "", BLANK).when(F.substring(bare, -1, 1).isin(".", "!", "?"), GOOD).otherwise(CUT)


def prepared(turns: DataFrame) -> DataFrame:
    """The turns in order, stored once; ``_part`` and ``_seq`` give the order within a conversation."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    plain = turns.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    # equal rows are told apart, so that neither a hot conversation nor a hot row is one range
    told = plain.withColumn("_copy", F.monotonically_increasing_id())
    order = ["conv", "turn", "role", "text", "_copy"]
    dealt = told.repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order).drop("_copy")
    return durable(dealt.withColumns({"_part": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()}))


def blocks_of(rows: DataFrame) -> DataFrame:
    """One row per block: its signature, fault counts, edges, and where its first turn lies."""
    same = F.unhex(F.sha2(F.concat("role", F.lit("\x00"), "text"), 256))
    thin = rows.select("conv", F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNotNull().alias("dated"), first_letter(F.col("role")).alias("initial"), fault(F.col("text")).alias("fault"),
                       same.alias("same"), F.col("_part").alias("part"), F.col("_seq").alias("seq"), "_part", "_seq")
    placed = durable(numbered(thin, ["conv"], ["_seq"], "position"))
    firsts = placed.groupBy("conv", "same").agg(F.min("position").alias("position")).select("conv", "position", F.lit(0).alias("kind"))
    both = placed.drop("same").withColumn("kind", F.lit(1)).unionByName(firsts, allowMissingColumns=True)

    def summed(frame: pd.DataFrame) -> pd.DataFrame:
        kind = frame["kind"].to_numpy()
        fresh = (np.r_[1, kind[:-1]] == 0)[kind == 1]  # a turn right behind the mark of a first one
        frame = frame[kind == 1].reset_index(drop=True)
        faults, letters = frame["fault"].to_numpy(int), frame["initial"].to_numpy(str)
        faults = np.where((faults != BLANK) & ~fresh, SEEN, faults)
        marks = np.where(faults >= BLANK, GONE, np.where(faults == CUT, np.char.upper(letters), letters))
        conv = pd.factorize(frame["conv"], use_na_sentinel=False)[0]
        block = frame["block"].to_numpy()
        head = np.r_[True, (conv[1:] != conv[:-1]) | (block[1:] != block[:-1])]
        starts = np.flatnonzero(head)
        ends = np.r_[starts[1:], len(head)]
        pair = np.concatenate([[""], np.char.add(letters[:-1], letters[1:])])
        illegal = ~head & ~np.isin(pair, LEGAL_PAIRS)
        turn, dated = frame["turn"].to_numpy(np.int64), frame["dated"].to_numpy(bool)
        turns = dated & (head | (np.r_[0, turn[:-1]] != turn) | ~np.r_[False, dated[:-1]])
        total = {name: np.add.reduceat(v.astype(np.int64), starts) for name, v in (
            ("blank", faults == BLANK), ("duplicate", faults == SEEN), ("truncated", faults == CUT), ("illegal", illegal), ("turns", turns))}
        word = "".join(marks)
        signatures = [word[a:b] for a, b in zip(starts, ends)]
        of_first, undated = frame.iloc[starts], ~dated[ends - 1]  # turns without a number come first
        earliest = np.minimum(starts + np.add.reduceat((~dated).astype(np.int64), starts), ends - 1)
        # only conversations of more than one block ask for tables
        tables = [block_table(s) if b > 0 or len(s) == BLOCK else None for s, b in zip(signatures, of_first["block"])]
        return pd.DataFrame({
            "conv": of_first["conv"].to_numpy(), "block": of_first["block"].to_numpy(), "part": of_first["part"].to_numpy(int),
            "seq": of_first["seq"].to_numpy(np.int64), "signature": signatures, "effect": tables, **total,
            "first_turn": pd.arrays.IntegerArray(turn[earliest], undated), "last_turn": pd.arrays.IntegerArray(turn[ends - 1], undated.copy()),
            "edges": np.char.add(letters[starts], letters[ends - 1])})

    return map_groups(both.withColumn("block", F.floor(F.col("position") / BLOCK)), ["conv", "block"], ["position", "kind"], summed,
                      "conv string, block long, part int, seq long, signature string, effect binary, blank long, duplicate long, "
                      "truncated long, illegal long, turns long, first_turn long, last_turn long, edges string")


def with_context(blocks: DataFrame) -> DataFrame:
    """Blocks with ``follow`` (class of what follows) and ``state`` (at their beginning)."""
    def chained(frame: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for _, part in frame.groupby("conv", sort=False, dropna=False):
            found = chain(part["effect"].tolist()) if len(part) > 1 else [(END, 0)]
            parts.append(pd.DataFrame({"conv": part["conv"], "block": part["block"], "follow": [f for f, _ in found], "state": [s for _, s in found]}))
        return pd.concat(parts, ignore_index=True)

    # a conversation has a second block only if its first one is full
    longer = blocks.where(F.col("effect").isNotNull()).select("conv", "block", "effect")
    edges = map_groups(longer, ["conv"], ["block"], chained, "conv string, block long, follow int, state int").withColumnsRenamed({"conv": "c", "block": "b"})
    alone = blocks.where(F.col("effect").isNull() & (F.col("block") == 0)).withColumns({"follow": F.lit(END), "state": F.lit(0)})
    chained_ = blocks.where(F.col("effect").isNotNull()).join(edges, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).drop("c", "b")
    return alone.unionByName(chained_).drop("effect")


def audited(blocks: DataFrame) -> DataFrame:
    """Blocks with ``audit`` and ``cost``, computed once per distinct signature and context."""
    keys = ["follow", "signature", "state"]
    total = blocks.count()
    words = blocks.groupBy(*keys).agg(F.count("*").alias("times")).withColumn("word", F.reverse("signature"))
    order = ["follow", "word", "state"]
    dealt = words.repartitionByRange(partitions(blocks.sparkSession), *order).sortWithinPartitions(*order)

    def solved(batches):
        nodes = Suffixes()
        for batch in batches:
            got = [nodes.solve(f, w, s) for f, w, s in zip(*(batch.column(c).to_pylist() for c in order))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in (*keys, "times")] + [pa.array([c for c, _ in got], pa.int64()), pa.array([a for _, a in got], pa.string())],
                names=[*keys, "times", "cost", "audit"])

    answers = durable(dealt.mapInArrow(solved, "follow int, signature string, state int, times long, cost long, audit string"))
    common = F.col("times") * HEAVY > total  # fewer than HEAVY signatures
    heavy, light = answers.where(common).drop("times"), answers.where(~common).drop("times")
    kept = blocks.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys)
    return blocks.join(F.broadcast(heavy), keys).unionByName(kept)


COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")


def stream(rows: DataFrame, blocks: DataFrame, every: DataFrame) -> DataFrame:
    """Per conversation in order: its id, then each block's audit followed by the block's turns."""
    ids = every.select(F.col("conv_id").cast("string").alias("conv")).distinct().select(
        "conv", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("seq"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("string").alias("text"), F.lit(None).cast("array<long>").alias("numbers"))
    heads = blocks.select("conv", "part", "seq", F.lit(1).alias("kind"), F.col("edges").alias("role"), F.col("audit").alias("text"),
                          F.array(*COUNTS, "turns", "first_turn", "last_turn", F.col("state").cast("long")).alias("numbers"))
    turns = rows.select("conv", F.col("_part").alias("part"), F.col("_seq").alias("seq"), F.lit(2).alias("kind"), "role", "text",
                        F.lit(None).cast("array<long>").alias("numbers"))
    return (ids.unionByName(heads).unionByName(turns).repartition(partitions(rows.sparkSession), "conv")
            .sortWithinPartitions("conv", "part", "seq", "kind"))


class Conversation:
    """What has been seen of one conversation in the stream."""

    def __init__(self, conv):
        self.conv, self.audit, self.counts = conv, [], np.zeros(len(COUNTS), np.int64)
        self.turns, self.least, self.last, self.edge = 0, None, None, ""
        self.todo, self.state, self.position, self.sha = iter(()), 0, 0, hashlib.sha256()

    def head(self, edges: str, audit: str, numbers: list) -> None:
        """The counts and the audit of the next block."""
        *counts, turns, first, last, self.state = numbers
        self.counts += counts
        self.counts[3] += bool(self.edge) and self.edge + edges[0] not in LEGAL_PAIRS
        self.edge = edges[-1]
        self.turns += turns - (first is not None and first == self.last)
        if last is not None:
            self.least, self.last = first if self.least is None else self.least, last
        self.audit.append(audit)
        self.todo = iter(audit)

    def turn(self, role: str, text: str) -> list[tuple[str, str, str]]:
        """(edit, role, text) of the turns that this one becomes, empty inserted ones before it included."""
        out = []
        for edit in self.todo:
            if edit == "I" or edit == "R":
                self.state = NEXT[self.state]
                out.append((edit, FULL[self.state], "" if edit == "I" else text))
            elif edit == "K":
                self.state = KEPT[self.state, role[:1]]
                out.append((edit, role, text))
            if edit != "I":
                break
        return out

    def rest(self) -> list[tuple[str, str, str]]:
        """Turns inserted behind the last one."""
        return self.turn("", "")


def repaired(records: DataFrame, schema: str, of_turns, of_end) -> DataFrame:
    """Walk through the stream: ``of_turns(conversation, made)`` for what each turn becomes, and
    ``of_end(conversation)`` behind the last one, both give rows of ``schema``."""
    fields = StructType.fromDDL(schema).fields
    names, kinds = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]

    def packed(rows):
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    def run(batches):
        at = None
        for batch in batches:
            out = []
            for conv, kind, role, text, numbers in zip(*(batch.column(c).to_pylist() for c in ("conv", "kind", "role", "text", "numbers"))):
                if at is None or conv != at.conv:
                    if at is not None:
                        out += of_turns(at, at.rest()) + of_end(at)
                    at = Conversation(conv)
                if kind == 1:
                    at.head(role, text, numbers)
                elif kind == 2:
                    out += of_turns(at, at.turn(role, text))
            yield from packed(out)
        if at is not None:
            yield from packed(of_turns(at, at.rest()) + of_end(at))

    return records.mapInArrow(run, schema)


def digests(at: Conversation, made: list[tuple[str, str, str]]) -> list:
    """Feed a conversation's running SHA-256."""
    for _, role, text in made:
        at.sha.update(f"{chr(10) if at.position else ''}{role}:{text}".encode("utf-8", "replace"))
        at.position += 1
    return []


def report(at: Conversation) -> list[tuple]:
    gaps = 0 if at.last is None else at.last - at.least + 1 - at.turns
    blank, duplicate, truncated, illegal, cost = at.counts.tolist()
    return [(at.conv, gaps, blank, duplicate, truncated, illegal, cost, "".join(at.audit), at.sha.hexdigest())]


def analysed(turns: DataFrame, every: DataFrame | None) -> DataFrame:
    short_batches(turns.sparkSession, 1000)
    rows = prepared(turns)
    blocks = durable(with_context(durable(blocks_of(rows))))
    return stream(rows, audited(blocks), turns if every is None else every)


def repair_structure(turns: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """One row per conversation of ``every`` (default: of ``turns``): ``conv_id``, ``gaps`` (missing
    turn numbers), ``blank``, ``duplicate``, ``truncated``, ``illegal`` (neighbours that may not
    follow each other), ``cost``, ``audit``, ``repaired_sha256`` (of ``role:text`` lines)."""
    found = repaired(analysed(turns, every), "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
                     "audit string, repaired_sha256 string", digests, report)
    return found.withColumn("conv", F.col("conv").cast(dict(turns.dtypes)["conv_id"])).withColumnRenamed("conv", "conv_id")


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id``, ``position`` (from 0), ``role``, ``text``, ``edit``."""
    def placed(at, made):
        first, at.position = at.position, at.position + len(made)
        return [(at.conv, first + i, role, text, edit) for i, (edit, role, text) in enumerate(made)]

    found = repaired(analysed(turns, None), "conv string, position long, role string, text string, edit string", placed, lambda at: [])
    return found.withColumn("conv", F.col("conv").cast(dict(turns.dtypes)["conv_id"])).withColumnRenamed("conv", "conv_id")


def damaged(turns: DataFrame) -> DataFrame:
    """The stated damage for trials: by crc32 of ``conv_id:turn`` modulo 20, 0 drops a turn, 1 empties
    it, 2 removes its full stops, exclamation and question marks, 3 repeats it, 4 gives it to the user."""
    def shown(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    case = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(case == 1, "").when(case == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    copies = F.explode(F.when(case == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return (turns.where(case != 0).select("conv_id", "turn", F.when(case == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"), copies.alias("_c"))
            .drop("_c"))
