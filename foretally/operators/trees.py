"""Regression trees per series: forests and gradient boosting, all series in one job.

Feature values become bins, at most ``BINS`` per series and feature, cut at quantiles of the
train rows.  A split sends the bins up to one of them to the left and takes the largest drop
of the weighted squared error; ties go to the first feature and the lowest bin.

* Rows travel as packed pieces (bins, target, position), a few thousand rows in one record.
* A node with at most ``LOCAL`` train rows is grown to its end inside one task: nodes above ``NEAR`` rows
  from their sums per bin, smaller ones with the rows of all nodes of a level in bin order for
  every feature, so that a level costs a few passes over the rows whatever the number of nodes.
  A forest's rows of equal bins, which no split parts, are one row with the sums of theirs, and
  its test rows pass down with the train rows, so that a task never holds a whole tree.
* Larger nodes are split in Spark, one pass a level for all series and trees at once: tasks
  add up (weight, weight x target) per (tree, node, feature, bin), the sums are combined per node
  and the best split of each node goes back to the pieces of its series.
* Row weights of a forest (Poisson, mean 1) and the rows of a boosting round are drawn by a
  hash of (position, tree), so a task that runs again draws the same.

Splits are the same on both ways up to the rounding of sums.  Boosting is sequential: series
above ``BOOSTED`` take one small job per level of every round, over rows that stay cached on the
executors, a smaller one a single task.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretally.operators.blocks import KEYS, spread_join
from foretally.operators.matrices import matrix_of
from foretally.operators.ridge import add_up, behind_weights
from foretally.session import checkpoint_folder, durable

BINS = 256
LOCAL = 6 << 20      # train rows of a node that one task grows to its end
BOOSTED = 1 << 16    # train rows of a series that one task boosts, as its rounds follow each other
NEAR = 1 << 17       # rows whose levels are grown side by side, so that they stay in the cache
GROUP = 20           # trees grown by one task over the same rows
SPREAD = 6           # partitions for each group of trees of a series: few groups with much work should not meet
PIECES = 1 << 20     # rows of a task in boosting above BOOSTED
LINEAGE = 50         # rounds after which the rests are stored, so that a lost task repeats no more of them
LONE = np.array([[-1.0, 0.0, -1.0, 0.0]])
LEAST_GAIN = 1e-12   # a split takes off more than this share of the node's squared sum
TIE = 1e-8           # gains this close are equal, however their sums were rounded
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.r_[1.0, np.arange(1, 16)]))

TREE, FEATURE, BIN, LEFT, VALUE, STATE = range(6)  # columns of a packed model
SPLIT, OPEN, SMALL, LEAF = 0.0, 1.0, 2.0, 3.0


# ---- inside a task ---------------------------------------------------------------------

def draws(t: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Uniform numbers of (position, tree, seed)."""
    h = t.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((tree * 0xD1342543DE82EF95 + seed * 0xA0761D6478BD642F) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def weights_of(kind: str, t: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    u = draws(t, tree, seed)
    return np.searchsorted(POISSON, u, side="right").astype(float) if kind == "forest" else (u < share).astype(float)


def orders_of(x: np.ndarray) -> list[np.ndarray]:
    return [np.argsort(x[:, f], kind="stable") for f in range(x.shape[1])]


def gains(cw, cs, tw, ts, penalty):
    """Drop of the squared error when a part (cw, cs) is split off from the totals (tw, ts)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = cs * cs / (cw + penalty) + (ts - cs) ** 2 / (tw - cw + penalty) - ts * ts / (tw + penalty)
    return np.where((cw > 0) & (tw - cw > 0), gain, -np.inf)


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, orders: list[np.ndarray], depth: int | None, penalty: float) -> np.ndarray:
    """A tree as rows (feature, bin, left child, value); a leaf has the feature -1."""
    orders = [o[w[o] > 0] for o in orders]
    wy, wyy = w * y, w * y * y
    feature, cut, left, value = [-1], [0], [-1], [0.0]
    nodes, sizes, level = np.array([0]), np.array([len(orders[0])]), 0
    while len(nodes) and sizes[0]:
        starts = np.cumsum(sizes) - sizes
        seg = np.repeat(np.arange(len(nodes)), sizes)
        tw, ts = np.add.reduceat(w[orders[0]], starts), np.add.reduceat(wy[orders[0]], starts)
        for node, v in zip(nodes.tolist(), (ts / (tw + penalty)).tolist()):
            value[node] = v
        if depth is not None and level == depth:
            break
        best, of, at = LEAST_GAIN * np.add.reduceat(wyy[orders[0]], starts), np.full(len(nodes), -1), np.zeros(len(nodes), int)
        for f, o in enumerate(orders):
            b = x[o, f]
            cw, cs = np.cumsum(w[o]), np.cumsum(wy[o])
            cw, cs = cw - (cw[starts] - w[o[starts]])[seg], cs - (cs[starts] - wy[o[starts]])[seg]
            gain = gains(cw, cs, tw[seg], ts[seg], penalty)
            gain[:-1][(b[1:] == b[:-1]) | (seg[1:] != seg[:-1])] = -np.inf
            gain[-1] = -np.inf
            top = np.maximum.reduceat(gain, starts)
            first = np.flatnonzero(gain >= (top - TIE * np.abs(top))[seg])
            first = first[np.r_[True, seg[first][1:] != seg[first][:-1]]]
            better = top > best * (1 + TIE)
            best[better], of[better], at[better] = top[better], f, b[first[better]]
        split = of >= 0
        if not split.any():
            break
        kids = len(feature) + 2 * np.arange(int(split.sum()))
        for node, f, c, kid in zip(nodes[split].tolist(), of[split].tolist(), at[split].tolist(), kids.tolist()):
            feature[node], cut[node], left[node] = f, c, kid
        for column, blank in ((feature, -1), (cut, 0), (left, -1), (value, 0.0)):
            column += [blank] * (2 * len(kids))
        # rows keep their bin order inside each child
        number = np.cumsum(split) - 1
        held = split[seg]
        o = orders[0][held]
        s = number[seg[held]]
        right = np.zeros(len(w), bool)
        right[o] = x[o, of[split][s]] > at[split][s]
        n_right = np.bincount(s, right[o], len(kids)).astype(int)
        sizes = np.c_[sizes[split] - n_right, n_right].ravel()
        starts = np.cumsum(sizes) - sizes
        moved = []
        for o in orders:
            o = o[held]
            r = right[o]
            place = np.empty(len(o), int)
            place[~r] = starts[2 * s[~r]] + within(s[~r])
            place[r] = starts[2 * s[r] + 1] + within(s[r])
            new = np.empty_like(o)
            new[place] = o
            moved.append(new)
        orders, nodes, level = moved, np.c_[kids, kids + 1].ravel(), level + 1
    return np.c_[feature, cut, left, value].astype(float)


def alike(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(columns of the distinct rows of bins, number of each row's): rows of equal bins are never parted."""
    code = np.zeros(len(x), np.uint64)
    for f in range(x.shape[1]):
        if f >= 8 and f % 4 == 0:  # eight columns fill a code; its rank leaves room for four more
            code = np.unique(code, return_inverse=True)[1].astype(np.uint64)
        code = code * np.uint64(256) + x[:, f]
    _, first, number = np.unique(code, return_index=True, return_inverse=True)
    return np.ascontiguousarray(x[first].T), number


def grow_near(x: np.ndarray, w: np.ndarray, wy: np.ndarray, wyy: np.ndarray, penalty: float) -> tuple:
    """A tree without a depth (feature, bin, left child, value) from columns of bins and the sums of weights,
    weighted targets and their squares of each row.  Targets are taken off their node's mean."""
    (width, n), flat, single = x.shape, x.ravel(), wy / (w + penalty)
    feature, cut, left, value = np.full(2 * n + 1, -1, np.int8), np.zeros(2 * n + 1, np.uint8), np.full(2 * n + 1, -1, np.int32), np.zeros(2 * n + 1)
    orders = [np.argsort(c, kind="stable") for c in x]
    nodes, sizes, count = np.zeros(1, int)[:n], np.array([n])[:n], 1
    pairs, goes = np.empty(n, complex), np.empty(n, np.int8)  # (weight, weighted target) are added up side by side
    while len(nodes):
        o, m = orders[0], len(nodes)
        ends = np.cumsum(sizes)
        starts, seg = ends - sizes, np.repeat(np.arange(m), sizes)
        here, there = w[o], wy[o]
        tw, ts = np.add.reduceat(here, starts), np.add.reduceat(there, starts)
        mean, before = ts / tw, np.cumsum(tw) - tw
        value[nodes] = ts / (tw + penalty)
        pair = np.empty(len(o), complex)
        pair.real, pair.imag = here, there - here * mean[seg]
        pairs[o] = pair
        best, of, at = LEAST_GAIN * np.add.reduceat(wyy[o], starts), np.full(m, -1), np.zeros(m, np.uint8)
        for f, o in enumerate(orders):
            b = x[f][o]
            ahead = np.empty(len(o), bool)
            np.not_equal(b[1:], b[:-1], out=ahead[:-1])
            ahead[ends - 1] = False
            cand = np.flatnonzero(ahead)  # where a split may come after a row
            if not len(cand):
                continue
            run = pairs[o]
            np.cumsum(run, out=run)
            s, off, run = seg[cand], np.r_[0.0, run.imag[ends[:-1] - 1]], run[cand]
            cw, cs = run.real - before[s], run.imag - off[s]
            gain = gains(cw, cs + mean[s] * cw, tw[s], ts[s], penalty) if penalty else cs * cs / (cw * (tw[s] - cw))
            counts = np.bincount(s, minlength=m)
            there = np.flatnonzero(counts)
            top = np.full(m, -np.inf)
            top[there] = np.maximum.reduceat(gain, (np.cumsum(counts) - counts)[there])
            drop = top if penalty else top * tw
            better = drop > best * (1 + TIE)
            hit = np.flatnonzero(gain >= np.where(better, top - TIE * np.abs(top), np.inf)[s])
            node = s[hit]
            first = np.r_[True, node[1:] != node[:-1]][:len(node)]
            best, of[better], at[node[first]] = np.where(better, drop, best), f, b[cand[hit[first]]]
        split = of >= 0
        if not split.any():
            break
        kids = count + 2 * np.arange(int(split.sum()))
        feature[nodes[split]], cut[nodes[split]], left[nodes[split]] = of[split], at[split], kids
        # rows keep their bin order inside each child; left children come first, and rows by themselves are done
        o = orders[0]
        right = flat[(of * n)[seg] + o] > at[seg]
        n_right = np.add.reduceat(right, starts, dtype=int)
        n_left = sizes - n_right
        side = right.astype(np.int8)
        side[~split[seg]] = 2
        lone = np.flatnonzero((np.where(right, n_right[seg], n_left[seg]) == 1) & (side < 2))
        value[(count + 2 * (np.cumsum(split) - 1))[seg[lone]] + side[lone]] = single[o[lone]]
        side[lone] = 2
        goes[o] = side
        moved = []
        for o in orders:
            side = goes[o]
            moved.append(np.concatenate([np.compress(side == 0, o), np.compress(side == 1, o)]))
        n_left, n_right = n_left[split], n_right[split]
        orders, count = moved, count + 2 * len(kids)
        nodes, sizes = np.r_[kids[n_left > 1], kids[n_right > 1] + 1], np.r_[n_left[n_left > 1], n_right[n_right > 1]]
    return feature[:count], cut[:count], left[:count], value[:count]


def subtrees(x: np.ndarray, w: np.ndarray, wy: np.ndarray, wyy: np.ndarray, test: np.ndarray, penalty: float) -> Iterator[tuple]:
    """A tree without a depth, for many rows, as (node, next free number, its top or whole subtree, test rows in it):
    nodes above ``NEAR`` rows are split by sums per bin, the others grown by themselves."""
    kept = np.flatnonzero(w > 0)
    size, todo = 1, [(0, x[:, kept], w[kept], wy[kept], wyy[kept], np.arange(test.shape[1]))]
    while todo:
        node, x, w, wy, wyy, rows = todo.pop()
        width, n = x.shape
        if n <= NEAR:
            tree = grow_near(x, w, wy, wyy, penalty)
            yield node, size, tree, rows
            size += len(tree[0]) - 1
            continue
        (value, split), = level_splits(np.concatenate([np.bincount(c, v, BINS) for v in (w, wy) for c in x] + [[wyy.sum()]])[None], width, penalty)
        f, b = split[:2] if split else (-1, 0)
        yield node, size, tuple(np.array([v]) for v in (f, b, 1 if split else -1, value)), rows
        if split:
            for kid, side in ((size, np.flatnonzero(x[f] <= b)), (size + 1, np.flatnonzero(x[f] > b))):
                there = (test[f][rows] > b) == (kid > size)
                todo.append((kid, x[:, side], w[side], wy[side], wyy[side], rows[there]))
            size += 2


def grow_apart(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float) -> np.ndarray:
    """``grow`` without a depth, for many rows."""
    parts, size = [], 1
    for node, free, (feature, cut, left, value), _ in subtrees(np.ascontiguousarray(x.T), w, w * y, w * y * y, np.zeros((x.shape[1], 0), np.uint8), penalty):
        rows = np.c_[feature, cut, np.where(left < 0, -1, left + free - 1), value].astype(float)
        parts.append((node, free, rows))
        size = max(size, free + max(len(rows) - 1, 2 * int(left[0] > 0)))
    tree = np.empty((size, 4))
    for node, free, rows in parts:
        tree[free:free + len(rows) - 1] = rows[1:]
    for node, free, rows in parts:
        tree[node] = rows[0]
    return tree


def forest_sums(x: np.ndarray, y: np.ndarray, t: np.ndarray, numbers, seed: int, test: np.ndarray) -> np.ndarray:
    """Sums of the values that the trees of ``numbers`` give to the test rows.  These pass down with the train
    rows, so no tree is held; rows of equal bins are one row with the sums of theirs."""
    (x, of), (seen, back) = alike(x), alike(test)
    total = np.zeros(seen.shape[1])
    for number in numbers:
        w = weights_of("forest", t, number, seed, 1.0)
        sums = [np.bincount(of, v, x.shape[1]) for v in (w, w * y, w * y * y)]
        for _, _, tree, rows in subtrees(x, *sums, seen, 0.0):
            if len(rows) and (len(tree[0]) > 1 or tree[0][0] < 0):
                total[rows] += walk(tree, seen[:, rows].T)
    return total[back]


def slim(tree: np.ndarray) -> tuple:
    """The columns of a tree in small types: a task holds several trees of many leaves."""
    return tree[:, 0].astype(np.int8), tree[:, 1].astype(np.uint8), tree[:, 2].astype(np.int32), tree[:, 3].copy()


def within(s: np.ndarray) -> np.ndarray:
    """Place of each entry inside its run of equal (sorted) values."""
    if not len(s):
        return np.zeros(0, int)
    head = np.r_[True, s[1:] != s[:-1]]
    return np.arange(len(s)) - np.maximum.accumulate(np.where(head, np.arange(len(s)), 0))


def landed(tree, x: np.ndarray) -> np.ndarray:
    """Leaves that the rows reach."""
    feature, cut, left = slim(tree)[:3] if isinstance(tree, np.ndarray) else tree[:3]
    at, todo = np.zeros(len(x), int), np.arange(len(x))
    while len(todo):
        todo = todo[feature[at[todo]] >= 0]
        here = at[todo]
        at[todo] = left[here] + (x[todo, feature[here]] > cut[here])
    return at


def walk(tree, x: np.ndarray) -> np.ndarray:
    """Values of the leaves that the rows reach."""
    return (tree[:, 3] if isinstance(tree, np.ndarray) else tree[3])[landed(tree, x)]


def boost(x, y, t, seed: int, rounds: int, depth: int, rate: float, share: float, penalty: float) -> tuple[float, list[np.ndarray]]:
    """(start value, trees): every tree is fitted to what the ones before leave."""
    orders, base = orders_of(x), float(y.mean())
    left, trees = y - base, []
    for i in range(rounds):
        w = weights_of("boosting", t, i, seed, share)
        tree = grow(x, left, w, orders, depth, penalty)
        left = left - rate * walk(tree, x)
        trees.append(tree)
    return base, trees


# ---- packed pieces ---------------------------------------------------------------------

def quantile_edges(train: DataFrame, features, keys) -> DataFrame:
    """keys, n, w: for each feature ``BINS`` - 1 rising edges, padded with infinity."""
    at = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    cuts = [F.array_distinct(F.percentile_approx(f, at, 10000)) for f in features]
    padded = [F.slice(F.concat(c, F.array_repeat(F.lit(float("inf")), BINS)), 1, BINS - 1) for c in cuts]
    return train.groupBy(*keys).agg(F.concat(*padded).alias("w"))


def packed(rows: DataFrame, features, keys) -> DataFrame:
    """keys, part, first (smallest position), rows, x, y, t: binned rows of train and test."""
    features, keys = list(features), list(keys)
    sizes = rows.groupBy(*keys).agg(F.max("n").alias("n"))
    edges = quantile_edges(rows.where("part = 'train'"), features, keys).join(sizes, keys)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)

    def pack(body: pd.DataFrame, w: np.ndarray) -> pd.DataFrame:
        cuts, raw, out = w.reshape(len(features), BINS - 1), matrix_of(body, features), []
        x = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, raw.T)], axis=1).astype(np.uint8)
        for part in ("train", "test"):
            pick = (body["part"] == part).to_numpy()
            if pick.any():
                t = body["t"].to_numpy(np.int64)[pick]
                out.append((*(body[k].iloc[0] for k in keys), part, int(t.min()), len(t), x[pick].tobytes(), body["y"].to_numpy(float)[pick].tobytes(), t.tobytes()))
        return pd.DataFrame(out, columns=[*keys, "part", "first", "rows", "x", "y", "t"])

    return behind_weights(rows.select(*keys, "block", "part", "t", "y", *features), edges, keys, pack,
                          f"{fields}, part string, first long, rows long, x binary, y binary, t binary")


def unpacked(row, width: int):
    return np.frombuffer(row.x, np.uint8).reshape(-1, width), np.frombuffer(row.y), np.frombuffer(row.t, np.int64)


def forecasts_from(pieces: DataFrame, by, keys, width: int, fit, schema: str, least: int = 1) -> DataFrame:
    """In each group of ``by`` (train pieces first, at most ``LOCAL`` rows) a model is fitted by
    ``fit(key, x, y, t)`` and then applied to the test rows, up to ``LOCAL`` at once."""
    by = list(by)
    # a stated number of partitions: the pieces are small but the work on them is not
    tasks = max(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), least)
    dealt = pieces.repartition(tasks, *by).sortWithinPartitions(*by, F.desc("part"), "first")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, train, test, held, model = None, [], [], 0, None

        def forecast():
            nonlocal train, test, held, model
            if model is None and train and test:
                model, train = fit(key, *(np.concatenate(c) for c in zip(*train))), []
            if model is not None and test:
                found, at = model(np.concatenate([x for x, _, _ in test])), 0
                for _, y, t in test:
                    at += len(t)
                    yield pd.DataFrame({**{k: v for k, v in zip(by, key) if k in keys}, "t": t, "y_true": y, "y_pred": found[at - len(t):at]})
            test, held = [], 0

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                now = tuple(getattr(row, k) for k in by)
                if now != key or held >= LOCAL:
                    yield from forecast()
                if now != key:
                    key, train, model = now, [], None
                piece = unpacked(row, width)
                if row.part == "train":
                    train.append(piece)
                else:
                    test.append(piece)
                    held += len(piece[1])
        yield from forecast()

    return dealt.mapInPandas(run, schema)


# ---- nodes above LOCAL: a pass per level -----------------------------------------------

def met(pieces: DataFrame, models: DataFrame, keys) -> DataFrame:
    """Each piece with the model of its series, which is copied so that no series is one task."""
    return spread_join(pieces, models.select(*keys, "model"), keys, "first")


def key_fields(df: DataFrame, keys) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in keys)


def blank_models(pieces: DataFrame, keys, trees: int) -> DataFrame:
    """keys, model, open: a root per tree for every series of ``pieces``."""
    roots = np.zeros((trees, 6))
    roots[:, TREE], roots[:, FEATURE], roots[:, LEFT], roots[:, STATE] = np.arange(trees), -1, -1, OPEN
    return pieces.select(*keys).distinct().select(*keys, F.lit(bytearray(roots.tobytes())).alias("model"), F.lit(trees).alias("open"))


def model_of(raw) -> np.ndarray:
    return np.frombuffer(raw).reshape(-1, 6)


def reached(model: np.ndarray, tree: int, x: np.ndarray) -> np.ndarray:
    """Node of the model that each row is in, in one of its trees."""
    at, todo = np.full(len(x), tree), np.arange(len(x))
    while len(todo):
        todo = todo[model[at[todo], STATE] == SPLIT]
        here = at[todo]
        at[todo] = model[here, LEFT].astype(int) + (x[todo, model[here, FEATURE].astype(int)] > model[here, BIN])
    return at


def level(train: DataFrame, models: DataFrame, keys, width: int, weigh, penalty: float, small: int, last: bool) -> DataFrame:
    """Give every open node its value and split it, unless this is the last level.  Nodes of at
    most ``small`` rows become SMALL, to be finished by a task; those without a gain LEAF."""
    keys, names = list(keys), key_fields(models, keys)

    def sums(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                model = model_of(row.model)
                x, y, t = unpacked(row, width)
                slot = np.arange(width) * BINS + x
                for tree in range(int(model[:, TREE].max()) + 1):
                    at, w = reached(model, tree, x), weigh(t, tree)
                    for node in np.unique(at[(model[at, STATE] == OPEN) & (w > 0)]):
                        pick = at == node
                        flat, wp, yp = slot[pick].ravel(), np.repeat(w[pick], width), np.repeat((w * y)[pick], width)
                        hist = np.concatenate([np.bincount(flat, wp, width * BINS), np.bincount(flat, yp, width * BINS),
                                               [(w[pick] > 0).sum(), (w * y * y)[pick].sum()]])
                        yield pd.DataFrame({**{k: [getattr(row, k)] for k in keys}, "node": [int(node)], "n": [0], "sums": [hist]})

    def best(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                h = np.asarray(row.sums)
                w, s = h[:-2].reshape(2, width, BINS)
                cw, cs = w.cumsum(axis=1), s.cumsum(axis=1)
                gain = gains(cw, cs, cw[:, -1:], cs[:, -1:], penalty)
                tops = gain.max(axis=1)
                f = int(np.argmax(tops >= tops.max() - TIE * abs(tops.max())))
                b = int(np.argmax(gain[f] >= tops[f] - TIE * abs(tops[f])))
                state = SMALL if h[-2] <= small else SPLIT if gain[f, b] > LEAST_GAIN * h[-1] and not last else LEAF
                out.append((*(getattr(row, k) for k in keys), row.node, float(f), float(b), float(cs[0, -1] / (cw[0, -1] + penalty)), state))
            yield pd.DataFrame(out, columns=[*keys, "node", "feature", "bin", "value", "state"])

    @F.pandas_udf("model binary, open int")
    def updated(old: pd.Series, found: pd.Series) -> pd.DataFrame:
        out = []
        for raw, rows in zip(old, found):
            m, new = model_of(raw).copy(), []
            m[m[:, STATE] == OPEN, STATE] = LEAF  # a node that no row reached
            for r in sorted(rows if rows is not None else [], key=lambda r: r["node"]):
                node = r["node"]
                m[node, VALUE], m[node, STATE] = r["value"], r["state"]
                if r["state"] == SPLIT:
                    m[node, [FEATURE, BIN, LEFT]] = r["feature"], r["bin"], len(m) + len(new)
                    new += [[m[node, TREE], -1, 0, -1, r["value"], OPEN]] * 2
            out.append((np.r_[m, np.array(new).reshape(-1, 6)].tobytes(), len(new)))
        return pd.DataFrame(out, columns=["model", "open"])

    partial = met(train, models, keys).mapInPandas(sums, f"{names}, node long, n long, sums array<double>")
    splits = add_up(partial, [*keys, "node"]).mapInPandas(best, f"{names}, node long, feature double, bin double, value double, state double")
    found = splits.groupBy(*keys).agg(F.collect_list(F.struct("node", "feature", "bin", "value", "state")).alias("found"))
    step = models.join(found, keys, "left").select(*keys, updated("model", "found").alias("u"))
    return durable(step.select(*keys, "u.model", "u.open"))


def large_forest(pieces: DataFrame, keys, width: int, trees: int, seed: int) -> DataFrame:
    """Sums of tree forecasts per test row of series above ``LOCAL``."""
    keys, names, small = list(keys), key_fields(pieces, keys), LOCAL
    weigh = lambda t, tree: weights_of("forest", t, tree, seed, 1.0)
    models = blank_models(pieces, keys, trees)
    train = pieces.where("part = 'train'")
    while models.agg(F.max("open")).first()[0]:
        models = level(train, models, keys, width, weigh, 0.0, small, False)

    def routed(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                model, head = model_of(row.model), {k: [getattr(row, k)] for k in keys}
                x, y, t = unpacked(row, width)
                for tree in range(trees):
                    at = reached(model, tree, x)
                    for node in np.unique(at):
                        pick = at == node
                        if row.part == "train":
                            pick &= weigh(t, tree) > 0
                        leaf = model[node, STATE] == LEAF
                        if pick.any() and not (leaf and row.part == "train"):
                            yield pd.DataFrame({**head, "node": [int(node)], "tree": [tree], "part": ["leaf" if leaf else row.part], "first": [int(t[pick].min())],
                                                "value": [model[node, VALUE]], "x": [x[pick].tobytes()], "y": [y[pick].tobytes()], "t": [t[pick].tobytes()]})

    placed = durable(met(pieces, models, keys).mapInPandas(
        routed, f"{names}, node long, tree int, part string, first long, value double, x binary, y binary, t binary"))

    def finished(key, x, y, t):
        return lambda test: forest_sums(x, y, t, [key[-1]], seed, test)

    def known(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                _, y, t = unpacked(row, width)
                yield pd.DataFrame({**{k: getattr(row, k) for k in keys}, "t": t, "y_true": y, "y_pred": row.value})

    schema = f"{names}, t long, y_true double, y_pred double"
    grown = forecasts_from(placed.where("part <> 'leaf'").drop("value"), [*keys, "node", "tree"], keys, width, finished, schema)
    return grown.unionByName(placed.where("part = 'leaf'").mapInPandas(known, schema))


def level_sums(pieces, now: dict, width: int) -> Iterator[tuple]:
    """(series, per open node: weights and weighted rests by feature and bin, rows, squares) of a task's train pieces."""
    held = {}
    for key, train, x, rest, t, y, on in pieces:
        tree, start = now.get(key, (LONE, 0))
        if not train or start == len(tree):
            continue
        at = landed(tree, x) - start
        pick = on & (at >= 0)
        at, r, xs, m = at[pick], rest[pick], x[pick], len(tree) - start
        slots = [at * BINS + xs[:, f] for f in range(width)]
        hist = np.concatenate([np.stack([np.bincount(s, v, m * BINS).reshape(m, BINS) for v in (None, r) for s in slots], 1).reshape(m, -1),
                               np.bincount(at, r * r, m)[:, None]], 1)
        held[key] = held[key] + hist if key in held else hist
    return iter(held.items())


def level_splits(hist: np.ndarray, width: int, penalty: float) -> list[tuple]:
    """Per node: its value, and (feature, bin, value on the left, on the right) or None."""
    out = []
    for h in hist:
        w, s = h[:-1].reshape(2, width, BINS)
        cw, cs = w.cumsum(axis=1), s.cumsum(axis=1)
        tw, ts = cw[0, -1], cs[0, -1]
        gain = gains(cw, cs, cw[:, -1:], cs[:, -1:], penalty)
        tops = gain.max(axis=1)
        f = int(np.argmax(tops >= tops.max() - TIE * abs(tops.max())))
        b = int(np.argmax(gain[f] >= tops[f] - TIE * abs(tops[f])))
        split = gain[f, b] > LEAST_GAIN * h[-1]
        # the children's values are known from this pass, so leaves need none of their own
        out.append((ts / (tw + penalty), (f, b, cs[f, b] / (cw[f, b] + penalty), (ts - cs[f, b]) / (tw - cw[f, b] + penalty)) if split else None))
    return out


def tree_of_each(state, width: int, depth: int, penalty: float, tasks: int) -> dict:
    """A tree for every series of the pieces: one job a level, of which a split per node comes back."""
    now = {}
    for _ in range(depth):
        found = (state.mapPartitions(lambda pieces, now=now: level_sums(pieces, now, width)).reduceByKey(np.add, tasks)
                 .mapValues(lambda h: level_splits(h, width, penalty)).collect())
        for key, nodes in found:
            tree, start = now.get(key, (LONE, 0))
            rows, new = tree.copy(), []
            for i, (value, split) in enumerate(nodes, start):
                rows[i, 3] = value
                if split:
                    f, b, low, high = split
                    rows[i, :3] = f, b, len(tree) + len(new)
                    new += [[-1, 0, -1, low], [-1, 0, -1, high]]
            now[key] = (np.r_[rows, np.array(new, float).reshape(-1, 4)], len(tree))
        if all(start == len(tree) for tree, start in now.values()):
            break
    return {key: tree for key, (tree, _) in now.items()}


def large_boosting(pieces: DataFrame, keys, width: int, seed: int, rounds: int, depth: int, rate: float, share: float, penalty: float) -> DataFrame:
    """Forecasts of series above ``BOOSTED``.  What is left to explain stays cached on the executors, a level of
    all series is one small job, and the driver sees one tree a series at a time."""
    keys, names = list(keys), key_fields(pieces, keys)
    spark = pieces.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(checkpoint_folder(spark))
    rows = pieces.agg(F.sum("rows")).first()[0]
    tasks = max(context.defaultParallelism, -(-rows // PIECES))

    def read(row):
        x, y, t = unpacked(row, width)
        return tuple(row[k] for k in keys), row.part == "train", x, y, t

    def total(part):
        held = {}
        for key, train, x, y, t in part:
            if train:
                s, c = held.get(key, (0.0, 0))
                held[key] = s + y.sum(), c + len(y)
        return iter(held.items())

    def drawn(t, i):
        return weights_of("boosting", t, i, seed, share) > 0

    raw = pieces.select(*keys, "part", "x", "y", "t").repartition(tasks).rdd.map(read).persist(StorageLevel.MEMORY_AND_DISK)
    base = {k: s / c for k, (s, c) in raw.mapPartitions(total).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1])).collect()}

    def begin(piece):
        key, train, x, y, t = piece
        return (key, True, x, y - base[key], t, None, drawn(t, 0)) if train else (key, False, x, np.full(len(t), base[key]), t, y, None)

    held, state = raw, raw.map(begin).persist(StorageLevel.MEMORY_AND_DISK)
    for i in range(rounds):
        trees = tree_of_each(state, width, depth, penalty, tasks)
        held.unpersist()

        def step(piece, trees=trees, i=i):
            key, train, x, rest, t, y, _ = piece
            moved = rate * walk(trees[key], x)
            return (key, True, x, rest - moved, t, None, drawn(t, i + 1)) if train else (key, False, x, rest + moved, t, y, None)

        held, state = state, state.map(step).persist(StorageLevel.MEMORY_AND_DISK)
        if i % LINEAGE == LINEAGE - 1:
            state.checkpoint()  # stored by the next round's first job

    def known(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                yield pd.DataFrame({**{k: getattr(row, k) for k in keys}, "t": np.frombuffer(row.t, np.int64), "y_true": np.frombuffer(row.y),
                                    "y_pred": np.frombuffer(row.p)})

    ready = state.filter(lambda piece: not piece[1]).map(lambda p: (*p[0], p[4].tobytes(), p[5].tobytes(), p[3].tobytes()))
    out = durable(spark.createDataFrame(ready, f"{names}, t binary, y binary, p binary", verifySchema=False))
    held.unpersist(), state.unpersist()
    return out.mapInPandas(known, f"{names}, t long, y_true double, y_pred double")


# ---- forecasts -------------------------------------------------------------------------

def by_size(rows: DataFrame, features, keys, most: int) -> tuple[DataFrame, DataFrame, bool]:
    """Packed pieces of the series with at most ``most`` train rows, of the others, and whether there are others."""
    pieces = durable(packed(rows, features, keys))
    sizes = pieces.where("part = 'train'").groupBy(*keys).agg(F.sum("rows").alias("size"))
    large = sizes.where(F.col("size") > most).drop("size")
    any_large = bool(large.limit(1).count())
    return pieces.join(large, list(keys), "left_anti"), pieces.join(large, list(keys), "left_semi"), any_large


def forest_forecasts(rows: DataFrame, features, keys=KEYS, trees: int = 200, seed: int = 0) -> DataFrame:
    """keys, t, y_true, y_pred: the mean of ``trees`` trees of unlimited depth, each on a Poisson
    draw of the series' train rows."""
    keys, width, names = list(keys), len(list(features)), key_fields(rows, keys)
    small, large, any_large = by_size(rows, features, keys, LOCAL)

    def fit(key, x, y, t):
        numbers = range(key[-1] * GROUP, min(trees, (key[-1] + 1) * GROUP))
        return lambda test: forest_sums(x, y, t, numbers, seed, test)

    count = -(-trees // GROUP)
    groups = small.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    sums = forecasts_from(groups, [*keys, "group"], keys, width, fit, f"{names}, t long, y_true double, y_pred double", SPREAD * count)
    if any_large:
        sums = sums.unionByName(large_forest(large, keys, width, trees, seed))
    return sums.groupBy(*keys, "t").agg(F.first("y_true").alias("y_true"), (F.sum("y_pred") / trees).alias("y_pred"))


def boosted_forecasts(rows: DataFrame, features, keys=KEYS, rounds: int = 300, depth: int = 4, rate: float = 0.1, share: float = 0.9,
                      penalty: float = 1.0, seed: int = 0) -> DataFrame:
    """keys, t, y_true, y_pred: ``rounds`` trees of ``depth`` levels, each on a ``share`` of the rows."""
    keys, width, names = list(keys), len(list(features)), key_fields(rows, keys)
    small, large, any_large = by_size(rows, features, keys, min(LOCAL, BOOSTED))

    def fit(key, x, y, t):
        base, trees = boost(x, y, t, seed, rounds, depth, rate, share, penalty)
        return lambda test: base + rate * sum((walk(tree, test) for tree in trees), np.zeros(len(test)))

    out = forecasts_from(small, keys, keys, width, fit, f"{names}, t long, y_true double, y_pred double")
    if any_large:
        out = out.unionByName(large_boosting(large, keys, width, seed, rounds, depth, rate, share, penalty))
    return out
