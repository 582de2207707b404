"""The masked language model: gradients, held-out accuracy, odd rows."""

import random

import numpy as np

from foretally.llm import masked_lm as lm

SCHEMA = "doc_id long, text string, slice int"


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    weights = rng.normal(0, 0.3, (lm.ROWS, lm.WIDTH))
    context, token, _ = lm.examples(["one two three four five six", "seven eight", "nine"])
    net = lm.Network(weights)
    moves = {}

    class Probe(lm.Trainer):
        def move(self, rows, gradient, times):
            moves.update({int(r): g for r, g in zip(rows, gradient)})

    probe = Probe(weights)
    probe.step(context, token)
    loss = lambda: -net.log_probability(context, token).mean()
    for row in rng.permutation(sorted(moves))[:40]:
        k = rng.integers(lm.WIDTH)
        old, eps = weights[row, k], 1e-5
        weights[row, k] = old + eps
        up = loss()
        weights[row, k] = old - eps
        down = loss()
        weights[row, k] = old
        assert abs((up - down) / (2 * eps) - moves[row][k]) < 1e-6


def test_only_steep_logits_are_shifted():
    """Tame rows need no pass for their maximum; steep ones neither overflow nor vanish."""
    context, token, _ = lm.examples(["one two three four five six seven", "eight nine"])
    upper = lm.split(token)[0]
    for scale in (1.0, 3000.0):
        net = lm.Network((lm.initial_weights() * np.float32(scale)))
        one, two = net.hidden(context, upper)
        plain = [one.astype(float) @ net.upper.T + net.upper_bias, two.astype(float) @ net.lower.T + net.lower_bias[upper]]
        steep = max(np.abs(z).max() for z in plain) > lm.STEEP
        assert steep == (scale > 1)
        for got, z in zip(net.logits(one, two, upper), plain):
            np.testing.assert_allclose(got, z - z.max(axis=1, keepdims=True) if steep else z, rtol=1e-4, atol=1e-3 if steep else 1e-6)
        want = sum(z[range(token.size), half] - np.logaddexp.reduce(z, axis=1) for z, half in zip(plain, np.divmod(token, lm.HALF)))
        np.testing.assert_allclose(net.log_probability(context, token), want, rtol=1e-5, atol=1e-4)


def sentence(rng, n):
    """Each word decides the next one nine times out of ten."""
    words = ["w0"]
    for _ in range(n):
        words.append(f"w{(7 * int(words[-1][1:]) + 3) % 23 if rng.random() < 0.9 else rng.randrange(23)}")
    return " ".join(words)


def test_held_out_text_is_predicted_better_than_by_frequency(spark, monkeypatch):
    monkeypatch.setattr(lm, "BATCH", 64)  # few words here, so smaller steps
    rng = random.Random(8)
    docs = [(i, sentence(rng, 200), 1) for i in range(300)]
    weights = lm.train(spark.createDataFrame(docs, SCHEMA).repartition(2))
    held_out = [(i, sentence(rng, 200), 1) for i in range(20)]
    shuffled = [(i, " ".join(rng.sample(t.split(), len(t.split()))), 1) for i, t, _ in held_out]
    score = lambda rows: np.mean([r["mean_score"] for r in lm.pseudo_likelihood(spark.createDataFrame(rows, SCHEMA), weights).collect()])
    assert score(held_out) > -np.log(23) + 1 and score(shuffled) < score(held_out) - 1


def test_scores_are_sums_of_conditionals_and_odd_rows(spark):
    rows = [(1, "alpha beta gamma", 1), (1, "alpha beta gamma", 1), (2, None, None), (None, "", 1), (3, ".,", 1), (4, "word " * 100000, 1), (5, "solo", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    weights = lm.train(docs)
    got = sorted(map(tuple, lm.pseudo_likelihood(docs, weights).collect()), key=str)
    net, want = lm.Network(weights), []
    for doc, text, _ in rows:
        context, token, _ = lm.examples([text or ""])
        total = sum(net.log_probability(context[i:i + 1], token[i:i + 1])[0] for i in range(min(token.size, 3)))
        want.append((doc, token.size, total))
    for (doc, n, score, mean), (d, m, s) in zip(got, sorted(want, key=str)):
        assert (doc, n) == (d, m) and (n > 3 or abs(score - s) < 1e-4) and (mean is None) == (n == 0)
    assert lm.pseudo_likelihood(spark.createDataFrame([], SCHEMA)).count() == 0


def test_words_of_one_class_are_told_apart(spark, monkeypatch):
    """Made-up words that share a frequent word's hash class score lower than that word, and
    plausible spellings better than others; the same on both ways to the vocabulary."""
    of = lambda w: int(lm.examples([w])[1][0])
    made = next(w for w in (f"zq{i}xj" for i in range(10**6)) if of(w) == of("river"))
    rows = [(i, "down by the river we go", 1) for i in range(50)] + [(100, f"down by the {made} we go", 1), (101, "down by the river we go", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    score = lambda: {r["doc_id"]: r["score"] for r in lm.pseudo_likelihood(docs).collect()}
    got = score()
    assert got[100] < got[101] - 5
    monkeypatch.setattr(lm, "HEAD", 2)  # most words by the join
    again = score()
    assert all(abs(got[k] - again[k]) < 0.5 for k in got)


def test_vocabulary_counts_all_words_and_classes_add_up(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.6)) % 20000}" for _ in range(300)), 1) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    monkeypatch.setattr(lm, "COUNTED", 100)
    want = {}
    for _, text, _ in rows:
        for w in text.split():
            want[w] = want.get(w, 0) + 1
    counted = lm.word_counts(docs).collect()
    assert {bytes(r["word"]).decode(): r["c"] for r in counted} == want
    monkeypatch.setattr(lm, "HEAD", 50)
    head, tail = lm.vocabulary(docs)
    often = {w for w, c in want.items() if c >= lm.RARE}
    assert 0 < head.hashes.size <= 50 and head.hashes.size + tail.count() == len(often)
    late = {r["hash"]: r["log_c"] for r in tail.collect()}
    sums = np.zeros(lm.TOKENS)
    for w in want:
        hashes, owner = lm.word_hashes([w])
        token = lm.placed(hashes, owner)[1]
        (inside,), (value,), (share,) = lm.in_class([w], hashes.view(np.int64), token, head)
        key = int(hashes.view(np.int64)[0])
        p = np.exp(value if inside else late[key] + share if key in late else value)
        assert w not in often or abs(p - want[w] / np.exp(head.total[token[0]])) < 1e-9
        sums[token[0]] += p
    assert sums.max() <= 1 + 1e-9


def test_laid_out_batches_add_up_the_rows_of_their_words(monkeypatch):
    """Every word is in one batch, and the sums of a batch are those of plain additions."""
    monkeypatch.setattr(lm, "BATCH", 64)
    monkeypatch.setattr(lm, "GROUP", 3)
    rng = np.random.default_rng(5)
    for texts in (["same " * 150, "other words here"], [sentence(random.Random(2), 700), "one two"], ["alone"], [""]):
        context, token, _ = lm.examples(texts)
        order, seen = rng.permutation(token.size), []
        for i, plan in enumerate(lm.plans(context, token, order)):
            some = order[i * 64:i * 64 + 64]
            words = lambda c, t: sorted(zip(t.tolist(), c.tolist()))
            assert words(plan.context, plan.upper * lm.HALF + plan.lower) == words(context[some], token[some])
            values = np.zeros((lm.BATCH + 1, 3))
            values[:some.size] = rng.normal(size=(some.size, 3))
            want, times = np.zeros((lm.ROWS, 3)), np.bincount(plan.context.ravel(), minlength=lm.ROWS)
            np.add.at(want, plan.context.ravel(), np.repeat(values[:some.size], len(lm.PLACES), axis=0))
            got = values[plan.first]
            for rows, places in plan.again:
                got[rows] = values[places].sum(axis=0)
            assert plan.rows.tolist() == np.flatnonzero(times).tolist() and plan.times.tolist() == times[plan.rows].tolist()
            np.testing.assert_allclose(got, want[plan.rows], atol=1e-12)
            halves = np.bincount(plan.upper, minlength=lm.HALF)
            assert plan.upper[plan.heads].tolist() == np.flatnonzero(halves).tolist() and plan.halves.tolist() == halves[halves > 0].tolist()
            seen += some.tolist()
        assert sorted(seen) == list(range(token.size))
