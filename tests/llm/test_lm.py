"""Language-model scores against brute force, numeric gradients and held-out texts."""

import math
import re
import types
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from folioflow.llm import gru, lm, queries


def tokens(text: str | None) -> list[str | None]:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def brute(rows):
    train = [t for k, text in rows if zlib.crc32(str(k).encode()) % 7 != 2 for t in tokens(text)]
    c, n = Counter(train), len(train)
    out = {}
    for k, text in rows:
        own = tokens(text)
        out[k] = (zlib.crc32(str(k).encode()) % 7 == 2, len(own), sum(c[t] > 0 for t in own), n, sum(math.log10((c[t] + 1) / (n + len(c) + 1)) for t in own))
    return out


def check(rows, want):
    for r in rows:
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert math.isclose(r["base_score"], w[4], rel_tol=1e-9, abs_tol=1e-9)
        assert r["score"] <= 1e-9 and math.isfinite(r["score"])


def test_scores(spark, sf, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(rows)
    for head in (1 << 20, 300):  # with 300 nearly all words are rare and come through the join
        monkeypatch.setattr(lm, "HEAD", head)
        got = queries.op8_lm(spark, sf).collect()
        assert len(got) == len(rows)
        check(got, want)
        held = [r for r in got if r["held_out"]]
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_probabilities_sum_to_one():
    h = np.arange(1, 2001, dtype=np.uint64)
    c = np.arange(2000, 0, -1)
    vocab = lm.Vocabulary(np.append(h, lm.END), np.append(c, 500), int(c.sum()) + 500 + 90, 2001 + 30)
    w = gru.start(vocab.counts, (vocab.middle, vocab.rare), vocab.bounds, lm.STATE)
    w = gru.learn(w, vocab.bounds, *laid([np.random.default_rng(i).integers(0, vocab.n_words + 2, 40) for i in range(64)]), 0.01)
    before = np.array([3, 900, vocab.n_words + 1])
    symbols = np.arange(vocab.n_words + 2)
    whole = gru.score(w, vocab.bounds, *laid([np.append(before, s) for s in symbols])) - gru.score(w, vocab.bounds, *laid([before]))
    assert abs(np.exp(whole).sum() - 1) < 1e-3


def laid(texts):
    return np.concatenate(texts), np.array([len(x) for x in texts])


def plain_log_probability(w, bounds, text):
    """The natural log-probability of one text, a symbol at a time, by the definitions."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    size, words = len(w["wh"]), bounds[-1]
    h, last, total = np.zeros(size), len(w["emb"]) - 1, 0.0
    for s in text.tolist():
        gx, gh = w["emb"][last] @ w["wx"][:-1] + w["wx"][-1], h @ w["wh"]
        z, r = sigmoid(gx[:size] + gh[:size]), sigmoid(gx[size : 2 * size] + gh[size : 2 * size])
        new = np.tanh(gx[2 * size :] + r * gh[2 * size :])
        h = z * h + (1 - z) * new
        c = int(np.flatnonzero(bounds <= s)[-1]) if s < words else len(bounds) - 1 + s - words
        e = np.exp(h @ w["oc"][:-1] + w["oc"][-1])
        total += math.log(e[c] / e.sum())
        if s < words:
            own = slice(bounds[c], bounds[c + 1])
            e = np.exp(h @ w["ow"][:-1, own] + w["ow"][-1, own])
            total += math.log(e[s - bounds[c]] / e.sum())
        last = s
    return total


def test_score_is_that_of_the_plain_recurrence():
    rng = np.random.default_rng(3)
    counts = np.sort(rng.integers(1, 1000, 60))[::-1]
    bounds = gru.class_bounds(counts, 7)
    w = gru.start(counts, (40, 30), bounds, 8)
    texts = [rng.integers(0, 62, n) for n in (1, 2, 300, 5, 40, 41, 1, 17)]
    w = gru.learn(w, bounds, *laid(texts * 5), 0.02, lanes=3, steps=7)
    want = [plain_log_probability(w, bounds, x) for x in texts]
    for lanes, steps in ((1, 1000), (3, 16), (100, 1)):  # lanes and windows don't change a text's score
        np.testing.assert_allclose(gru.score(w, bounds, *laid(texts), lanes=lanes, steps=steps), want, rtol=1e-5)


def test_scores_of_the_table_are_those_of_the_plain_recurrence(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    counts = lm.count_tokens(docs, F.col("text")).cache()
    vocab = lm.vocabulary(counts)
    w = lm.train(docs, F.col("text"), F.col("doc_id"), vocab, rounds=1)
    own = Counter(t for r in docs.collect() for t in tokens(r["text"]))
    few = docs.filter("doc_id % 97 = 0 and length(text) < 3000")
    for r in lm.score(few, F.col("text"), counts, vocab, w).join(few, "doc_id").collect():
        hashes, _ = lm._tokens([(r["text"] or "").encode()])
        symbols = vocab.symbols(hashes)[0]
        want = plain_log_probability(w, vocab.bounds, symbols) / math.log(10)
        want += sum(math.log10(own[t] / vocab.middle) for t, s in zip(tokens(r["text"]), symbols, strict=True) if s == vocab.n_words)
        assert (symbols != vocab.n_words + 1).all() and math.isclose(r["score"], want, rel_tol=1e-4)


def test_gradients_are_those_of_the_loss():
    counts = np.array([9, 7, 5, 4, 3, 2, 1])
    bounds = gru.class_bounds(counts, 3)
    w = {k: v.astype(np.float64) for k, v in gru.start(counts, (3, 2), bounds, 4).items()}
    texts = laid([np.array([0, 3, 7, 8, 2]), np.array([6, 1]), np.array([5])])
    for lanes in (1, 2, 3):
        rows = gru.Lanes(*texts, len(w["emb"]) - 1, lanes)
        ((at, cuts),) = rows.windows(32)
        grads, total, _ = gru.gradients(w, bounds, rows, at, cuts, np.zeros((lanes, 4)))
        assert math.isclose(total, gru.score(w, bounds, *texts).sum())
        rng = np.random.default_rng(0)
        for k in gru.NAMES:
            for i in rng.choice(w[k].size, min(8, w[k].size), replace=False):
                up, down = ({**w, k: w[k].copy()} for _ in range(2))
                up[k].flat[i] += 1e-5
                down[k].flat[i] -= 1e-5
                g = -(gru.score(up, bounds, *texts).sum() - gru.score(down, bounds, *texts).sum()) / 2e-5
                assert math.isclose(grads[k].flat[i], g, rel_tol=1e-4, abs_tol=1e-6), k


def test_every_training_text_reaches_the_weights(spark, monkeypatch):
    rows = [(i, f"word{i % 50} and the next {i}") for i in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    vocab = lm.vocabulary(lm.count_tokens(df, F.col("text")))
    seen = spark.sparkContext.accumulator(0)

    def counted(w, bounds, symbols, sizes, *args, learn=gru.learn, **given):
        seen.add(len(sizes))
        return learn(w, bounds, symbols, sizes, *args, **given)

    monkeypatch.setattr(lm, "gru", types.SimpleNamespace(**{k: v for k, v in vars(gru).items() if not k.startswith("_")} | {"learn": counted}))
    for together in (1 << 20, 2000):
        monkeypatch.setattr(lm, "TOGETHER", together, raising=False)
        before = seen.value
        lm.train(df, F.col("text"), F.col("doc_id"), vocab)
        assert seen.value - before == len(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "The the THE"), (5, "É é " * 30000), (6, "new"), (6, "new"), (None, "words with no key")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    counts = lm.count_tokens(df, F.col("text"))
    vocab = lm.vocabulary(counts)
    w = lm.train(df, F.col("text"), F.col("doc_id"), vocab)
    got = lm.score(df, F.col("text"), counts, vocab, w).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 1, 1, 2, 2, 4, 5, 60001] and all(math.isfinite(r["score"]) for r in got)
    assert lm.score(df.limit(0), F.col("text"), counts, vocab, w).count() == 0
    none = lm.count_tokens(df.limit(0), F.col("text"))
    empty = lm.vocabulary(none)
    assert empty.tokens == 0
    assert len(lm.score(df, F.col("text"), none, empty, lm.train(df.limit(0), F.col("text"), F.col("doc_id"), empty)).collect()) == len(rows)


def test_scores_don_t_depend_on_files_or_partitions(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    found = []
    for parts in (1, 16):
        df = docs.repartition(parts, F.rand(parts))
        counts = lm.count_tokens(df, F.col("text"))
        vocab = lm.vocabulary(counts)
        weights = lm.train(df, F.col("text"), F.col("doc_id"), vocab, group=vocab.tokens // 5)
        found.append((weights, {r.doc_id: r.score for r in lm.score(df, F.col("text"), counts, vocab, weights).collect()}))
    (a, x), (b, y) = found
    assert all(np.array_equal(a[k], b[k]) for k in a)
    assert all(math.isclose(x[k], y[k], rel_tol=1e-5) for k in x)


def test_steps_numbers_lie_together_and_follow_the_definition():
    rng = np.random.default_rng(8)
    size, cuts, h = 5, [0, 4, 8, 11, 12], rng.normal(size=(4, 5))
    wh, gx, begins = rng.normal(size=(5, 15)), rng.normal(size=(12, 15)), np.array([1, 5, 6, 11])
    parted = gru._gates(gx)
    assert all(x.flags.c_contiguous for x in [*parted, *gru._gates(wh)])
    out, held = gru._forward(gru._gates(wh), parted, begins, cuts, h)
    assert all(x.flags.c_contiguous and x.shape == (12, size) for x in (out, *held))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    was = h
    for a, b in zip(cuts, cuts[1:]):
        was = was[: b - a] * ~np.isin(np.arange(a, b), begins)[:, None]
        x, y = gx[a:b], was @ wh
        z, r = sigmoid(x[:, :5] + y[:, :5]), sigmoid(x[:, 5:10] + y[:, 5:10])
        new = np.tanh(x[:, 10:] + r * y[:, 10:])
        was = z * was + (1 - z) * new
        np.testing.assert_allclose(out[a:b], was)
