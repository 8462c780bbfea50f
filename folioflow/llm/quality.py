"""Quality rules by line labelling: a linear-chain conditional random field marks lines as content or boilerplate.

Labels are known for whole texts alone. The lines of good texts are content; those of bad texts are latent: a bad text
holds boilerplate, but may hold content besides. Training goes from a first guess by the lines themselves to labels of
the best chains and back (hard expectation-maximisation), so that the field's moves are learned from texts whose lines
differ. Equal lines and windows within a text are told by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.arrow import BYTE_BASE, append_columns, as_bytes, in_runs, joined, span_hashes, spans, window_hashes

FIELDS = T.StructType(
    [T.StructField(k, T.LongType()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("content_share", T.DoubleType())]
)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, np.int64)
    for a, b in ranges:
        out[a:b] = 1
    return out


_DIGIT, _UPPER, _LOWER = _class((0x30, 0x3A)), _class((0x41, 0x5B)), _class((0x61, 0x7B), (0x80, 0x100))
_MARK = _class((0x21, 0x30), (0x3A, 0x41), (0x5B, 0x61), (0x7B, 0x7F))
_CHAR = 1 - _class((0x80, 0xC0))
N_FEATURES = 14


class Texts:
    """Words, lines and counts of some texts. A line is what \\n parts; the lines here are those with a word."""

    def __init__(self, texts: list[bytes]):
        buf, at = joined(texts)
        n = len(texts)
        word = ~_SPACE[buf]
        starts, ends = spans(word)
        self.n = n
        self.first_word = np.searchsorted(starts, at)
        self.n_words = np.diff(self.first_word)
        per_doc = lambda x: np.add.reduceat(np.append(x, 0), at[:-1] - 1) if n else x
        self.word_chars = per_doc(_CHAR[buf] * word)
        self.n_symbols = per_doc(_SYMBOL[buf].astype(np.int64))

        hashes = span_hashes(buf, starts, ends, BYTE_BASE)
        doc_of = np.repeat(np.arange(n), self.n_words)
        window = window_hashes(hashes, 8)
        inside = np.flatnonzero(np.arange(8, len(hashes) + 1) <= self.first_word[doc_of[: len(window)] + 1])
        self.n_repeat_words = self._repeated(window[inside], inside, doc_of, len(hashes))

        breaks = np.flatnonzero(buf == 10)
        a, b = breaks[:-1] + 1, breaks[1:]
        first, past = np.searchsorted(starts, a), np.searchsorted(starts, b)
        some = past > first
        a, b, first, past = a[some], b[some], first[some], past[some]
        self.line_doc = np.searchsorted(at, a, "right") - 1
        same = span_hashes(buf, a, b, BYTE_BASE)
        order = np.lexsort((same, self.line_doc))
        again = np.zeros(len(a), bool)
        again[order[1:]] = (same[order[1:]] == same[order[:-1]]) & (self.line_doc[order[1:]] == self.line_doc[order[:-1]])
        self.n_dup_lines = np.bincount(self.line_doc[again], minlength=n)
        self.line_chars, self.features = self._lines(buf, word, hashes, a, b, first, past, again)

    def _repeated(self, window: np.ndarray, place: np.ndarray, doc_of: np.ndarray, n_words: int) -> np.ndarray:
        """Words of each text in windows that it has twice or more."""
        doc = doc_of[place]
        order = np.argsort(window, kind="stable")  # places of a hash stay in order, so those of one text are next to each other
        h, d = window[order], doc[order]
        pair = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
        twice = np.zeros(len(window), bool)
        twice[order[1:][pair]] = twice[order[:-1][pair]] = True
        edge = np.zeros(n_words + 1, np.int64)
        np.add.at(edge, place[twice], 1)
        np.add.at(edge, place[twice] + 8, -1)
        return np.bincount(doc_of[np.cumsum(edge[:-1]) > 0], minlength=self.n)

    def _lines(self, buf, word, hashes, a, b, first, past, again) -> tuple[np.ndarray, np.ndarray]:
        """Code points in the words of each line, and the features of each line."""
        if not len(a):
            return np.zeros(0), np.zeros((0, N_FEATURES), np.float32)

        def per_line(x: np.ndarray) -> np.ndarray:
            total = np.append(0, np.cumsum(x))
            return (total[b] - total[a]).astype(np.float64)

        chars, words = per_line(_CHAR[buf] * word), (past - first).astype(np.float64)
        new = np.ones(len(hashes), np.int64)
        new[1:] = hashes[1:] != hashes[:-1]
        runs = np.append(0, np.cumsum(new))
        marks, upper, lower = per_line(_MARK[buf]), per_line(_UPPER[buf]), per_line(_LOWER[buf])
        bars, symbols = per_line((buf == 0x7C).astype(np.int64)), per_line(_SYMBOL[buf].astype(np.int64))
        last = np.isin(buf[b - 1], np.frombuffer(b".!?:;\"'", np.uint8))
        x = np.stack(
            [
                np.ones_like(chars), np.minimum(words, 20) / 20, words < 4, np.minimum(chars / words, 12) / 12, symbols / chars, symbols > 0.1 * words, marks / chars, marks > words,
                upper / (upper + lower + 1), upper > lower, per_line(_DIGIT[buf]) / chars, 1 - (runs[past] - runs[first]) / words, bars > 0.2 * words, again | ~last,
            ],
            axis=1,
        )
        return chars, x.astype(np.float32)


class Chains:
    """Lines of texts as chains; step t holds the t-th lines of all texts that have one, longest texts first."""

    def __init__(self, doc: np.ndarray):
        docs, first, n = np.unique(doc, return_index=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        self.first, self.n = first[order], n[order]
        self.active = np.searchsorted(-self.n, -np.arange(1, (self.n.max() if len(n) else 0) + 1), "right")

    def steps(self):
        return [self.first[:k] + t for t, k in enumerate(self.active)]


def viterbi(score: np.ndarray, move: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The best states of each chain; score has a row for each line, move[i, j] is that of state j after i. Ties: content (1)."""
    steps = Chains(doc).steps()
    back = np.zeros(score.shape, np.int8)
    best = np.zeros(score.shape)
    for t, own in enumerate(steps):
        if t == 0:
            best[own] = score[own]
            continue
        ways = best[own - 1][:, :, None] + move
        pick = (ways[:, 1] >= ways[:, 0]).astype(np.int8)
        back[own] = pick
        best[own] = np.maximum(ways[:, 0], ways[:, 1]) + score[own]
    out = np.zeros(len(score), np.int8)
    for t in range(len(steps) - 1, -1, -1):
        own = steps[t]
        ends = len(steps[t + 1]) if t + 1 < len(steps) else 0
        out[own[:ends]] = back[own[:ends] + 1, out[own[:ends] + 1]]
        out[own[ends:]] = best[own[ends:], 1] >= best[own[ends:], 0]
    return out


def fit(x: np.ndarray, doc: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.2, decay: float = 1e-3, chained: bool = True, begin: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and moves of greatest conditional likelihood, by gradient ascent over forward-backward marginals from begin on (or 0); without chained, moves stay as they are."""
    steps = Chains(doc).steps()
    w, move = (v.copy() for v in begin or (np.zeros(x.shape[1]), np.zeros((2, 2))))
    seen_move = np.zeros((2, 2))
    later = np.concatenate(steps[1:]) if len(steps) > 1 else np.zeros(0, np.int64)
    np.add.at(seen_move, (y[later - 1], y[later]), 1)
    means = [np.zeros_like(w), np.zeros_like(w), np.zeros((2, 2)), np.zeros((2, 2))]
    for k in range(1, rounds + 1):
        e = np.zeros((len(x), 2))
        e[:, 1] = x @ w
        e = np.exp(e - e.max(axis=1, keepdims=True))
        m = np.exp(move)
        f, b = np.ones((len(x), 2)), np.ones((len(x), 2))
        for t, own in enumerate(steps):
            f[own] = e[own] if t == 0 else (f[own - 1] @ m) * e[own]
            f[own] /= f[own].sum(axis=1, keepdims=True)
        for t in range(len(steps) - 2, -1, -1):
            own = steps[t + 1]
            b[own - 1] = (b[own] * e[own]) @ m.T
            b[own - 1] /= b[own - 1].sum(axis=1, keepdims=True)
        p = f * b
        p = p[:, 1] / p.sum(axis=1)
        pair = f[later - 1][:, :, None] * m * (b[later] * e[later])[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True) + 1e-300
        grads = [x.T @ (y - p) / len(x) - decay * w, (seen_move - pair.sum(axis=0)) / len(x) - decay * move]
        for i, (g, v) in enumerate(zip(grads, (w, move), strict=True)):
            a, s = means[2 * i], means[2 * i + 1]
            a += 0.1 * (g - a)
            s += 0.01 * (g * g - s)
            if v is w or chained:
                v += rate * (a / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)
    return w, move


def _scores(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), 2))
    out[:, 1] = x @ w
    return out


def label_lines(x: np.ndarray, doc: np.ndarray, good: np.ndarray, w: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best labels of the lines that the texts' labels allow: all of a good text's are 1; one of a bad text's, the least likely content, is 0 in any case."""
    score = _scores(x, w)
    y = viterbi(score, move, doc).astype(np.int64)
    y[good] = 1
    order = np.lexsort((score[:, 1], doc))
    first = order[np.append(True, doc[order[1:]] != doc[order[:-1]])]
    y[first[~good[first]]] = 0
    return y


def fit_latent(x: np.ndarray, doc: np.ndarray, good: np.ndarray, chars: np.ndarray, rounds: int = 3) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, moves and the least content share of a text that is kept; good marks the lines of good texts, chars weighs a line in the share.

    The share is the one that parts the good texts from the bad ones best (mean of both classes' accuracy), the middle
    one if many do.
    """
    w, move = fit(x, doc, good.astype(np.int64), rounds=100, chained=False)
    for _ in range(rounds):
        y = label_lines(x, doc, good, w, move)
        w, move = fit(x, doc, y, rounds=80, begin=(w, move))
    of = np.unique(doc, return_inverse=True)[1]
    part = np.bincount(of, chars * viterbi(_scores(x, w), move, doc)) / np.maximum(np.bincount(of, chars), 1)
    kind = np.bincount(of, good) > 0
    tried = np.arange(1, 100) / 100
    right = np.array([(part[kind] >= t).mean() + (part[~kind] < t).mean() for t in tried])
    best = tried[right == right.max()]
    return w, move, float(best[len(best) // 2])


def train(documents: DataFrame, labels: DataFrame, text: Column, key: str, label: str, bound: int = 2000, longest: int = 1000) -> tuple[np.ndarray, np.ndarray, float] | None:
    """The model from about bound labelled texts of each label (0 or 1), chosen by the hash of the key; None without both.

    Rows with a null key, label or text are left out, and texts of over longest lines with a word. The chosen texts'
    line features reach the driver; these two parameters bound their number.
    """
    rows = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).filter("key is not null and y in (0, 1)").distinct()
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return None
    share = F.when(F.col("y") == 1, min(1.0, bound / sizes[1])).otherwise(min(1.0, bound / sizes[0]))
    chosen = F.broadcast(rows.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 24)) < share * (1 << 24)))
    sample = documents.select(F.col(key).alias("key"), text.alias("text")).join(chosen, "key").select("text", "y")

    def features(batches):
        for b in batches:
            raw, y = as_bytes(b.column(0)), b.column(1).to_pylist()
            for i, j in in_runs(raw):
                t = Texts(raw[i:j])
                cut = np.searchsorted(t.line_doc, np.arange(t.n + 1))
                own = [(slice(cut[k], cut[k + 1]), y[i + k]) for k in range(t.n) if 0 < cut[k + 1] - cut[k] <= longest]
                made = [[t.features[k].tobytes() for k, _ in own], [t.line_chars[k].astype(np.float64).tobytes() for k, _ in own], [v for _, v in own]]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(made, (pa.binary(), pa.binary(), pa.int32()), strict=True)], names=["x", "chars", "y"])

    got = sorted((bytes(r["x"]), bytes(r["chars"]), r["y"]) for r in sample.mapInArrow(features, "x binary, chars binary, y int").collect())
    if len({r[2] for r in got}) < 2:
        return None
    parts = [np.frombuffer(r[0], np.float32).reshape(-1, N_FEATURES) for r in got]
    n = [len(p) for p in parts]
    chars = np.concatenate([np.frombuffer(r[1], np.float64) for r in got])
    return fit_latent(np.concatenate(parts).astype(np.float64), np.repeat(np.arange(len(n)), n), np.repeat([r[2] == 1 for r in got], n), chars)


def assess(df: DataFrame, text: Column, model: tuple[np.ndarray, np.ndarray, float] | None, share: float | None = None) -> DataFrame:
    """df with the base counts, base_failed, content_share and kept.

    content_share is the part of the words' characters in lines that the field marks as content; without a model it is
    1. A text is kept if the base rules hold and content_share is at least share (the model's, unless given). Null and
    empty texts have counts of 0 and fail the base rules. Each text is looked at whole, alone and once, so repeated rows get equal results.
    Columns of df with these names are replaced.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    def make():
        least = share if share is not None else held.value[2] if held.value is not None else 0.0

        def work(texts: pa.Array):
            raw = as_bytes(texts)
            out: list[list] = [[] for _ in FIELDS]
            for i, j in in_runs(raw):
                t = Texts(raw[i:j])
                part = np.ones(t.n)
                if held.value is not None and len(t.line_doc):
                    w, move, _ = held.value
                    state = viterbi(_scores(t.features, w), move, t.line_doc)
                    total = np.bincount(t.line_doc, t.line_chars, t.n)
                    part = np.bincount(t.line_doc, t.line_chars * state, t.n) / np.maximum(total, 1)
                failed = (t.n_words < 20) | (100 * t.n_repeat_words > 30 * t.n_words)
                for k, v in enumerate((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, ~failed & (part >= least), part)):
                    out[k].extend(v.tolist())
            return out

        return work

    return append_columns(df, make, FIELDS, {"text": text})
