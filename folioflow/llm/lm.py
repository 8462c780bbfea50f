"""Language-model scores of whole texts: smoothed word frequencies, and a gated recurrent model over them.

Tokens are the words of a text (A-Z lowered), then one end. Counts are taken over all training texts. Words in at
least the N / HEAD-th part of the N training tokens, of which there are at most HEAD, reach every task; the counts of
all others stay in Spark and meet the texts' rare words in a join.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm import gru
from folioflow.llm.arrow import BYTE_BASE, append_columns, as_bytes, in_runs, joined, span_hashes, spans, written
from folioflow.llm.neardup import _grouped
from folioflow.sources.shared import discard

HEAD, WORDS, CLASSES, STATE = 1 << 20, 4095, 64, 24
#: Tokens that a task learns from at once, unless a run of texts has more; a task's texts are never all in memory.
TOGETHER = 1 << 21
#: Tokens of a group of texts that are learned from one after another; of a unit by which groups are weighed.
GROUP, UNIT = 1 << 22, 1 << 10
#: Parts of 1 in which weights are added up; weights in a row.
FINE, BLOCK = 1 << 24, 512
#: The hash that stands for the end of a text.
END = np.uint64(0)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_LOWER[[9, 10, 11, 12, 13]] = 0x20


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, with each text's end, and where each text's tokens begin (and the end)."""
    buf, at = joined(texts)
    low = _LOWER[buf]
    starts, ends = spans(low != 0x20)
    words = span_hashes(low, starts, ends, BYTE_BASE)
    first = np.searchsorted(starts, at)
    return np.insert(words, first[1:], END), first + np.arange(len(first))


def count_tokens(df: DataFrame, text: Column) -> DataFrame:
    """(h, c): the count of each distinct token's hash over all texts; each batch sends a distinct token once."""

    def count(batches):
        for b in batches:
            parts, sums = [], []
            raw = as_bytes(b.column(0))
            for i, j in in_runs(raw):
                h, n = np.unique(_tokens(raw[i:j])[0], return_counts=True)
                parts.append(h)
                sums.append(n)
            if parts:
                h, where = np.unique(np.concatenate(parts), return_inverse=True)
                n = np.bincount(where, np.concatenate(sums), len(h)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    rows = df.select(F.coalesce(text, F.lit("")).alias("text"))
    return rows.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("c"))


class Vocabulary:
    """The frequent words: hashes in order with counts and symbols; sums for the groups."""

    def __init__(self, h: np.ndarray, c: np.ndarray, tokens: int, distinct: int):
        self.tokens, self.distinct = tokens, distinct
        some = h != END
        rank = np.lexsort((h[some], -c[some]))[:WORDS]
        top_h, top_c = np.append(h[some][rank], END), np.append(c[some][rank], c[~some].sum())
        falling = np.argsort(-top_c, kind="stable")
        self.top, self.counts = top_h[falling], top_c[falling]
        self.bounds = gru.class_bounds(self.counts, CLASSES)
        order = np.argsort(h)
        self.h, self.c = h[order], c[order]
        self.n_words = len(self.top)
        self.symbol = np.full(len(h), self.n_words, np.int64)
        at = np.argsort(self.top)
        place = np.minimum(np.searchsorted(self.top[at], self.h), self.n_words - 1)
        same = self.top[at][place] == self.h
        self.symbol[same] = at[place[same]]
        self.middle = int(c.sum() - self.counts.sum())
        self.rare = tokens - int(c.sum())
        #: log10 of what a rare word's count plus 1 is divided by: all counts, one for each and one for words never seen.
        self.rare_total = math.log10(self.rare + distinct - len(h) + 1)

    def symbols(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and count of each token; rare ones have the second group's and 0. Each distinct token is looked up once."""
        some, where = np.unique(tokens, return_inverse=True)
        symbol, count = np.full(len(some), self.n_words + 1), np.zeros(len(some), np.int64)
        if len(self.h):
            at = np.minimum(np.searchsorted(self.h, some), len(self.h) - 1)
            known = self.h[at] == some
            symbol[known], count[known] = self.symbol[at[known]], self.c[at[known]]
        symbol[(some == END) & (count == 0)] = int(np.flatnonzero(self.top == END)[0])
        return symbol[where].astype(np.int32), count[where]


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From the written counts; the end and at most HEAD words reach the driver."""
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"] or 0, total["v"]
    head = counts.filter((F.col("c") >= F.lit(n / HEAD)) | (F.col("h") == int(END))).toArrow()
    return Vocabulary(head.column("h").to_numpy().view(np.uint64), head.column("c").to_numpy(), n, v)


def train(df: DataFrame, text: Column, key: Column, vocab: Vocabulary, rounds: int = 2, rate: float = 0.1, group: int = GROUP) -> dict[str, np.ndarray]:
    """The recurrent model's weights, from all texts, each of which is learned from once.

    The texts are dealt over the rounds and, within a round, over groups of about group / rounds tokens by the hash of
    key and text. A group's texts are learned from in the order of their hashes, beginning with the round's weights; the
    mean of the groups' results, by tokens, starts the next round. So the weights depend on the rows alone, not on
    files, partitions or machines: the mean is taken of whole numbers, whose sum has no order. Groups are taken by
    tasks, a block of weights is a row of each task, and the driver gets a value for each weight.
    """
    weights = gru.start(vocab.counts, (vocab.middle, vocab.rare), vocab.bounds, STATE)
    context = df.sparkSession.sparkContext
    groups = max(1, -(-vocab.tokens // group))
    words = context.broadcast(vocab)
    raw = F.coalesce(text, F.lit(""))
    given = df.select(raw.alias("text"), F.xxhash64(key, raw).alias("h"))

    def encode(batches):
        for b in batches:
            out: list[bytes] = []
            texts = as_bytes(b.column(0))
            for i, j in in_runs(texts):
                tokens, first = _tokens(texts[i:j])
                symbols = words.value.symbols(tokens)[0].astype("<u2")
                out += [symbols[p:q].tobytes() for p, q in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(out, pa.binary())], names=["h", "symbols"])

    dealt = given.mapInArrow(encode, "h long, symbols binary")
    coded = written(dealt.withColumn("round", F.pmod("h", F.lit(rounds))).withColumn("grp", F.pmod(F.shiftright("h", 8), F.lit(groups))), "lm-symbols")
    for k in range(rounds):
        held = context.broadcast(weights)
        rows = coded.filter(F.col("round") == k).select("grp", "h", "symbols").repartition(min(groups, 10_000), "grp").sortWithinPartitions("grp", "h", "symbols")

        def learn(batches, held=held, k=k):
            total, n = None, 0
            for symbols, sizes in _group_runs(batches):
                learnt, moments = held.value, gru.Moments(held.value)
                for some, own in _cut(symbols, sizes):
                    learnt = gru.learn(learnt, words.value.bounds, some, own, rate / (1 + k), moments=moments)
                units = max(1, len(symbols) // UNIT)
                flat = np.rint(np.concatenate([learnt[x].ravel() for x in gru.NAMES]).astype(np.float64) * FINE).astype(np.int64) * units
                total, n = flat if total is None else total + flat, n + units
            if total is not None:
                cuts = range(0, len(total), BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(cuts)), pa.int64()), pa.array([n] * len(cuts), pa.int64()), pa.array([total[i : i + BLOCK] for i in cuts], pa.list_(pa.int64()))], names=["block", "n", "s"])

        def add(table: pa.Table) -> pa.Table:
            sums = np.sum([x for x in table["s"].to_numpy()], axis=0)
            return pa.table({"block": table["block"][:1], "n": pa.array([int(np.sum(table["n"].to_numpy()))]), "s": pa.array([sums], pa.list_(pa.int64()))})

        sums = rows.mapInArrow(learn, "block long, n long, s array<long>").groupBy("block").applyInArrow(add, "block long, n long, s array<long>").toArrow()
        if not sums.num_rows:  # no text in this round
            continue
        sums = sums.sort_by("block")
        flat = np.concatenate(sums["s"].to_numpy()) / (float(sums["n"][0].as_py()) * FINE)
        cuts = np.cumsum([weights[x].size for x in gru.NAMES])
        weights = {x: v.reshape(weights[x].shape).astype(np.float32) for x, v in zip(gru.NAMES, np.split(flat, cuts[:-1]), strict=True)}
    discard(coded)
    return weights


def _group_runs(batches):
    """The symbols and texts' sizes of each group; groups come one after another."""
    own, symbols, sizes = None, [], []
    for b in batches:
        for g, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if g != own and sizes:
                yield np.concatenate(symbols), np.array(sizes)
                symbols, sizes = [], []
            own = g
            symbols.append(np.frombuffer(x, "<u2"))
            sizes.append(len(x) // 2)
    if sizes:
        yield np.concatenate(symbols), np.array(sizes)


def _cut(symbols: np.ndarray, sizes: np.ndarray):
    """A group's texts in runs of about TOGETHER tokens."""
    past = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = past[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(past, before + TOGETHER, "right")))
        yield symbols[before : past[end - 1]].astype(np.int32), sizes[at:end]
        at = end


_PARTIAL = T.StructType(
    [T.StructField("n_tokens", T.LongType()), T.StructField("known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("model", T.DoubleType()), T.StructField("n_rare", T.LongType())]
    + [T.StructField("rare", T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("n", T.IntegerType())])))]
)


def score(df: DataFrame, text: Column, counts: DataFrame, vocab: Vocabulary, weights: dict[str, np.ndarray]) -> DataFrame:
    """df with n_tokens, n_known, base_score and score, both log10 of a probability.

    Each whole text is read once: frequent words are scored there, rare ones leave the task as hashes with their number
    in the text, meet their counts in a join and come back as a sum for each row. A null or empty text is its end
    alone. Repeated rows are scored each; columns of df with the names of results are replaced.
    """
    held = df.sparkSession.sparkContext.broadcast((vocab, weights))

    def make():
        words, w = held.value
        middle = math.log10(words.middle) if words.middle else 0.0

        def work(texts: pa.Array):
            raw = as_bytes(texts)
            out: list[list] = [[] for _ in range(5)]
            rare_h, rare_n, sizes, more = [], [], [], []
            symbols: list[np.ndarray] = []
            lengths: list[np.ndarray] = []
            for i, j in in_runs(raw):
                tokens, first = _tokens(raw[i:j])
                n = np.diff(first)
                doc = np.repeat(np.arange(j - i), n)
                symbol, count = words.symbols(tokens)
                symbols.append(symbol)
                lengths.append(n)
                if sum(map(len, symbols)) >= TOGETHER or j == len(raw):
                    out[3].append(gru.score(w, words.bounds, np.concatenate(symbols), np.concatenate(lengths)) / math.log(10))
                    symbols, lengths = [], []
                inner = symbol == words.n_words
                within = np.bincount(doc[inner], np.log10(np.maximum(count[inner], 1)) - middle, j - i)
                is_rare = symbol == words.n_words + 1
                base = np.bincount(doc, np.log10(count + 1.0), j - i)
                for k, v in ((0, n), (1, np.bincount(doc[count > 0], minlength=j - i)), (2, base), (4, np.bincount(doc[is_rare], minlength=j - i))):
                    out[k].append(v)
                more.append(within)
                d, h = doc[is_rare], tokens[is_rare]
                order, own = _grouped(d, h)
                if len(order):
                    edge = np.flatnonzero(np.append(True, (h[order[1:]] != h[order[:-1]]) | (d[order[1:]] != d[order[:-1]])))
                    rare_h.append(h[own]), rare_n.append(np.diff(np.append(edge, len(order))))
                sizes.append(np.bincount(d[own], minlength=j - i) if len(order) else np.zeros(j - i, np.int64))
            out[3] = [np.concatenate(out[3]) + np.concatenate(more)]
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate([*rare_h, np.zeros(0, np.uint64)]).view(np.int64)), pa.array(np.concatenate([*rare_n, np.zeros(0, np.int64)]).astype(np.int32))], names=["h", "n"])
            at = np.append(0, np.cumsum(np.concatenate(sizes))).astype(np.int32)
            return [*(np.concatenate(x) for x in out), pa.ListArray.from_arrays(pa.array(at), flat)]

        return work

    results = ("n_tokens", "n_known", "base_score", "score")
    given = df.select(text.alias("__text"), F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in results]).alias("__row"), F.monotonically_increasing_id().alias("__id"))
    part = written(append_columns(given, make, _PARTIAL, {"text": F.col("__text")}).drop("__text"), "lm-part")
    rare = part.select("__id", F.explode("rare").alias("r")).select("__id", F.col("r.h").alias("h"), F.col("r.n").alias("n"))
    known = counts.filter(F.col("c") < F.lit(vocab.tokens / HEAD))
    sums = rare.join(known, "h").groupBy("__id").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("s"), F.sum("n").alias("k"))
    both = part.drop("rare").join(sums, "__id", "left")
    s = F.coalesce("s", F.lit(0.0))
    return both.select(
        "__row.*",
        "n_tokens",
        (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        (F.col("base") + s - F.col("n_tokens") * F.lit(math.log10(vocab.tokens + vocab.distinct + 1))).alias("base_score"),
        (F.col("model") + s - F.col("n_rare") * F.lit(vocab.rare_total)).alias("score"),
    )
