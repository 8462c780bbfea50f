"""Language identification by multilingual mixture inference.

A document's words are drawn from a mixture of languages. Each language has a distribution over hashed character
trigrams (of UTF-8 bytes, with a word's borders), learned from labelled rows. Expectation-maximisation estimates each
document's language proportions from the words' trigram likelihoods, over nested sets of languages; the set with the
best likelihood less a penalty for each further language is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.arrow import append_columns, as_bytes, in_runs, joined

BUCKETS = 1 << 16
FIELDS = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("langs", T.ArrayType(T.StringType())),
        T.StructField("shares", T.ArrayType(T.DoubleType())),
    ]
)
_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)


def _trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of the trigram around each letter, the places among these where words begin, and each word's text."""
    buf, at = joined(texts)
    letters = _LETTER[buf]
    where = np.flatnonzero(letters != 0x20)
    wide = letters.astype(np.uint32)
    gram = (wide[:-2] << np.uint32(16) | wide[1:-1] << np.uint32(8) | wide[2:])[where - 1]
    bucket = (gram * np.uint32(2654435761)) >> np.uint32(16)
    begins = np.flatnonzero(np.diff(where, prepend=-2) > 1)
    return bucket.astype(np.int64), begins, np.searchsorted(at, where[begins], "right") - 1


def train(labelled: DataFrame, text: Column, lang: Column, key: Column, docs_per_lang: int = 3000, most_langs: int = 1000) -> tuple[list[str], np.ndarray]:
    """The languages in order and their log-probabilities of the buckets.

    Fitted on about docs_per_lang rows of each language (all where it has fewer), chosen by the hash of key; whole
    texts. Rows with a null text, language or key are left out. What reaches the driver is at most BUCKETS rows for
    each language, and over most_langs languages are an error: such labels need cleaning first.
    """
    rows = labelled.select(F.lower(text).alias("text"), lang.alias("lang"), key.cast("string").alias("key")).dropna()
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(most_langs + 1).collect()}
    if len(sizes) > most_langs:
        raise ValueError(f"over {most_langs} languages among the labels")
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((0, BUCKETS), np.float32)
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, docs_per_lang / sizes[k])))])
    sample = rows.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 24)) < F.element_at(share, F.col("lang")) * (1 << 24)).select("lang", "text")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            names, texts = b.column(0).to_pylist(), as_bytes(b.column(1))
            for name in set(names):
                own = [x for k, x in zip(names, texts, strict=True) if k == name]
                total = sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                for i, j in in_runs(own):
                    total += np.bincount(_trigrams(own[i:j])[0], minlength=BUCKETS)
        for name, total in sums.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some), pa.array(total[some])], names=["lang", "bucket", "n"])

    counts = sample.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((len(langs), BUCKETS), 0.5)
    at = {k: i for i, k in enumerate(langs)}
    table[np.array([at[x] for x in counts.column("lang").to_pylist()], np.int64), counts.column("bucket").to_numpy()] += counts.column("n").to_numpy()
    return langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def _em(like: np.ndarray, doc: np.ndarray, first: np.ndarray, n: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each document, for the allowed languages; like is scaled to a maximum of 1."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        part = share[doc] * like
        part /= part.sum(axis=1, keepdims=True) + 1e-30
        share = np.add.reduceat(part, first, axis=0) / n[:, None]
    whole = np.log((share[doc] * like).sum(axis=1) + 1e-30)
    return share, np.add.reduceat(whole, first)


def _mixtures(texts: list[bytes], table: np.ndarray, rounds: int, penalty: float) -> np.ndarray:
    """The proportions of each language in each text; 0 outside of its set and where it has no letter."""
    out = np.zeros((len(texts), len(table)), np.float32)
    bucket, begins, doc_of = _trigrams(texts)
    if not len(bucket):
        return out
    # trigrams overlap threefold, so a word's evidence is taken at a third
    like = np.stack([np.add.reduceat(row[bucket], begins) for row in table], axis=1) / 3
    like = np.exp(np.maximum(like - like.max(axis=1, keepdims=True), -40))
    docs, first = np.unique(doc_of, return_index=True)
    n = np.diff(np.append(first, len(doc_of))).astype(np.float32)
    doc = np.repeat(np.arange(len(docs)), n.astype(np.int64))
    alone = np.add.reduceat(np.log(like + 1e-30), first, axis=0)
    best = np.zeros((len(docs), len(table)), np.float32)
    best[np.arange(len(docs)), alone.argmax(axis=1)] = 1
    gain = alone.max(axis=1)
    if len(table) > 1:
        full, _ = _em(like, doc, first, n, np.ones_like(best), rounds)
        order = np.argsort(-full, axis=1, kind="stable")
        for k in range(2, len(table) + 1):
            allowed = np.zeros_like(best)
            np.put_along_axis(allowed, order[:, :k], 1, axis=1)
            share, fit = _em(like, doc, first, n, allowed, rounds)
            fit = fit - penalty * (k - 1) * np.log(n + 1)
            better = fit > gain
            best[better], gain = share[better], np.maximum(fit, gain)
    out[docs] = best
    return out


def identify(df: DataFrame, text: Column, langs: list[str], table: np.ndarray, rounds: int = 8, penalty: float = 2.0) -> DataFrame:
    """df with lang_pred (the largest proportion's language), score (that proportion), langs and shares (the set chosen).

    A null text or one without a letter has `und`, score 0 and empty lists; so has every text if no language was
    learned. Sets of every size up to all languages are tried. Equal proportions: the first in alphabetical order.
    Whole texts of any length count. Columns of df with these names are replaced; all others and repeated rows stay.
    """
    held = df.sparkSession.sparkContext.broadcast((langs, table))

    def make():
        names, weights = held.value

        def work(texts: pa.Array, lettered: pa.Array):
            raw, some = as_bytes(texts), lettered.to_numpy(zero_copy_only=False)
            raw = [x if y else b"" for x, y in zip(raw, some, strict=True)]
            pred, score, sets, parts = [], [], [], []
            for i, j in in_runs(raw):
                share = _mixtures(raw[i:j], weights, rounds, penalty) if names else np.zeros((j - i, 1), np.float32)
                top = share.argmax(axis=1)
                for row, k in zip(share, top, strict=True):
                    if row[k] <= 0:
                        pred.append("und"), score.append(0.0), sets.append([]), parts.append([])
                        continue
                    own = np.flatnonzero(row > 0)
                    own = own[np.argsort(-row[own], kind="stable")]
                    pred.append(names[k]), score.append(min(1.0, float(row[k]))), sets.append([names[x] for x in own]), parts.append([float(x) for x in row[own]])
            return pred, score, sets, parts

        return work

    return append_columns(df, make, FIELDS, {"text": F.lower(text), "letters": F.coalesce(text.rlike(r"\p{L}"), F.lit(False))})


def held_out(key: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the key as text leaves this remainder; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))
