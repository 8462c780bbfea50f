"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles, banded and verified.

A document is a weighted set of shingles of five words. A weight is the shingle's count in the text times a damped
inverse document frequency: 1 plus the mean over its words of log(N / df) / log(1 / RARE), at most 1 for a word. df is
counted over all documents; words in fewer than RARE of them all have the highest value, so the table of the others
has at most (distinct words of a mean document) / RARE rows, whatever the number of documents, and can be broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.arrow import WORD_BASE, append_columns, as_bytes, in_runs, mix, span_hashes, written
from folioflow.llm.components import components
from folioflow.llm.contamination import _hashed

WIDTH, ROWS, BANDS = 5, 4, 16
RARE = 1e-3
#: Bytes of text sampled at once, for the caches.
RUN = 1 << 19
#: What distances may be off by, from weights of single precision.
SLACK = 1e-4


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin (and the end)."""
    words, starts, _, _ = _hashed(texts)
    return words, np.searchsorted(starts, np.cumsum([1] + [len(x) + 1 for x in texts]))


def document_frequencies(df: DataFrame, text: Column) -> tuple[int, np.ndarray, np.ndarray]:
    """Documents, and of the words in RARE of them or more: hashes in order and the scaled inverse document frequencies.

    Each batch sends its distinct words once with their number of documents; Spark sums them over all documents.
    """

    def count(batches):
        for b in batches:
            parts, sums = [], []
            raw = as_bytes(b.column(0))
            for i, j in in_runs(raw):
                words, first = _words(raw[i:j])
                doc = np.repeat(np.arange(j - i), np.diff(first))
                _, own = _grouped(doc, words)
                h, n = np.unique(words[own], return_counts=True)
                parts.append(h)
                sums.append(n)
            if parts:
                h, where = np.unique(np.concatenate(parts), return_inverse=True)
                n = np.bincount(where, np.concatenate(sums), len(h)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    rows = df.select(F.coalesce(text, F.lit("")).alias("text"))
    n_docs = rows.count()
    common = rows.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= RARE * n_docs).toArrow()
    h, n = common.column("h").to_numpy().view(np.uint64), common.column("n").to_numpy()
    order = np.argsort(h)
    return n_docs, h[order], (np.log(n_docs / np.maximum(n[order], 1)) / math.log(1 / RARE)).astype(np.float32)


def _grouped(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of (doc, h), and the places of the first of each distinct pair: order[firsts] as second value."""
    order = np.argsort(h)
    d = doc[order]
    again = np.argsort(d.astype(np.uint16) if len(d) and d.max() < 1 << 16 else d, kind="stable")
    order = order[again]
    new = np.ones(len(order), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
    return order, order[new] if len(order) else order


def shingles(texts: list[bytes], idf: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and weight of each text's distinct shingles, by text and hash. Fewer words, but not none, are one shingle."""
    words, first = _words(texts)
    n = np.diff(first)
    common, values = idf
    scaled = np.ones(len(words), np.float32)
    if len(common):
        at = np.minimum(np.searchsorted(common, words), len(common) - 1)
        known = common[at] == words
        scaled[known] = values[at[known]]
    per = np.where(n >= WIDTH, n - WIDTH + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(texts)), per)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per) + first[doc]
    end = np.minimum(start + WIDTH, first[doc + 1])
    h = span_hashes(words, start, end, WORD_BASE)
    total = np.append(0, np.cumsum(scaled.astype(np.float64)))
    weight = 1 + (total[end] - total[start]) / np.maximum(end - start, 1)
    order, own = _grouped(doc, h)
    if not len(order):
        return doc, h, weight.astype(np.float32)
    edge = np.flatnonzero(np.append(True, (h[order[1:]] != h[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])))
    count = np.diff(np.append(edge, len(order)))
    return doc[own], h[own], (weight[own] * count).astype(np.float32)


def _gamma2(p: np.ndarray) -> np.ndarray:
    """Quantiles of Gamma(2, 1): where 1 - (1 + x) exp(-x) = p."""
    x = np.maximum(np.sqrt(2 * p), 1e-12)
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / (x * np.exp(-x)), x / 2)
    return x


_R = _gamma2((np.arange(1 << 12) + 0.5) / (1 << 12)).astype(np.float32)
_LOG_C = np.log(_gamma2((np.arange(1 << 16) + 0.5) / (1 << 16))).astype(np.float32)
_KEYS = [int(x) | 1 for x in mix(np.arange(1, 2 * ROWS * BANDS + 1, dtype=np.uint64))]


def samples(doc: np.ndarray, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have shingles, and their consistent weighted samples (32 bits each), a column for each of ROWS * BANDS.

    For a shingle and a sample, r and c are Gamma(2, 1) and b uniform, all from the shingle's hash. With t the floor of
    log w / r + b and y = exp(r (t - b)), the shingle of least c / (y e^r) is taken, together with its t. Two texts take
    the same with probability equal to their weighted Jaccard similarity.
    """
    docs, first = np.unique(doc, return_index=True)
    out = np.empty((len(docs), ROWS * BANDS), np.uint32)
    if not len(docs):
        return docs, out
    log_w = np.log(w)
    for k in range(ROWS * BANDS):
        x = (h ^ np.uint64(_KEYS[2 * k])) * np.uint64(_KEYS[2 * k + 1])
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
        r = _R[(x >> np.uint64(52)).astype(np.int64)]
        b = ((x >> np.uint64(36)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(2**-16)
        t = np.floor(log_w / r + b)
        log_a = _LOG_C[((x >> np.uint64(18)) & np.uint64(0xFFFF)).astype(np.int64)] - r * (t - b) - r
        bits = log_a.view(np.uint32)
        rank = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)  # in the order of the floats
        taken = (x ^ (t.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) & np.uint64(0xFFFFFFFF)
        out[:, k] = np.minimum.reduceat(rank << np.uint64(32) | taken, first) & np.uint64(0xFFFFFFFF)
    return docs, out


def bands(taken: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of ROWS samples; bands of different places have different keys."""
    out = np.empty((len(taken), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(taken), b + 1, np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            key = mix(key ^ taken[:, k]) + np.uint64(0x9E3779B97F4A7C15)
        out[:, b] = key
    return out


def with_bands(df: DataFrame, text: Column, idf) -> DataFrame:
    """df with the band keys of each whole text; texts without a word have none."""
    held = df.sparkSession.sparkContext.broadcast(idf)

    def make():
        def work(texts: pa.Array):
            raw = as_bytes(texts)
            out: list[np.ndarray] = []
            for i, j in in_runs(raw, RUN):
                docs, taken = samples(*shingles(raw[i:j], held.value))
                keys = bands(taken).view(np.int64)
                rows: list[np.ndarray] = [np.zeros(0, np.int64)] * (j - i)
                for d, x in zip(docs.tolist(), keys, strict=True):
                    rows[d] = x
                out.extend(rows)
            sizes = np.zeros(len(out) + 1, np.int32)
            np.cumsum([len(x) for x in out], out=sizes[1:])
            return [pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)))]

        return work

    return append_columns(df, make, T.StructType([T.StructField("bands", T.ArrayType(T.LongType()))]), {"text": text})


def similarities(left: list[bytes], right: list[bytes], idf) -> np.ndarray:
    """Weighted Jaccard similarity of each pair; 0 where both have no word."""
    a, b = shingles(left, idf), shingles(right, idf)
    n = len(left)
    doc, h, w = (np.concatenate(x) for x in zip(a, b, strict=True))
    order, _ = _grouped(doc, h)
    same = (h[order[1:]] == h[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    least = np.bincount(doc[order[1:]][same], np.minimum(w[order[1:]][same], w[order[:-1]][same]), n)
    total = np.bincount(doc, w, n)
    return least / np.maximum(total - least, 1e-9)


def _measured(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """The pairs (a, b) of texts with their similarity s and the bytes of b."""
    held = pairs.sparkSession.sparkContext.broadcast(idf)
    left = texts.select(F.col("g").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("g").alias("b"), F.col("text").alias("right"))

    def measure(batches):
        for batch in batches:
            x, y = as_bytes(batch.column(2)), as_bytes(batch.column(3))
            s = np.zeros(len(x))
            for i, j in in_runs([p + q for p, q in zip(x, y, strict=True)], RUN):
                s[i:j] = similarities(x[i:j], y[i:j], held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array([len(q) for q in y], pa.int64())], names=["a", "b", "s", "bytes"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(measure, "a binary, b binary, s double, bytes long")


def _finish(idf, least: float):
    """Of members of a bucket (side 0 against side 1), links that join components: for each member of side 0 its similarity to all of side 1 of other components at once, where their distances to the leader allow one."""

    def links(key, table):
        import pyarrow.compute as pc

        table = pa.concat_tables([table.filter(pc.equal(table["side"], 1)), table.filter(pc.equal(table["side"], 0))])
        n_right = pc.sum(table["side"]).as_py() or 0
        names, root_of = np.unique(np.array(table["label"].to_pylist(), dtype=object), return_inverse=True)
        root = np.arange(len(names))
        g, far = table["g"].to_pylist(), table["far"].to_numpy()
        doc, h, w = shingles(as_bytes(table["text"].combine_chunks()), idf.value)
        codes = np.unique(h, return_inverse=True)[1]
        first = np.searchsorted(doc, np.arange(len(g) + 1))
        total = np.bincount(doc, w, len(g))
        cut = first[n_right]
        dense = np.zeros(codes.max() + 1 if len(codes) else 1, np.float32)
        out: list[tuple[bytes, bytes]] = []
        for x in range(n_right, len(g) if n_right else 0):
            other = (root[root_of[:n_right]] != root[root_of[x]]) & (np.abs(far[:n_right] - far[x]) <= 1 - least + SLACK)
            if not other.any():
                continue
            own = slice(first[x], first[x + 1])
            dense[codes[own]] = w[own]
            shared = np.add.reduceat(np.minimum(dense[codes[:cut]], w[:cut]), first[:n_right], dtype=np.float64)
            dense[codes[own]] = 0
            for y in np.flatnonzero(other & (shared >= (least - 1e-6) * (total[x] + total[:n_right] - shared))).tolist():
                a, b = root[root_of[x]], root[root_of[y]]
                if a != b:
                    root[root == a] = b
                    out.append((g[x], g[y]))
        return pa.table({"a": pa.array([p[0] for p in out], pa.binary()), "b": pa.array([p[1] for p in out], pa.binary())})

    return links


def groups(df: DataFrame, text: Column, key: Column, least: float = 0.8, block: int = 500, block_bytes: int = 8 << 20) -> DataFrame:
    """A row for each row of df: key, g (the first 128 bits of the text's SHA-256), label and class_id, class_size, chosen.

    Classes are the connected components of the texts under links of weighted Jaccard similarity of at least least;
    equal texts are of one class (a null text is empty; texts without words link to none but their equals). class_id
    is the least key of the class (null if all are), class_size counts its rows, chosen marks the rows that have
    class_id as key and the least text digest among such: one row, unless rows repeat. All other columns are left out.

    Distinct texts meet in the buckets of their bands. First each member of a bucket is held against the least one,
    its leader; that takes a pair for each member and settles buckets of true copies, however large. In a bucket of
    more than two that is then in several components, the members outside of the leader's component are held against
    the others, so that no link within a bucket is lost. 1 - similarity is a metric, so texts whose distances to the
    leader differ by more than 1 - least can't be linked: members are dealt by that distance into rings as wide, and
    only neighbouring rings meet; the many true copies around a leader don't meet what is far from it. Rings meet in
    blocks of about block texts and block_bytes against as many; a block is one group of a task and gives links alone.
    Buckets, leaders and labels otherwise meet in joins and in sums of a row for each key and task; no bucket is
    gathered.
    """
    rows = df.select(key.alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    n_docs, *idf = document_frequencies(rows, F.col("text"))
    idf = tuple(idf)
    digest = _digest(F.col("text"))
    signed = written(with_bands(rows.select("key", digest.alias("g"), "text"), F.col("text"), idf).drop("text"), "neardup-signed")
    each = signed.groupBy("g").agg(F.first("bands").alias("bands")).select("g", F.explode("bands").alias("bucket"))
    each = written(each, "neardup-buckets")
    shared = each.groupBy("bucket").agg(F.count("*").alias("n"), F.min("g").alias("leader")).filter("n > 1")
    members = written(each.join(shared, "bucket").select("bucket", "g", "leader", "n"), "neardup-members")
    active = members.select("g").distinct()
    texts = rows.withColumn("g", digest).join(active, "g", "left_semi").groupBy("g").agg(F.first("text").alias("text"))
    texts = written(texts, "neardup-texts")

    pairs = members.filter("g <> leader").select(F.col("leader").alias("a"), F.col("g").alias("b")).distinct()
    measured = written(_measured(pairs, texts, idf), "neardup-measured")
    links = measured.filter(F.col("s") >= least - 1e-6).select("a", "b")
    labels = _labels(active, links)

    lead = labels.select(F.col("node").alias("leader"), F.col("label").alias("lead_label"))
    named = members.filter("n > 2").join(labels.withColumnRenamed("node", "g"), "g").join(lead, "leader")
    named = written(named.select("bucket", "g", "leader", "label", "n", (F.col("label") != F.col("lead_label")).alias("apart")), "neardup-named")
    open_ = named.groupBy("bucket").agg(F.count_if("apart").alias("s")).filter("s > 0").select("bucket")
    reach = measured.select(F.col("a").alias("leader"), F.col("b").alias("g"), (1 - F.col("s")).alias("far"), "bytes")
    placed = named.join(open_, "bucket").join(reach, ["leader", "g"], "left")
    far, size = F.coalesce("far", F.lit(0.0)), F.coalesce("bytes", F.lit(0)).alias("bytes")  # only the leader itself has none
    placed = written(placed.select("bucket", "g", "label", "apart", size, far.alias("far"), F.floor(far / (1 - least + SLACK)).alias("ring")), "neardup-placed")
    count = lambda n, size: F.greatest(F.lit(1), F.ceil(n / block), F.ceil(size / block_bytes)).cast("long")
    rights = placed.groupBy("bucket", "ring").agg(count(F.count("*"), F.sum("bytes")).alias("all"))
    lefts = placed.filter("apart").withColumn("ring", F.explode(F.array(F.col("ring") - 1, F.col("ring"), F.col("ring") + 1)))
    parts = lefts.groupBy("bucket", "ring").agg(count(F.count("*"), F.sum("bytes")).alias("parts")).join(rights, ["bucket", "ring"])
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    mine, place = F.pmod(F.xxhash64("g"), F.col("parts")), F.pmod(F.xxhash64("g", F.lit(1)), F.col("all"))
    left = lefts.join(parts, ["bucket", "ring"]).select("bucket", "ring", mine.alias("i"), spread("all").alias("j"), "g", "label", "far", F.lit(0).alias("side"))
    right = placed.join(parts, ["bucket", "ring"]).select("bucket", "ring", spread("parts").alias("i"), place.alias("j"), "g", "label", "far", F.lit(1).alias("side"))
    finish = _finish(df.sparkSession.sparkContext.broadcast(idf), least)
    more = left.union(right).join(texts, "g").groupBy("bucket", "ring", "i", "j").applyInArrow(finish, "a binary, b binary")
    labels = _labels(active, links.union(written(more, "neardup-more")))

    named = signed.select("key", "g").join(labels.withColumnRenamed("node", "g"), "g", "left").withColumn("label", F.coalesce("label", "g"))
    named = written(named, "neardup-classes")
    best = named.groupBy("label").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "g")).alias("best"), F.count("*").alias("class_size"))
    out = named.join(best, "label")
    return out.select("key", "g", "label", F.col("best.key").alias("class_id"), "class_size", (F.col("key").eqNullSafe(F.col("best.key")) & (F.col("g") == F.col("best.g"))).alias("chosen"))


def _labels(active: DataFrame, links: DataFrame) -> DataFrame:
    """node and label of all texts that share a bucket."""
    found = components(links)
    nodes = active.withColumnRenamed("g", "node")
    return written(nodes.join(found, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "neardup-labels")


def keep_one(df: DataFrame, text: Column, key: str) -> DataFrame:
    """df, all its columns, with one row of each class: the one of the least key; of rows that repeat both key and text, any one."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    named = groups(rows, F.col("text"), F.col("key"))
    chosen = written(named.filter("chosen").groupBy("key", "g").agg(F.count("*").alias("n")), "neardup-chosen")
    given = rows.select("row", F.col("key").alias("own_key"), _digest(F.col("text")).alias("own_g"))
    on = F.col("own_key").eqNullSafe(F.col("key")) & (F.col("own_g") == F.col("g"))
    once = given.join(chosen.filter("n = 1"), on, "left_semi")
    again = given.join(chosen.filter("n > 1"), on, "left_semi").dropDuplicates(["own_key", "own_g"])
    return once.unionByName(again).select("row.*")


def _digest(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))
