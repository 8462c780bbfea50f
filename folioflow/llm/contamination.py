"""Benchmark decontamination: a broadcast hash set of test n-grams against every window of every document."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.arrow import BYTE_BASE, append_columns, as_bytes, in_runs, joined, span_hashes, spans, window_hashes, written

#: Lower-case letters, digits and all of UTF-8 beyond ASCII are word bytes; A-Z are lowered; 0 is none.
_WORD = np.zeros(256, np.uint8)
for _a, _b, _c in ((0x30, 0x3A, 0x30), (0x41, 0x5B, 0x61), (0x61, 0x7B, 0x61), (0x80, 0x100, 0x80)):
    _WORD[_a:_b] = np.arange(_c, _c + _b - _a)

FIELDS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("past", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def words_of(text: bytes) -> list[bytes]:
    """The normalised words of one text."""
    return _WORD[np.frombuffer(text, np.uint8)].tobytes().replace(b"\0", b" ").split()


class Windows:
    """The hash set: for each width the windows' hashes in order and where each window begins; and the items' words in one buffer.

    All of it is numpy arrays, of about 7 bytes for each byte of benchmark text.
    """

    def __init__(self, rows: list[tuple[str, bytes]], width: int):
        rows = sorted(rows)
        self.names = [name for name, _ in rows]
        words, self.first, self.begin, self.text = _compact([text for _, text in rows])
        n = np.diff(self.first)
        self.tables = {}
        for size in np.unique(np.minimum(n[n > 0], width)).tolist():
            own = n >= width if size == width else n == size
            place = _places(self.first[:-1][own], n[own] - size + 1)
            hashes = window_hashes(words, size)[place]
            order = np.argsort(hashes, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[hashes >> np.uint64(44)] = True
            self.tables[size] = (hashes[order], place[order].astype(np.int32), seen)
        self.found: dict[bytes, np.ndarray] = {}

    def gram(self, i: int, size: int) -> bytes:
        return self.text[self.begin[i] : self.begin[i + size] - 1].tobytes()

    def items_of(self, gram: bytes, size: int, lo: int, hi: int) -> np.ndarray:
        """The items that have the window, among those from lo to hi, whose hashes are equal; what was asked lately is remembered."""
        if gram not in self.found:
            if len(self.found) >= 10_000:
                self.found.clear()
            place = self.tables[size][1]
            same = [i for i in place[lo:hi].tolist() if self.gram(i, size) == gram]
            self.found[gram] = np.unique(np.searchsorted(self.first, same, "right") - 1)
        return self.found[gram]


def _places(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for n places each."""
    past = np.cumsum(n)
    return np.arange(past[-1] if len(n) else 0) + np.repeat(first - past + n, n)


def _compact(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' words: hashes, where each text's begin (and the end), and where each begins in a buffer with one space behind each (and the end)."""
    words, starts, ends, norm = _hashed(texts)
    first = np.searchsorted(starts, np.cumsum([1] + [len(x) + 1 for x in texts]))
    begin = np.append(0, np.cumsum(ends - starts + 1))
    buf = np.full(begin[-1], 0x20, np.uint8)
    inside = np.ones(len(buf), bool)
    inside[begin[1:] - 1] = False
    buf[inside] = norm[norm != 0]
    return words, first, begin, buf


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts' words: hashes, begin and end in the normalised buffer, and that buffer."""
    buf, _ = joined(texts)
    norm = _WORD[buf]
    starts, ends = spans(norm != 0)
    return span_hashes(norm, starts, ends, BYTE_BASE), starts, ends, norm


def _scan(texts: list[bytes], held: Windows) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
    """Of each text: its words, the ranges of words inside of windows and the items."""
    words, first, begin, text = _compact(texts)
    hits: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[int]] = [set() for _ in texts]
    for size, (known, _, seen) in held.tables.items():
        hashes = window_hashes(words, size)
        maybe = np.flatnonzero(seen[hashes >> np.uint64(44)])
        lo = np.searchsorted(known, hashes[maybe])
        good = known[np.minimum(lo, len(known) - 1)] == hashes[maybe]
        maybe, lo = maybe[good], lo[good]
        hi = np.searchsorted(known, hashes[maybe], "right")
        docs = np.searchsorted(first, maybe, "right") - 1
        whole = maybe + size <= first[docs + 1]
        for i, d, a, b in zip(*(x[whole].tolist() for x in (maybe, docs, lo, hi)), strict=True):
            own = held.items_of(text[begin[i] : begin[i + size] - 1].tobytes(), size, a, b)
            if len(own):
                items[d].update(own.tolist())
                hits[d].append((i - int(first[d]), i - int(first[d]) + size))
    return np.diff(first), [_united(x) for x in hits], [sorted(held.names[k] for k in x) for x in items]


def _united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(df: DataFrame, text: Column, benchmark: DataFrame, item: Column, item_text: Column, width: int = 13, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """df with n_words, hits (ranges of words inside occurrences of benchmark windows, apart and in order) and items.

    A word is a run of ASCII letters and digits and of characters beyond ASCII, with A-Z lowered. A window is width
    consecutive words of an item; an item of fewer, but not none, is one window. Every hash hit is verified word by
    word. Null texts have no words; items with a null id or text have no windows; an empty benchmark hits nothing.
    Repeated rows each get their result. Columns of df with these names are replaced.

    The hash set of a benchmark of at most broadcast_bytes of text is broadcast, and the documents pass it in one
    narrow stage; a larger benchmark meets the documents' windows in a join by their hashes.
    """
    tests = benchmark.select(item.cast("string").alias("item"), item_text.alias("text")).dropna()
    size = tests.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    if size > broadcast_bytes:
        return _scan_joined(df, text, tests, width)
    held = df.sparkSession.sparkContext.broadcast(Windows([(r["item"], r["text"].encode()) for r in tests.collect()], width))

    def make():
        windows = held.value

        def work(texts: pa.Array):
            raw = as_bytes(texts)
            n, hits, items = [], [], []
            for i, j in in_runs(raw):
                a, b, c = _scan(raw[i:j], windows)
                n.extend(a.tolist()), hits.extend(b), items.extend(c)
            return n, [[{"first": a, "past": b} for a, b in x] for x in hits], items

        return work

    return append_columns(df, make, FIELDS, {"text": text})


def _window_rows(width: int):
    """Of (item, text) rows the windows: size, hash, gram, item."""

    def run(batches):
        for b in batches:
            names, raw = b.column(0).to_pylist(), as_bytes(b.column(1))
            for i, j in in_runs(raw):
                held = Windows(list(zip(names[i:j], raw[i:j], strict=True)), width)
                for size, (hashes, place, _) in held.tables.items():
                    grams = [held.gram(k, size) for k in place.tolist()]
                    own = [held.names[k] for k in (np.searchsorted(held.first, place, "right") - 1).tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), size, np.int32)), pa.array(hashes.view(np.int64)), pa.array(grams, pa.binary()), pa.array(own, pa.string())], names=["size", "h", "gram", "item"])

    return run


def _scan_joined(df: DataFrame, text: Column, tests: DataFrame, width: int) -> DataFrame:
    """The scan where the windows are too many for a broadcast: hashes meet in a join, and a row's hits are verified beside its text."""
    names = {f.name.lower() for f in FIELDS}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
    rows = written(df.select(F.struct(*(kept or [F.lit(0).alias("none")])).alias("__row"), text.alias("__text"), F.monotonically_increasing_id().alias("__id")), "scan-rows")
    windows = tests.mapInArrow(_window_rows(width), "size int, h long, gram binary, item string")
    grams = written(windows.groupBy("size", "h", "gram").agg(F.collect_set("item").alias("items")), "scan-grams")
    sizes = sorted(r["size"] for r in grams.select("size").distinct().collect())

    def places(batches):
        for b in batches:
            ids, raw = b.column(0).to_numpy(), as_bytes(b.column(1))
            for i, j in in_runs(raw):
                words, starts, _, _ = _hashed(raw[i:j])
                first = np.searchsorted(starts, np.cumsum([1] + [len(x) + 1 for x in raw[i:j]]))
                n = np.diff(first)
                for size in sizes:
                    per = np.maximum(n - size + 1, 0)
                    at = _places(first[:-1], per)
                    own = np.repeat(np.arange(j - i), per)
                    columns = [ids[i:j][own], at - first[own], np.full(len(at), size, np.int32), window_hashes(words, size)[at].view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["__id", "place", "size", "h"])

    asked = rows.select("__id", "__text").mapInArrow(places, "__id long, place long, size int, h long")
    known = grams.select("size", "h").distinct()
    hits = written(asked.join(known, ["size", "h"]), "scan-hits")
    found = hits.join(grams, ["size", "h"]).groupBy("__id").agg(F.collect_list(F.struct("place", "size", "gram", "items")).alias("__found"))

    def make():
        def work(texts: pa.Array, founds: pa.Array):
            n, hits, items = [], [], []
            for x, own in zip(as_bytes(texts), founds.to_pylist(), strict=True):
                words, _, begin, buf = _compact([x])
                good = [f for f in own or [] if buf[begin[f["place"]] : begin[f["place"] + f["size"]] - 1].tobytes() == f["gram"]]
                n.append(len(words))
                hits.append([{"first": a, "past": b} for a, b in _united([(f["place"], f["place"] + f["size"]) for f in good])])
                items.append(sorted({k for f in good for k in f["items"]}))
            return n, hits, items

        return work

    both = rows.join(found, "__id", "left").select("__row", "__text", "__found")
    out = append_columns(both, make, FIELDS, {"text": F.col("__text"), "found": F.col("__found")})
    return out.select(*(["__row.*"] if kept else []), *[f.name for f in FIELDS])


def n_hit(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda a, x: a + x["past"] - x["first"])


def contaminated(n_words: Column, hit: Column) -> Column:
    """The rule: a twentieth of the words or more are inside of benchmark windows."""
    return (hit > 0) & (20 * hit >= n_words)


def remove_spans(df: DataFrame, text: Column, name: str = "cleaned") -> DataFrame:
    """df (with hits) plus the text without the hit ranges: from the first byte of a range's first word to the last of its last."""

    def make():
        def work(texts: pa.Array, hits: pa.Array):
            out = []
            for x, ranges in zip(as_bytes(texts), hits.to_pylist(), strict=True):
                if ranges:
                    _, starts, ends, _ = _hashed([x])
                    for r in reversed(ranges):
                        x = x[: starts[r["first"]] - 1] + x[ends[r["past"] - 1] - 1 :]
                out.append(x.decode("utf-8", "replace"))
            return [pa.array([None if not t.is_valid else o for t, o in zip(texts, out, strict=True)], pa.string())]

        return work

    return append_columns(df, make, T.StructType([T.StructField(name, T.StringType())]), {"text": text, "hits": F.col("hits")})


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
