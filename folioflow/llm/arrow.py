"""Helpers shared by the operators: adding columns in Arrow batches, and words of whole texts as numpy arrays.

Texts are looked at as UTF-8 bytes. Every class of characters used here is a set of ASCII characters or holds all
others, so that bytes and code points tell the same words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.sources.shared import shared_folder as scratch  # noqa: F401
from folioflow.sources.shared import written  # noqa: F401

#: Bytes of text that are worked on at once, unless a single text is longer.
RUN_BYTES = 1 << 20
#: Odd multipliers of the rolling hashes, modulo 2**64.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def append_columns(df: DataFrame, make: Callable[[], Callable], fields: T.StructType, inputs: dict[str, Column]) -> DataFrame:
    """df with the columns that make()(*arrays of inputs) returns; columns of df with the names of fields are replaced.

    make is called once a task. The plan stays one narrow stage.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    names = {f.name.lower() for f in fields}
    keep = [c for c in df.columns if c.lower() not in names]
    given = df.select(*[F.col(f"`{c}`") for c in keep], *[c.alias(f"__in_{k}") for k, c in inputs.items()])
    out = T.StructType([given.schema[c] for c in keep] + list(fields))
    n = len(keep)
    new_types = list(to_arrow_schema(fields).types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in batches:
            if b.num_rows == 0:
                continue
            new = [x if isinstance(x, pa.Array) else pa.array(x, type=t, from_pandas=False) for x, t in zip(work(*b.columns[n:]), new_types, strict=True)]
            yield pa.RecordBatch.from_arrays(list(b.columns[:n]) + new, names=[f.name for f in out])

    return given.mapInArrow(run, out)


def as_bytes(texts: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    return [x or b"" for x in texts.cast(kind).to_pylist()]


def in_runs(texts: list[bytes], limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many bytes together."""
    start = size = 0
    for i, x in enumerate(texts):
        size += len(x) + 1
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one buffer, each behind a line feed and all before one; and where each begins, then the buffer's end."""
    buf = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=at[1:])
    return buf, at + 1


def spans(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of true values; the first and the last value are false."""
    edge = np.flatnonzero(flag[1:] != flag[:-1]) + 1
    return edge[0::2], edge[1::2]


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i under n at least."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(size, np.uint64)
            done = 1
            while done < size:
                p[done : 2 * done] = p[:done] * np.uint64(pow(b, done, 1 << 64))
                done *= 2
            out.append(p)
        _powers[base] = (out[0], out[1])
    return _powers[base]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span: equal spans have equal hashes wherever they are."""
    power, inverse = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of words[i:i + width] for each i that has so many words."""
    at = np.arange(max(0, len(words) - width + 1))
    return span_hashes(words, at, at + width, WORD_BASE)
