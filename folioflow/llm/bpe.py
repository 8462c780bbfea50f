"""Byte-level BPE encoding and decoding; merges are found by a segment tree over the ranks of adjacent pairs.

The leaf of a token holds the rank of the pair that it makes with the next token, and each node the least of the two
below it, rank first and place second. So the root is the leftmost pair of lowest rank. Merging it changes three
leaves: the pair of the new token, that of the token before it, and that of the token that is gone; each is carried up
in a logarithmic number of steps. It ends when no pair that is left has a rank.

Texts are parted in numpy, many at once, as the byte-level pre-tokenizer parts each; Arrow's dictionary tells the
distinct parts. The trees of short parts are rows of one array and are worked on side by side, a merge of each in a
step; a long part has a tree of its own. Added tokens are cut out first and are never merged with what is around them.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from folioflow.llm.arrow import append_columns, as_bytes, in_runs
from folioflow.llm.records import _BLANK, _DIGIT, _END, _LETTER, _OTHER, _SPACE, _begins, _Recent

#: Bytes of text that are parted at once.
RUN = 2 << 20
#: Parts of up to so many bytes are merged side by side and remembered.
SHORT = 64
#: The trees of about so many leaves are built at once.
LEAVES = 1 << 20
#: Bytes that no UTF-8 text has: the end of a text and the added tokens.
_TEXT_END, _FIRST_ADDED, _LAST_ADDED = 0xFF, 0xF8, 0xFE
_NONE = np.iinfo(np.int64).max


def load(path: str) -> str:
    """A tokenizer's JSON; read on the driver."""
    with open(path, encoding="utf-8") as f:
        return f.read()


@cache
def _classes() -> np.ndarray:
    """The pre-tokenizer's class of each code point.

    The regex module and Python know two versions of Unicode; what they disagree about, some 22,000 code points that
    are new in the later one, is asked of the library's own pre-tokenizer.
    """
    import regex
    from tokenizers import pre_tokenizers

    chars = "".join(map(chr, range(0xD800))) + "!" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    out = np.full(len(chars), _OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _DIGIT), (r"\s+", _BLANK)):
        for m in regex.finditer(pattern, chars):
            out[m.start() : m.end()] = kind
    older = np.array([{"L": _LETTER, "N": _DIGIT}.get(unicodedata.category(c)[0], _OTHER) for c in chars], np.uint8)
    parted = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    for i in np.flatnonzero((out != older) & (out != _BLANK)).tolist():
        out[i] = next((k for k, like in ((_LETTER, "a"), (_DIGIT, "1")) if len(parted(like + chars[i])) == 1), _OTHER)
    out[0x20] = _SPACE
    return out


def _alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE tokenizer, from the JSON of the tokenizers library."""

    def __init__(self, tokenizer: str):
        made = json.loads(tokenizer)
        model, before = made["model"], made.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
        if model.get("type") != "BPE" or odd or made.get("normalizer") or made.get("truncation") or made.get("padding"):
            raise ValueError("not a plain BPE model: " + ", ".join(odd))
        if before.get("type") != "ByteLevel" or not before.get("use_regex", True) or before.get("add_prefix_space", True):
            raise ValueError("the pre-tokenizer has to be ByteLevel with its pattern and without a space before the text")
        vocab, byte = model["vocab"], _alphabet()
        self.first = np.array([vocab[c] for c, _ in sorted(byte.items(), key=lambda x: x[1])], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        added = made.get("added_tokens") or []
        if any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in added) or len(added) > _LAST_ADDED - _FIRST_ADDED + 1:
            raise ValueError("added tokens that take white space or words around them, or too many of them")
        self.marks = {x["content"].encode(): bytes([_LAST_ADDED - i]) for i, x in enumerate(added)}
        self.added = re.compile(b"|".join(re.escape(x) for x in sorted(self.marks, key=len, reverse=True)) or b"(?!)")
        self.special = {bytes([_LAST_ADDED - i]): np.array([x["id"]], "<u4").tobytes() for i, x in enumerate(added)}
        size = max([*vocab.values(), *(x["id"] for x in added)]) + 1
        shown = [b""] * size
        for token, i in vocab.items():
            shown[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        for x in added:
            shown[x["id"]] = x["content"].encode()
        self.lengths = np.array([*map(len, shown), 0], np.int64)  # an id beyond the vocabulary is the last one
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.known = _Recent()

    # -- merging

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; _NONE where it is never merged."""
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], _NONE) if len(self.keys) else np.full(pair.shape, _NONE)

    def _side_by_side(self, parts: list[bytes], bits: int) -> list[bytes]:
        """The ids of parts of at most 2**bits bytes: one tree in each row, one merge of each row in a step."""
        width, m = 1 << bits, len(parts)
        size = np.fromiter(map(len, parts), np.int64, m)
        place = np.arange(width)
        inside = place < size[:, None]
        token = np.full((m, width + 1), -1, np.int64)
        token[:, :width][inside] = self.first[np.frombuffer(b"".join(parts), np.uint8)]
        after = np.where(place + 1 < size[:, None], place + 1, width)
        before = np.broadcast_to(np.arange(-1, width), (m, width + 1)).copy()
        tree = np.full((m, 2 * width), _NONE)
        row, at = np.nonzero(after < width)
        rank = self._ranked(token[row, at], token[row, at + 1])
        tree[row, width + at] = np.where(rank == _NONE, _NONE, rank << bits | at)
        k = width
        while (k := k // 2) >= 1:
            np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2], out=tree[:, k : 2 * k])
        row = np.arange(m)
        while len(row := row[tree[row, 1] != _NONE]):
            root = tree[row, 1]
            at, new = root & width - 1, self.made[root >> bits]
            gone = after[row, at]
            right, left = after[row, gone], before[row, at]
            token[row, at], token[row, gone] = new, -1
            after[row, at], before[row, right] = right, at
            tree[row, width + gone] = _NONE
            rank = self._ranked(new, token[row, right])
            tree[row, width + at] = np.where((right == width) | (rank == _NONE), _NONE, rank << bits | at)
            some = np.flatnonzero(left >= 0)
            rank = self._ranked(token[row[some], left[some]], new[some])
            tree[row[some], width + left[some]] = np.where(rank == _NONE, _NONE, rank << bits | left[some])
            node = np.stack([at, gone, np.where(left >= 0, left, at)]) + width
            for _ in range(bits):
                node >>= 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
        kept = token[:, :width] >= 0
        ids, ends = token[:, :width][kept].astype("<u4").tobytes(), (4 * np.cumsum(kept.sum(1))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _alone(self, part: bytes) -> bytes:
        """The ids of one part of any length, by a tree of its own."""
        token = self.first[np.frombuffer(part, np.uint8)].tolist()
        n = len(token)
        bits = max(1, (n - 1).bit_length())
        width, rank_of, made = 1 << bits, self.rank_of, self.made
        none = 1 << 62
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = rank_of.get(token[i] << 32 | token[i + 1])
            if rank is not None:
                tree[width + i] = rank << bits | i
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n))

        def put(leaf: int, a: int, b: int) -> None:
            rank = rank_of.get(token[a] << 32 | token[b]) if 0 <= a and b < n else None
            value = none if rank is None else rank << bits | a
            node = width + leaf
            tree[node] = value
            while node > 1:
                other = tree[node ^ 1]
                node >>= 1
                value = other if other < value else value
                if tree[node] == value:
                    break
                tree[node] = value

        while tree[1] != none:
            at, rank = tree[1] & width - 1, tree[1] >> bits
            gone = after[at]
            right, left = after[gone], before[at]
            token[at], token[gone] = int(made[rank]), -1
            after[at] = right
            if right < n:
                before[right] = at
            put(gone, -1, n)
            put(at, at, right)
            if left >= 0:
                put(left, left, at)
        return np.array([t for t in token if t >= 0], "<u4").tobytes()

    def merged(self, parts: list[bytes]) -> list[bytes]:
        """The ids of each part, as little-endian 32-bit numbers."""
        out: list[bytes] = [b""] * len(parts)
        classes: dict[int, list[int]] = {}
        for i, x in enumerate(parts):
            if len(x) > SHORT:
                out[i] = self._alone(x)
            elif x:
                classes.setdefault(max(1, (len(x) - 1).bit_length()), []).append(i)
        for bits, members in classes.items():
            step = LEAVES >> bits
            for k in range(0, len(members), step):
                some = members[k : k + step]
                for i, ids in zip(some, self._side_by_side([parts[i] for i in some], bits), strict=True):
                    out[i] = ids
        return out

    # -- whole texts

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """The ids of all texts, one after another, and where each text's end."""
        if not texts:
            return np.zeros(0, "<u4"), []
        raw = b"\xff".join(texts) + b"\xff" * 4
        if self.added.search(raw):
            raw = self.added.sub(lambda m: self.marks[m[0]], raw)
        buf = np.frombuffer(raw, np.uint8)
        lead = np.flatnonzero((buf & 0xC0) != 0x80)
        code, whole = buf[lead], buf.astype(np.int32)
        kind = _classes()[np.minimum(code, 0x7F)]
        for low, high, more in ((0xC0, 0xE0, 1), (0xE0, 0xF0, 2), (0xF0, _FIRST_ADDED, 3)):
            at = np.flatnonzero((code >= low) & (code < high))
            if len(at):
                point = whole[lead[at]] & (0x3F >> more)
                for k in range(1, more + 1):
                    point = point << 6 | whole[lead[at] + k] & 0x3F
                kind[at] = _classes()[point]
        kind[code >= _FIRST_ADDED] = _END
        begins = np.flatnonzero(_begins(code, kind))
        starts = lead[begins[: len(begins) - 3]]  # what begins at the last three marks is no part
        offsets = np.append(starts, len(buf) - 3).astype(np.int32)
        parts = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        which, values = parts.indices.to_numpy(), parts.dictionary.to_pylist()
        self.known.turn()
        found = [b"" if x == b"\xff" else self.special.get(x) or self.known.get(x) for x in values]
        new = [i for i, x in enumerate(found) if x is None]
        for i, ids in zip(new, self.merged([values[i] for i in new]), strict=True):
            found[i] = ids
            if len(values[i]) <= SHORT:
                self.known.young[values[i]] = ids
        flat = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin, n = (np.cumsum(sizes) - sizes)[which], sizes[which]
        past = np.cumsum(n)
        ids = flat[np.arange(past[-1]) + np.repeat(begin - past + n, n)]
        return ids, past[buf[starts] == _TEXT_END].tolist()

    def decode(self, ids: np.ndarray, ends: list[int]) -> list[bytes]:
        """The bytes that each text's ids stand for; ids beyond the vocabulary stand for none."""
        ids = np.where((ids < 0) | (ids >= len(self.lengths)), len(self.lengths) - 1, ids).astype(np.int64)
        n = self.lengths[ids]
        past = np.cumsum(n)
        total = int(past[-1]) if len(past) else 0
        raw = self.shown[np.arange(total) + np.repeat(self.starts[ids] - past + n, n)].tobytes()
        cuts = [0, *np.append(0, past)[ends].tolist()] if ends else []
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


_held: dict[int, Bpe] = {}


def _model(broadcast, key: int) -> Bpe:
    """The tokenizer, made once by a worker."""
    if key not in _held:
        _held.clear()
        _held[key] = Bpe(broadcast.value)
    return _held[key]


def _shared(df: DataFrame, tokenizer: str):
    Bpe(tokenizer)  # what is not supported is an error here, not in a task
    return df.sparkSession.sparkContext.broadcast(tokenizer), zlib.crc32(tokenizer.encode())


def encode(df: DataFrame, text: Column, tokenizer: str, name: str = "ids") -> DataFrame:
    """df with the ids of each whole text; null and empty texts have none. A column of that name is replaced.

    tokenizer is the tokenizer's JSON (see load). The strings of added tokens become these tokens, as in the library.
    """
    held = _shared(df, tokenizer)

    def make():
        model = _model(*held)

        def work(texts: pa.Array):
            raw, rows, ends, n = as_bytes(texts), [], [0], 0
            for i, j in in_runs(raw, RUN):
                ids, own = model.encode(raw[i:j])
                rows.append(ids.astype(np.int32))
                ends += [n + x for x in own]
                n += len(ids)
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows)))]

        return work

    return append_columns(df, make, T.StructType([T.StructField(name, T.ArrayType(T.IntegerType()))]), {"text": text})


def decode(df: DataFrame, ids: Column, tokenizer: str, name: str = "decoded") -> DataFrame:
    """df with the text of each row's ids (null ids: empty); null and unknown ids stand for nothing, bytes that are no text for U+FFFD."""
    held = _shared(df, tokenizer)

    def make():
        model = _model(*held)

        def work(rows: pa.Array):
            at = np.asarray(rows.offsets)
            flat = rows.values.fill_null(-1).to_numpy(zero_copy_only=False)[at[0] : at[-1]]
            return [[x.decode(errors="replace") for x in model.decode(flat, (at[1:] - at[0]).tolist())]]

        return work

    return append_columns(df, make, T.StructType([T.StructField(name, T.StringType())]), {"ids": ids.cast("array<int>")})


def round_trip(df: DataFrame, text: Column, tokenizer: str) -> DataFrame:
    """df with n_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers) and decoded_sha256, from encoding each whole text and decoding its ids.

    One narrow pass in which ids and decoded texts don't leave the task. Null and empty texts have no ids. Columns of
    these names are replaced.
    """
    held = _shared(df, tokenizer)
    fields = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def make():
        model = _model(*held)

        def work(texts: pa.Array):
            n, ids_sha, decoded_sha = [], [], []
            raw = as_bytes(texts)
            for i, j in in_runs(raw, RUN):
                ids, ends = model.encode(raw[i:j])
                starts = [0, *ends[:-1]]
                n += [b - a for a, b in zip(starts, ends, strict=True)]
                ids_sha += [hashlib.sha256(ids[a:b].tobytes()).hexdigest() for a, b in zip(starts, ends, strict=True)]
                for x in model.decode(ids, ends):
                    valid = x if x.isascii() else x.decode(errors="replace").encode()
                    decoded_sha.append(hashlib.sha256(valid).hexdigest())
            return n, ids_sha, decoded_sha

        return work

    return append_columns(df, make, fields, {"text": text})
