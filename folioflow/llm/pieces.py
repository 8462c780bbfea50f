"""SentencePiece (merge type) encoding and decoding with a table of each prefix's last token.

The tokens of a prefix of a text are the tokens of the text up to there unless a merge crosses the end, so each
prefix has exactly one last token. It is the only one of the pieces ending there, found by an automaton, that is
compatible with the last token of the prefix before it: the two, joined and merged anew, come out as these two. The
ids are read backwards from the table. The time is linear in the text; no merge queue is kept.

No piece holds the space sign behind another character, so a text is parted before each run of spaces and every
distinct part is encoded once by a worker, up to a bound.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.arrow import append_columns

SPACE = "▁"
#: Parts that a worker remembers at least, and the length up to which it does.
PARTS, PART_CHARS = 200_000, 48
#: Rows whose ids are Python numbers at once.
SLICE = 100


def load(path: str) -> dict:
    """The model's pieces in id order with their scores and kinds; read on the driver."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = ["byte" if m.is_byte(i) else "control" if m.is_control(i) else "unknown" if m.is_unknown(i) else "normal" for i in range(m.get_piece_size())]
    return {"pieces": [m.id_to_piece(i) for i in range(m.get_piece_size())], "scores": [m.get_score(i) for i in range(m.get_piece_size())], "kinds": kinds}


class Codec:
    def __init__(self, model: dict):
        import ahocorasick

        self.pieces, self.kinds = model["pieces"], model["kinds"]
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == "normal"}
        self.scores = {p: model["scores"][i] for p, i in self.ids.items()}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == "byte"}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has the space sign behind another character")
        self.alphabet = {c for p in self.ids for c in p}
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.automaton = ahocorasick.Automaton()
        order = sorted(self.ids, key=lambda p: -self.scores[p])
        self.rank = {p: i for i, p in enumerate(order)}
        #: Of each piece that merging makes: the two that are merged last. Single characters are there from the start.
        self.halves: dict[str, tuple[str, str]] = {}
        for p in {*self.ids, *self.alphabet}:
            parts, last = self._merged(p)
            if parts == [p]:  # others never come out of merging
                self.automaton.add_word(p, (p, len(p)))
                if last:
                    self.halves[p] = last
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.text_of = [None if k == "byte" else "" if k == "control" else " ⁇ " if k == "unknown" else p.replace(SPACE, " ") for p, k in zip(self.pieces, self.kinds, strict=True)]

    def merged(self, text: str) -> list[str]:
        """The definition: the adjacent pair whose joint piece scores highest is merged, the leftmost of equals, until none is left. For short texts."""
        return self._merged(text)[0]

    def _merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The parts, and the two that were merged last."""
        parts, last = list(text), None
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts, last
            last = parts[at], parts[at + 1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, pair: tuple[str, str]) -> bool:
        """Whether the two tokens, joined and merged anew, come out as they are.

        They do unless a merge across their border comes before one inside of them. So merges are undone from the
        latest on: what stands at the border then must not be a piece that merges before the merge just undone; of
        equal merges the left one comes first. Runs of space signs have equal scores and are merged anew.
        """
        if len(self.pairs) >= PARTS:
            self.pairs.clear()
        a, b = pair
        if a.startswith(SPACE * 2) or a == SPACE and b.startswith(SPACE):
            found = self.merged(a + b) == [a, b]
        else:
            rank, halves, limit = self.rank, self.halves, len(self.rank)
            while True:
                across = rank.get(a + b)
                if across is not None and across < limit:
                    found = False
                    break
                when_a, when_b = rank[a] if a in halves else -1, rank[b] if b in halves else -1
                if when_a > when_b:
                    limit, a = when_a, halves[a][1]
                elif when_b >= 0:
                    limit, b = when_b + 1, halves[b][0]
                else:
                    found = True
                    break
        self.pairs[pair] = found
        return found

    def known_tokens(self, text: str) -> list[str]:
        """Tokens of a text over the alphabet."""
        last: list[str | None] = [None] * (len(text) + 1)
        pairs, compatible = self.pairs, self.compatible
        for end, (token, size) in self.automaton.iter(text):
            if last[end + 1] is None:
                start = end + 1 - size
                if start:
                    before = last[start]
                    if before is None:
                        continue
                    fits = pairs.get((before, token))
                    if fits is None:
                        fits = compatible((before, token))
                    if not fits:
                        continue
                last[end + 1] = token
        out, i = [], len(text)
        while i:
            if (token := last[i]) is None:
                raise ValueError(f"no last token: {text[:i]!r}")
            out.append(token)
            i -= len(token)
        return out[::-1]

    def stretches(self, part: str) -> Iterator[str]:
        """The part cut between characters that stand side by side in no piece, as no merge crosses there."""
        begin, inside = 0, self.inside
        for i in range(1, len(part)):
            if part[i - 1 : i + 1] not in inside:
                yield part[begin:i]
                begin = i
        yield part[begin:]

    def encode_stretch(self, text: str) -> bytes:
        """The ids, as bytes of int32, of a stretch: over the alphabet, or one character outside of it."""
        if text[0] not in self.alphabet:  # alone, as it is in no piece
            return array("i", [self.bytes[b] for b in text.encode()]).tobytes()
        tokens = self.known_tokens(text)
        try:
            return array("i", [self.ids[t] for t in tokens]).tobytes()
        except KeyError:  # a character that pieces hold, but that is none
            return array("i", [i for t in tokens for i in ([self.ids[t]] if t in self.ids else [self.bytes[b] for b in t.encode()])]).tobytes()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: without the sign put before the first word; wrong byte runs become U+FFFD."""
        try:
            text = "".join([self.text_of[i] for i in ids])
        except TypeError:  # there are byte pieces
            parts: list[str] = []
            run = bytearray()
            for i in ids:
                if i in self.byte_of:
                    run.append(self.byte_of[i])
                    continue
                parts.append(run.decode("utf-8", "replace"))
                run.clear()
                parts.append(self.text_of[i])
            text = "".join(parts) + run.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") and ids and self.pieces[ids[0]].startswith(SPACE) else text


class _Recent(dict):
    """What make gives for a key, remembered for the latest keys: between PARTS and twice as many."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= PART_CHARS:
            if len(self) >= PARTS:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


def _parts(codec: Codec) -> _Recent:
    """The ids, as bytes of int32, of a part given without its first space sign."""
    stretch = _Recent(codec.encode_stretch)
    inside, alphabet = codec.inside, codec.alphabet

    def make(key: str) -> bytes:
        if key.isalpha() and alphabet.issuperset(key):
            return codec.encode_stretch(SPACE + key)
        if key[-1:] in (",", ".") and key[:-1].isalpha() and key[-2:] not in inside:
            return parts[key[:-1]] + stretch[key[-1]]
        return b"".join([stretch[x] for x in codec.stretches(SPACE + key.replace(" ", SPACE))])

    parts = _Recent(make)
    return parts


def parts_of(text: str) -> Iterator[str]:
    """The parts of a text with a space put before it, each without its first space."""
    spaces = 0
    for p in text.split(" "):
        if p:
            yield " " * spaces + p
            spaces = 0
        else:
            spaces += 1
    if spaces:
        yield " " * (spaces - 1)


def _encoded(parts: _Recent, text: str | None) -> bytes:
    """The ids of a text as bytes of int32."""
    text = text.replace(SPACE, " ") if text else ""
    if not text:
        return b""
    spaced = "  " in text or text[0] == " " or text[-1] == " "
    return b"".join([parts[p] for p in (parts_of(text) if spaced else text.split(" "))])


_held: dict[int, tuple[Codec, _Recent]] = {}


def _codec(model: _Model) -> tuple[Codec, _Recent]:
    """One codec for each worker and model."""
    if model.key not in _held:
        _held.clear()
        codec = Codec(model.value)
        _held[model.key] = codec, _parts(codec)
    return _held[model.key]


class _Model:
    """A broadcast model with a key that workers can hold it by."""

    def __init__(self, spark, model: dict):
        import zlib

        self.broadcast = spark.sparkContext.broadcast(model)
        self.key = zlib.crc32(repr(model).encode())

    @property
    def value(self) -> dict:
        return self.broadcast.value


def encode(df: DataFrame, text: Column, model: dict, name: str = "ids") -> DataFrame:
    """df with the ids of each whole text, without begin or end ids; null and empty texts have none. A column of that name is replaced."""
    held = _Model(df.sparkSession, model)

    def make():
        _, parts = _codec(held)

        def work(texts: pa.Array):
            rows = [_encoded(parts, x) for x in texts.to_pylist()]
            offsets = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), np.int32)))]

        return work

    return append_columns(df, make, T.StructType([T.StructField(name, T.ArrayType(T.IntegerType()))]), {"text": text})


def decode(df: DataFrame, ids: Column, model: dict, name: str = "decoded") -> DataFrame:
    """df with the text of each row's ids; null and empty ids give the empty text. A column of that name is replaced."""
    held = _Model(df.sparkSession, model)

    def make():
        codec, _ = _codec(held)

        def work(rows: pa.Array):
            out: list[str] = []
            for k in range(0, len(rows), SLICE):  # as Python numbers ids take much more memory
                some = rows.slice(k, SLICE)
                at = some.offsets.to_pylist()
                flat = some.values[at[0] : at[-1]].to_pylist()
                out += [codec.decode(flat[i - at[0] : j - at[0]]) for i, j in zip(at, at[1:])]
            return [out]

        return work

    return append_columns(df, make, T.StructType([T.StructField(name, T.StringType())]), {"ids": ids})


def round_trip(df: DataFrame, text: Column, model: dict) -> DataFrame:
    """df with n_tokens, ids_sha256 (of the decimal ids, joined by commas) and decoded_sha256, from encoding each whole text and decoding its ids.

    One pass, a row at a time: ids and decoded texts don't leave the task. Null and empty texts have no ids. Columns of
    these names are replaced.
    """
    held = _Model(df.sparkSession, model)
    fields = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def make():
        codec, parts = _codec(held)

        def work(texts: pa.Array):
            n, ids_sha, decoded_sha = [], [], []
            for k in range(0, len(texts), SLICE):
                for x in texts.slice(k, SLICE).to_pylist():
                    ids = np.frombuffer(_encoded(parts, x), np.int32).tolist()
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                    decoded_sha.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            return n, ids_sha, decoded_sha

        return work

    return append_columns(df, make, fields, {"text": text})
