"""Token ids in length-delimited binary records, with a separate index of offsets.

A file holds records one after another:

    length   8 bytes, little-endian: of the data
    check    4 bytes: masked CRC-32 of the length's 8 bytes
    data     key (8 bytes, signed; its least value for a null key), then the ids as 2 or 4 bytes each, little-endian
    check    4 bytes: masked CRC-32 of the data

A checksum c is masked as ((c >> 15 | c << 17) + 0xa282ead8) modulo 2**32, so that data that hold checksums don't
weaken it. The width of the ids is that of the manifest, 2 bytes where the vocabulary has at most 65,536 ids. The index
beside a file, of the same name with .idx, has for each record its offset and length (8 bytes each, little-endian), so
that a reader can take records in any order.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.arrow import as_bytes, in_runs, scratch

NO_KEY = -(1 << 63)
#: Parts of texts that a worker remembers at least.
PARTS = 400_000
#: Bytes of text encoded at once: the more, the fewer distinct parts are looked up again.
RUN = 4 << 20
_MASK = 0xA282EAD8


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF


def framed(data: bytes) -> bytes:
    head = struct.pack("<Q", len(data))
    return b"".join((head, struct.pack("<I", masked(zlib.crc32(head))), data, struct.pack("<I", masked(zlib.crc32(data)))))


def unframed(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """The data of each record of a stream; ValueError where a checksum or the length is wrong."""
    while head := read(12):
        if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(zlib.crc32(head[:8])):
            raise ValueError("a record's length is damaged")
        size = struct.unpack("<Q", head[:8])[0]
        data, tail = read(size), read(4)
        if len(data) < size or len(tail) < 4 or struct.unpack("<I", tail)[0] != masked(zlib.crc32(data)):
            raise ValueError("a record's data are damaged")
        yield data


class _Recent:
    """Ids of the latest parts: of those used since the last turn, and of those before it that are asked for again."""

    def __init__(self):
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def turn(self) -> None:
        if len(self.young) >= PARTS:
            self.old, self.young = self.young, {}

    def get(self, key: bytes) -> bytes | None:
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.young[key] = value
        return value


# Kinds of bytes. Bytes from 0x80 to 0xBF and the lead bytes of U+00C0 to U+027F are of letters, but for the two signs
# among these; a text with any byte of the last kind is left to the library as a whole.
_LETTER, _DIGIT, _OTHER, _SPACE, _BLANK, _END, _UNSURE = range(7)
_KIND = np.full(256, _UNSURE, np.uint8)
_KIND[0x21:0x7F] = _OTHER
_KIND[0x30:0x3A] = _DIGIT
for _a, _b in ((0x41, 0x5B), (0x61, 0x7B), (0x80, 0xC0), (0xC3, 0xCA)):
    _KIND[_a:_b] = _LETTER
_KIND[[9, 10, 13]] = _BLANK
_KIND[0x20], _KIND[0] = _SPACE, _END
_SIGNS = re.compile(b"\xc3[\x97\xb7]")
_APOSTROPHE = ord("'")
# fixed values: endings that the byte-level pre-tokenizer cuts off behind an apostrophe
_ENDINGS = [b"s", b"t", b"m", b"d", b"re", b"ve", b"ll"]


def _begins(buf: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Whether a part of the byte-level pre-tokenizer begins at each byte of texts that each end with a 0, as three more do.

    Letters, digits and other characters make parts, with one space before them; of other white space the last
    character stands alone if a text goes on behind it, and a run at the text's end is one part.
    """
    blank = (kind == _SPACE) | (kind == _BLANK)
    ended = kind == _END
    begins = np.ones(len(buf), bool)
    begins[1:] = np.where(blank[1:], ~blank[:-1], (kind[1:] != kind[:-1]) & (kind[:-1] != _SPACE))
    begins[:-1] |= blank[:-1] & ~blank[1:] & ~ended[1:]
    begins |= ended
    at = np.flatnonzero((buf == _APOSTROPHE) & begins)
    for ending in _ENDINGS:
        found = at
        for k, x in enumerate(ending):
            found = found[buf[found + 1 + k] == x]
        begins[found + 1] = False
        begins[found + 1 + len(ending)] = True
    return begins


class Encoder:
    """Ids of whole texts by the tokenizers library.

    Many texts are parted at once, in numpy, as the byte-level pre-tokenizer parts each; Arrow's dictionary tells the
    distinct parts, and the library's model encodes each of these once, as long as it is remembered. Texts with
    characters other than ASCII ones and Latin letters, with control characters or with an added token, and all texts
    under another kind of tokenizer, are encoded by the library as they are.
    """

    def __init__(self, tokenizer: str, dtype: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_str(tokenizer), np.dtype(dtype)
        made = json.loads(tokenizer)
        before = made.get("pre_tokenizer") or {}
        self.known_kind = (
            made["model"].get("type") == "BPE" and not made["model"].get("dropout") and made.get("normalizer") is None and not made.get("truncation") and not made.get("padding")
            and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        )
        self.added = re.compile(b"|".join(re.escape(x["content"].encode()) for x in made.get("added_tokens") or []) or b"(?!)")
        self.known = _Recent()
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in shown]
        self.alphabet = {b: 256 + i for i, b in enumerate(rest)}

    def _whole(self, text: bytes) -> bytes:
        ids = self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids
        return np.array(ids, self.dtype).tobytes()

    def _part(self, part: bytes) -> bytes:
        tokens = self.tokenizer.model.tokenize(part.decode("latin-1").translate(self.alphabet))
        return np.array([t.id for t in tokens], self.dtype).tobytes()

    def encode(self, texts: list[bytes], end: int) -> list[bytes]:
        """The ids of each text as bytes, with the end id behind."""
        last = np.array([end], self.dtype).tobytes()
        sure = self._sure(texts) if self.known_kind else [False] * len(texts)
        fast = iter(self._parted([x for x, y in zip(texts, sure, strict=True) if y], last))
        return [next(fast) if y else self._whole(x) + last for x, y in zip(texts, sure, strict=True)]

    def _sure(self, texts: list[bytes]) -> list[bool]:
        at = np.cumsum([0] + [len(x) + 1 for x in texts])
        raw = b"\0".join([*texts, b""])
        buf = np.frombuffer(raw, np.uint8)
        bad = np.flatnonzero(_KIND[buf] == _UNSURE)
        zeros = np.flatnonzero(buf == 0)
        more = [m.start() for p in (_SIGNS, self.added) for m in p.finditer(raw)]
        bad = np.concatenate([bad, np.setdiff1d(zeros, at[1:] - 1), np.array(more, np.int64)])
        out = np.ones(len(texts), bool)
        out[np.searchsorted(at, bad, "right") - 1] = False
        return out.tolist()

    def _parted(self, texts: list[bytes], last: bytes) -> list[bytes]:
        if not texts:
            return []
        raw = b"\0".join(texts) + b"\0\0\0\0"
        buf = np.frombuffer(raw, np.uint8)
        starts = np.flatnonzero(_begins(buf, _KIND[buf]))
        starts = starts[: len(starts) - 3]  # what begins at the last three zeros is no part
        offsets = np.append(starts, len(buf) - 3).astype(np.int32)
        parts = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        which = parts.indices.to_numpy()
        self.known.turn()
        values = parts.dictionary.to_pylist()
        found = list(map(self.known.get, values))
        for i, x in enumerate(found):
            if x is None:
                part = values[i]
                found[i] = self.known.young[part] = b"" if part == b"\0" else self._part(part)
        found = [x or last for x in found]  # only the end of a text has none of its own
        flat = np.frombuffer(b"".join(found), self.dtype)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        begin = np.cumsum(sizes) - sizes
        n = sizes[which]
        past = np.cumsum(n)
        ids = flat[np.arange(past[-1]) + np.repeat(begin[which] - past + n, n)].tobytes()
        cuts = [0, *(past[buf[starts] == 0] * self.dtype.itemsize).tolist()]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


_encoders: dict[tuple[int, str], Encoder] = {}


def write(df: DataFrame, text: Column, key: Column, tokenizer: str, end: int, name: str = "records") -> DataFrame:
    """Writes the ids of each whole text (null: empty), with the end id behind, in ascending order of key; returns the manifest.

    tokenizer is the tokenizer's JSON. The rows are dealt by ranges of the key and, for equal or null keys, of the
    text's hash, then of the row's number, so that one hot key, and one row that repeats, is dealt over many tasks; they are in that order (null keys first). Each task
    writes one file and its index into a new folder that all machines share, under a name of its own that is made known
    only when it is complete; what attempts that failed or came second left behind is deleted at the end. The manifest
    (written too) has a row for each file: file, first (its place in the order), start (ids in the files before it),
    docs, ids, width. An empty table has no file. All other columns of df are left out.
    """
    import json

    spark = df.sparkSession
    folder = scratch(spark, name)
    size = len(json.loads(tokenizer)["model"]["vocab"])
    dtype = "<u2" if max(size, end + 1) <= 1 << 16 else "<u4"
    held, which = spark.sparkContext.broadcast(tokenizer), (zlib.crc32(tokenizer.encode()), dtype)
    rows = df.select(key.cast("long").alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    # a row's own number parts rows that are equal in key and text
    rows = rows.withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange("key", "h", "row").sortWithinPartitions("key", "h", "text").select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        docs = ids = at = 0
        files = path = temp = out = index = None
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                files, root = _files(folder)
                files.create_dir(root, recursive=True)
                part = TaskContext.get().partitionId()
                path = f"{root}/part-{part:06d}-{uuid.uuid4().hex}"
                temp = f"{path}.tmp"
                out, index = files.open_output_stream(temp), files.open_output_stream(f"{path}.idx")
            if which not in _encoders:
                _encoders.clear()
                _encoders[which] = Encoder(held.value, dtype)
            keys = b.column(0).to_pylist()
            raw = as_bytes(b.column(1))
            for i, j in in_runs(raw, RUN):
                records, places = [], []
                for k, x in zip(keys[i:j], _encoders[which].encode(raw[i:j], end), strict=True):
                    record = framed(struct.pack("<q", NO_KEY if k is None else k) + x)
                    records.append(record)
                    places.append(struct.pack("<QQ", at, len(record)))
                    at += len(record)
                    docs += 1
                    ids += len(x) // int(dtype[2])
                out.write(b"".join(records))
                index.write(b"".join(places))
        if out is not None:
            out.close()
            index.close()
            files.move(temp, f"{path}.rec")
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (f"{path.rsplit('/', 1)[1]}.rec", part, docs, ids)], names=["file", "part", "docs", "ids"])

    made = sorted(rows.mapInArrow(run, "file string, part long, docs long, ids long").collect(), key=lambda r: r["part"])
    _keep_only(folder, {r["file"] for r in made})
    manifest, first, start = [], 0, 0
    for r in made:
        manifest.append((f"{folder}/{r['file']}", first, start, r["docs"], r["ids"], int(dtype[2])))
        first, start = first + r["docs"], start + r["ids"]
    out = spark.createDataFrame(manifest, "file string, first long, start long, docs long, ids long, width int")
    out.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def _keep_only(folder: str, kept: set[str]) -> None:
    """Deletes the files of attempts that are not in the manifest."""
    from pyarrow import fs

    files, root = _files(folder)
    for x in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if x.is_file and x.base_name.rsplit(".", 1)[0] + ".rec" not in kept:
            files.delete_file(x.path)


def read(manifest: DataFrame) -> DataFrame:
    """The records of the files in the manifest: place (in the whole order), key, start (ids of all records before), ids as little-endian 32-bit bytes.

    A file is one task's work and is read as a stream; every checksum is verified.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["place", "key", "start", "ids"]
        for b in batches:
            for r in b.to_pylist():
                files, path = _files(r["file"])
                place, start, rows = r["first"], r["start"], []
                size = 0
                with files.open_input_stream(path, buffer_size=1 << 20) as stream:
                    for data in unframed(stream.read):
                        (key,) = struct.unpack("<q", data[:8])
                        ids = np.frombuffer(data, f"<u{r['width']}", offset=8).astype("<u4").tobytes()
                        rows.append((place, None if key == NO_KEY else key, start, ids))
                        place, start, size = place + 1, start + len(ids) // 4, size + len(ids)
                        if size >= 8 << 20:
                            yield _batch(rows, names)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows, names)

    n = max(1, manifest.count())
    dealt = manifest.select("file", "first", "start", "width").repartition(n, "file")
    return dealt.mapInArrow(run, "place long, key long, start long, ids binary")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_at(file: str, width: int, places: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """Key and ids of single records of a file by their places in it, through the index."""
    files, path = _files(file)
    out = []
    with files.open_input_file(path.removesuffix(".rec") + ".idx") as index, files.open_input_file(path) as stream:
        for k in places:
            index.seek(16 * k)
            at, size = struct.unpack("<QQ", index.read(16))
            stream.seek(at)
            data = next(unframed(stream.read))
            (key,) = struct.unpack("<q", data[:8])
            out.append((None if key == NO_KEY else key, np.frombuffer(data, f"<u{width}", offset=8)))
    return out
